"""Shards of rows that no key tells apart, of hot texts and of few rows."""

import random

from merchantscope.llm import sharding


def shards_of(docs, **options):
    got = sharding.histogram_shards(docs, **options).toPandas()
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    return got


def test_equal_rows_without_id_are_split(docs_of):
    rng = random.Random(2)
    rows = [(None, "one text that very many rows share")] * 3000 + [(i, "w" * rng.randint(1, 60)) for i in range(1000)]
    got = shards_of(docs_of(rows))
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 4000 and len(sizes) == 8 and sizes.max() < 1.1 * sizes.min()
    assert got.shard.is_monotonic_increasing or set(got.shard) == set(range(8))


def test_only_equal_rows(docs_of):
    for n in (1, 5, 8, 800):
        sizes = shards_of(docs_of([(7, "abc")] * n)).groupby("shard")["size"].sum()
        assert len(sizes) == min(n, 8) and sizes.max() - sizes.min() <= 4


def test_hot_text_with_ids_and_null_texts(docs_of):
    rows = [(i, "copy of one text") for i in range(2000)] + [(None, None)] * 500 + [(10_000 + i, f"text {i}") for i in range(2000)]
    sizes = shards_of(docs_of(rows), shards=5).groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() < 1.1 * sizes.min()
    assert set(shards_of(docs_of(rows), shards=1).shard) == {0}
