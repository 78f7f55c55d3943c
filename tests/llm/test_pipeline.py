"""Each stage of the pipeline on its own input, against brute force."""

import re

import pytest

import corpus_pipeline as cp
from merchantscope.llm import quality
from merchantscope.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(texts):
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            common = len(sets[x] & sets[y])
            if common and 100 * common >= 75 * len(sets[x] | sets[y]):
                low, high = sorted((find(x), find(y)))
                root[high] = low
    return {i for i in ids if find(i) == i}


def clean_ids(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    return {i for i, t in texts.items() if not any(tuple(w[k : k + n]) in windows for n in sizes for w in [words(t)] for k in range(len(w) - n + 1))}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    steps = dict(cp.STAGES)
    assert list(steps) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = {}
    current = docs
    for name, stage in list(steps.items())[:-1]:
        out = cp.stage_table(stage(spark, current, FOLDER), name)
        assert out.columns == docs.columns
        kept[name] = (current, out)
        current = out
    scores = quality.quality_scores(docs, table(spark, FOLDER, "labels")).filter("predicted = 1")
    assert {r.doc_id for r in kept["quality"][1].collect()} == {r.doc_id for r in scores.collect()}

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    before, after = kept["near_dedup"]
    assert set(texts(after)) == first_of_each_group(texts(before))
    before, after = kept["decontamination"]
    assert set(texts(after)) == clean_ids(texts(before), [r.text for r in table(spark, FOLDER, "benchmark").collect()])
    before, after = kept["mixing"]
    size = {i: len(t.split()) for i, t in texts(before).items()}
    copies = after.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert copies.max() <= 2 and set(copies.index) <= set(size)
    assert abs(sum(size[i] * c for i, c in copies.items()) / (1.5 * sum(size.values())) - 1) < 0.1
    last = steps["sharding"](spark, current, FOLDER).toPandas()
    assert len(last) == current.count() and sorted(last["shard"].unique()) == list(range(8))
    for _, shard in last.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


def test_run(spark):
    assert set(cp.run(spark, FOLDER).columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, docs_of, odd_rows, tmp_path, empty):
    """Nulls, repeated rows, very long texts, clashing columns; then no rows at all."""
    docs = docs_of([] if empty else odd_rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(0, 1), (None, 1), (1, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [] if empty else [(1, odd_rows[1][1]), (None, "one two three"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = table(spark, str(tmp_path), "documents")
    for name, stage in cp.STAGES[:-1]:
        out = cp.stage_table(stage(spark, current, str(tmp_path)), name)
        assert out.columns == docs.columns
        if name == "quality":
            assert out.count() == docs.count()  # labels of one class: all alike
        if not empty and name == "near_dedup":
            assert {30, 31, 55} & {r.doc_id for r in out.collect()} == set()
        if not empty and name == "decontamination":
            assert {1, 54} & {r.doc_id for r in out.collect()} == set()
        current = out
    last = cp.STAGES[-1][1](spark, current, str(tmp_path)).collect()
    assert len(last) == current.count() and (empty or len(last) > 20)
    for k in range(8):
        slots = sorted(r.slot for r in last if r.shard == k)
        assert slots == list(range(len(slots)))
