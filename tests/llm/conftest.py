import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use inside
        *[T.StructField(c, T.StringType()) for c in ("row", "res", "key", "node", "digest", "k", "size", "h", "shard", "n", "_id", "_doc", "piece")],
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with clashing extra columns from (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", *["x"] * 13) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    passage = words(rng, 60)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, None, "s0"), (21, "", None), (22, "   \n ", None), (None, base[0], "s1"), (None, None, None)]
    rows += [(30, base[3], "s1"), (31, base[3], "s2"), (30, base[3], "s1"), (32, base[4][:200] + " new words here " + base[4][200:], None)]
    rows += [(40 + i, words(rng, 15) + " " + passage + " " + words(rng, 10), "s0") for i in range(5)]
    rows += [(50, ("ab " * 40000) + base[5], "s1"), (51, "z" * 5000, "s1"), (52, "\n".join([base[6], base[7], base[6], "tail"]), "s2")]
    rows += [(53, base[6] + "\n" + base[7], "s2"), (54, "one two three", "s2"), (55, "one two THREE", "s2"), (-3, base[8] + " ", "s0")]
    return rows
