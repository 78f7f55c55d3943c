import random

import numpy as np
import pytest

from merchantscope.llm import topk
from merchantscope.llm.queries import queries


def brute(rows, k=20):
    fine = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in fine if i % 20 == 0}:
        for qv in [v for i, v in fine if i == q]:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=20, **blocks):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, cb string, rank string")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(v.filter("id % 20 = 0"), v, k, **blocks).collect())


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "candidate_block": 50, "pivots": 3}])
def test_random_and_odd(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(60)]  # one common vector: ties
    rows += [(500, None), (501, [float("nan")] * 8), (502, [float("inf")] + [0.0] * 7), (503, [None] * 8), (None, rows[1][1])]
    rows += [(520, [0.5, 0.25]), (521, [1.0, -1.0]), (523, []), (540, [0.0] * 8), (-20, rows[2][1])]
    assert run(spark, rows, **blocks) == brute(rows)


def test_small_and_empty(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_close_vectors_are_pruned_rightly(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.05, 6)).tolist()) for i in range(700)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries()["op10_pivot_top_k"](spark, folder).collect()) == brute(rows)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "candidate_block": 40, "pivots": 3}])
def test_repeated_query_ids_are_answered_each(spark, blocks):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(100)]
    # alike, of another vector, and of another length
    rows += [rows[20]] * 24 + [(40, rows[3][1]), (60, [0.5, 0.25]), (103, [1.0, 0.5]), rows[7]]
    assert run(spark, rows, **blocks) == brute(rows)


def test_an_id_and_a_row_of_very_many_rows(spark):
    """A row 200 times and an id with 150 vectors: answers hold up to k of them."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(60)]
    rows += [(70, [0.9, 0.9, 0.9, 0.9])] * 200 + [(71, [rng.gauss(0, 0.2) for _ in range(4)]) for _ in range(150)]
    for k in (5, 20):
        assert run(spark, rows, k, candidate_block=40) == brute(rows, k)
