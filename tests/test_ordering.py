"""Exact distributed order statistics against numpy and pandas, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from merchantscope.operators.ordering import (
    average_rank_percent, exact_percentiles, order_statistics, ordinal_rank, prefix_counts,
    value_counts,
)
from merchantscope.operators.ranking import best_per_group, fixed_sample, top_per_key


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 40, 6000))
    values = np.round(rng.lognormal(3, 2, 6000), 2) * rng.choice([-1, 0, 1, 1, 1], 6000)
    return pd.DataFrame({"k": keys, "v": values, "id": np.arange(6000)})


def test_percentiles_equal_numpy(spark, skewed):
    counts = value_counts(spark.createDataFrame(skewed), ["k"], "v")
    got = exact_percentiles(
        counts, ["k"], "v", {"p50": 0.5, "p95": 0.95}, floor={"q1": 0.25}
    ).toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        assert got.p50[k] == pytest.approx(np.percentile(g.v, 50), abs=1e-9)
        assert got.p95[k] == pytest.approx(np.percentile(g.v, 95), abs=1e-9)
        assert got.q1[k] == np.sort(g.v)[int(np.floor(0.25 * (len(g) - 1)))]


def test_order_statistic_with_own_bucket(spark, skewed):
    counts = value_counts(spark.createDataFrame(skewed), ["k"], "id")
    got = order_statistics(
        counts, ["k"], "id", {"mid": lambda t: F.floor(t / 2)}, bucket=F.floor(F.col("id") / 100)
    ).toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        assert got.mid[k] == np.sort(g.id)[len(g) // 2]


def test_prefix_counts_without_key(spark, skewed):
    counts = value_counts(spark.createDataFrame(skewed), [], "v")
    got = prefix_counts(counts, [], "v", ["n"]).toPandas()
    for row in got.sample(50, random_state=1).itertuples():
        assert row.n_before == (skewed.v < row.v).sum()
    assert (got.n_total == len(skewed)).all()


def test_average_rank_equals_pandas(spark, skewed):
    got = average_rank_percent(spark.createDataFrame(skewed), "v", "pct").toPandas().set_index("id")
    want = skewed.set_index("id").v.rank(pct=True)
    assert np.allclose(got.pct.sort_index(), want.sort_index())


def test_ordinal_rank_is_a_permutation(spark, skewed):
    df = spark.createDataFrame(skewed.assign(v=skewed.v.round(-1)))
    got = ordinal_rank(df, "v", "id", "pos").toPandas().sort_values("pos")
    want = got.sort_values(["v", "id"])
    assert got.pos.tolist() == list(range(len(skewed)))
    assert got.id.tolist() == want.id.tolist()


def test_ordinal_rank_with_text_ids(spark, skewed):
    df = spark.createDataFrame(skewed.assign(v=1.0, id="M" + skewed.id.astype(str)))
    got = ordinal_rank(df, "v", "id", "pos").toPandas()
    assert sorted(got.pos) == list(range(len(skewed)))


def test_top_per_key_equals_sorting(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = top_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 5, ["id"]).toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(5)
    assert sorted(got.id) == sorted(want.id)


def test_top_per_key_cuts_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed)
    plan = top_per_key(df, ["k"], [F.desc("v")], 5, ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_best_per_group(spark, skewed):
    got = best_per_group(spark.createDataFrame(skewed), "k", [F.col("v"), F.col("id")]).toPandas()
    want = skewed.sort_values(["v", "id"]).groupby("k").head(1)
    assert sorted(got.id) == sorted(want.id)


def test_fixed_sample_is_fixed(spark, skewed):
    df = spark.createDataFrame(skewed)
    a = fixed_sample(df, "id", 50, 1).toPandas().id.tolist()
    b = fixed_sample(df.repartition(13), "id", 50, 1).toPandas().id.tolist()
    assert a == b and a != fixed_sample(df, "id", 50, 2).toPandas().id.tolist()
