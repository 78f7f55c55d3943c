"""Slice-based sessionising against row-by-row brute force, and its boundaries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from merchantscope.operators import features as ft, live_features as lf


def txns(spark, rows):
    pdf = pd.DataFrame(rows, columns=["merchant_id", "card_token_id", "sec", "settlement_amount_usd"])
    df = spark.createDataFrame(pdf)
    return df.withColumn(
        "transaction_datetime_utc",
        F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")).cast("timestamp_ntz"),
    )


def brute(rows):
    out = []
    frame = pd.DataFrame(rows, columns=["m", "c", "t", "a"]).sort_values(["m", "c", "t"])
    for (m, c), g in frame.groupby(["m", "c"]):
        gap = g.t.diff()
        burst = (gap.isna() | (gap > 3600)).cumsum()
        for b, x in g.assign(gap=gap).groupby(burst):
            cv = x.a.std() / x.a.mean() if len(x) > 1 else np.nan
            out.append((m, c, b, len(x), cv, x.gap.fillna(0).sum()))
    return out


def test_random_bursts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 3000
    hot = rng.random(n) < 0.4
    rows = list(zip(
        np.where(hot, 1, rng.integers(2, 9, n)), np.where(hot, 1, rng.integers(1, 9, n)),
        rng.integers(0, 600_000, n), np.round(rng.uniform(5, 50, n), 2),
    ))
    got = ft.bursts(ft.card_hour_counts(txns(spark, rows))).toPandas()
    got = got.sort_values(["merchant_id", "card_token_id", "burst_id"])
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(got.itertuples(), want):
        assert (g.merchant_id, g.card_token_id, g.burst_id, g.n) == w[:4]
        assert (np.isnan(w[4]) and pd.isna(g.amt_cv)) or g.amt_cv == pytest.approx(w[4], abs=1e-6)
        assert g.span_sec == pytest.approx(w[5])


@pytest.mark.parametrize("gap,expected", [(3600, 1), (3601, 2), (3599, 1)])
def test_gap_of_exactly_one_hour_stays_in_the_burst(spark, gap, expected):
    rows = [(1, 1, 10_000, 5.0), (1, 1, 10_000 + gap, 5.0)]
    assert ft.bursts(ft.card_hour_counts(txns(spark, rows))).count() == expected


def test_span_includes_the_idle_time_before_the_burst(spark):
    rows = [(1, 1, 0, 9.0)] + [(1, 1, 20_000 + i * 60, 9.0) for i in range(3)]
    split = ft.split_bursts(ft.bursts(ft.card_hour_counts(txns(spark, rows)))).first()
    assert split.n == 3 and split.amt_cv == 0
    assert split.span_sec == 20_000 + 120 and split.inner_span_sec == 120


def test_rapid_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(c), int(t), 1.0) for c, t in zip(rng.integers(1, 6, 400), rng.integers(0, 40_000, 400))]
    df = txns(spark, rows).select(
        "merchant_id", F.col("card_token_id").alias("card_id"),
        F.col("transaction_datetime_utc").alias("event_ts"),
    )
    got = lf.card_features(lf.card_slices(df)).first()
    frame = pd.DataFrame(rows, columns=["m", "c", "t", "a"]).sort_values(["c", "t"])
    rapid = (frame.groupby("c").t.diff() <= 300).sum()
    assert got.rapid_repeat_ratio == pytest.approx(rapid / 400)
