"""One merchant and one card holding a third of the rows: same results as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from merchantscope.operators import activity, features as ft, live_features as lf


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(13)
    n = 9000
    is_hot = rng.random(n) < 0.35
    pdf = pd.DataFrame({
        "merchant_id": np.where(is_hot, "HOT", np.char.add("M", rng.integers(0, 40, n).astype(str))),
        "card_token_id": np.where(is_hot, "C0", np.char.add("C", rng.integers(1, 90, n).astype(str))),
        "settlement_amount_usd": np.round(rng.lognormal(4, 1, n), 2) * rng.choice([1, 1, -1], n),
        "approved_flag": rng.choice(["Y", "N", None], n, p=[0.8, 0.15, 0.05]),
        "sec": rng.integers(0, 86_400 * 200, n),
        "issuer_country": rng.choice(["US", "DE", "FR", None], n),
        "sub_merchant_id": rng.choice(["", "S1", "S2", None], n),
        "auth_response_code": rng.choice(["00", "05", "57", None], n),
    })
    df = spark.createDataFrame(pdf).withColumn(
        "transaction_datetime_utc",
        F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")).cast("timestamp_ntz"),
    ).withColumn("transaction_date", F.to_date("transaction_datetime_utc"))
    return pdf, df.repartition(8)


def test_percentiles_of_the_hot_merchant(spark, hot):
    pdf, df = hot
    got = ft.amount_features(ft.amount_counts(df)).toPandas().set_index("merchant_id")
    ok = pdf[pdf.approved_flag == "Y"]
    for m, g in ok.groupby("merchant_id"):
        a = g.settlement_amount_usd.abs()
        assert got.median_ticket_usd[m] == pytest.approx(a.median())
        assert got.p95_ticket_usd[m] == pytest.approx(a.quantile(0.95))
    assert got.n_distinct_amounts["HOT"] == pdf[pdf.merchant_id == "HOT"].settlement_amount_usd.abs().nunique()


def test_dimensions_with_missing_values(spark, hot):
    pdf, df = hot
    names = ["issuer_bin", "acquirer_bin", "card_acceptor_id", "local_hour"]
    full = df.withColumns({c: F.lit(None).cast("string") for c in names})
    got = ft.dimension_features(ft.dimension_counts(full)).toPandas().set_index("merchant_id")
    for m, g in pdf.groupby("merchant_id"):
        p = g.issuer_country.value_counts(normalize=True)
        assert got.issuer_country_entropy[m] == pytest.approx(-(p * np.log(p)).sum())
        assert got.issuer_country_hhi[m] == pytest.approx((p**2).sum())
        assert got.n_sub_merchant_ids[m] == g.sub_merchant_id.replace("", None).nunique()
        assert got.n_issuer_bins[m] == 0 and got.hour_entropy[m] == 0


def test_cards(spark, hot):
    pdf, df = hot
    got = ft.card_burst_features(ft.card_hour_counts(df)).toPandas().set_index("merchant_id")
    for m, g in pdf.groupby("merchant_id"):
        n = g.card_token_id.value_counts()
        assert got.unique_cards[m] == len(n) and got.max_txn_single_card[m] == n.max()
        assert got.card_concentration_hhi[m] == pytest.approx(((n / n.sum()) ** 2).sum())


def test_audit(spark, hot):
    pdf, df = hot
    got = activity.activity_audit(df, 60, 3).toPandas().set_index("merchant_id")
    day = pd.to_datetime(pdf.sec, unit="s").dt.normalize()
    recent = pdf[day > day.max() - pd.DateOffset(months=3)]
    for m in pdf.merchant_id.unique():
        g = recent[recent.merchant_id == m]
        assert got.txn_count_lookback[m] == len(g)
        assert got.passes_activity_filter[m] == (len(g) >= 60 and (g.approved_flag == "Y").any())


def test_dormant_merchants_are_listed(spark):
    rows = [("A", "2024-06-01", "Y"), ("B", "2020-01-01", "Y"), ("A", "2024-06-02", "N")]
    df = spark.createDataFrame(rows, "merchant_id string, d string, approved_flag string").select(
        "merchant_id", F.to_date("d").alias("transaction_date"), F.lit(1.0).alias("settlement_amount_usd"),
        "approved_flag")
    out = {r.merchant_id: r for r in activity.activity_audit(df, 1, 12).collect()}
    assert out["B"].txn_count_lookback == 0 and out["B"].days_since_last_txn == 999
    assert out["B"].active_days == 0 and not out["B"].passes_activity_filter
    assert out["A"].passes_activity_filter and out["A"].exclusion_reason == ""


def test_change_point(spark, hot):
    pdf, df = hot
    live = df.select(
        "merchant_id", F.col("transaction_datetime_utc").alias("event_ts"),
        F.col("settlement_amount_usd").alias("amount"), (F.col("issuer_country") == "US").alias("ecommerce"))
    got = lf.change_point(live).toPandas().set_index("merchant_id")
    for m, g in pdf.groupby("merchant_id"):
        mid = np.sort(g.sec)[len(g) // 2]
        a, b = g[g.sec < mid], g[g.sec >= mid]
        pay = [x[x.settlement_amount_usd > 0].settlement_amount_usd.mean() for x in (a, b)]
        remote = [(x.issuer_country == "US").mean() for x in (a, b)]
        want = min(1, abs(remote[1] - remote[0]) + abs(pay[1] - pay[0]) / 300)
        assert got.change_point_score[m] == pytest.approx(want)


def test_ordinary_and_crowded_merchants_give_the_same(spark, hot):
    _, df = hot
    null_ids = df.limit(50).withColumn("merchant_id", F.lit(None).cast("string"))
    rows = df.unionByName(null_ids)
    names = ["issuer_bin", "acquirer_bin", "card_acceptor_id", "local_hour"]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in names})
    crowded = ft.crowded_merchants(rows, 1000)
    assert {r.merchant_id for r in crowded.collect()} == {"HOT", None}
    assert ft.crowded_merchants(df, 10**6) is None
    makes = {
        "dims": lambda t: ft.dimension_features(ft.dimension_counts(t)),
        "cards": lambda t: ft.card_burst_features(ft.card_hour_counts(t)),
        "amounts": ft.amount_counts,
    }
    for make in makes.values():
        want = make(rows).toPandas()
        keys = list(want.columns[:2])
        for few in (crowded, None, rows.select("merchant_id").distinct()):
            got = ft.per_merchant(rows, few, make).toPandas()[want.columns]
            pd.testing.assert_frame_equal(
                got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True))


def test_ordinary_merchants_move_once(spark, hot):
    _, df = hot
    stored = df.withColumns({c: F.lit(None).cast("string") for c in ["issuer_bin", "acquirer_bin", "card_acceptor_id", "local_hour"]})
    for make in (lambda t: ft.card_burst_features(ft.card_hour_counts(t)),
                 lambda t: ft.dimension_features(ft.dimension_counts(t))):
        plain, once = (ft.per_merchant(stored, None, make), make(stored))
        exchanges = [d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") for d in (plain, once)]
        assert exchanges[0] == 1 < exchanges[1]


def month_rows(spark, df):
    """The fact with descriptors that tie within months, and merchants listed twice, once or not at all."""
    worded = F.element_at(
        F.array(*[F.lit(x) for x in ("SHOP ONE", "WWW.SHOP.COM", "online payment")]), (F.col("sec") % 4 + 1).cast("int"))
    rows = df.withColumn("merchant_descriptor", F.when(F.col("sec") % 4 < 3, worded))
    names = [("HOT", "shop"), ("HOT", "one shop"), *[(f"M{i}", "shop one") for i in range(30)], ("M3", None)]
    return rows, spark.createDataFrame(names, "merchant_id string, merchant_name string")


def test_tickets_and_months_of_ordinary_and_crowded_merchants(spark, hot):
    _, df = hot
    bare = df.limit(3).withColumns({
        "merchant_id": F.lit("BARE"), "settlement_amount_usd": F.lit(None).cast("double"),
        "transaction_date": F.lit(None).cast("date")})
    rows, merchants = month_rows(spark, df.unionByName(bare))
    crowded = ft.crowded_merchants(rows, 1000)
    pairs = {
        "tickets": (ft.ticket_flow, lambda t: ft.amount_features(ft.amount_counts(t))),
        "months": (lambda t: ft.month_flow(t, merchants), lambda t: ft.month_spread(t, merchants)),
    }
    for flow, spread in pairs.values():
        want = spread(rows).toPandas()
        for few in (None, crowded):
            got = ft.per_merchant(rows, few, flow, spread).toPandas()[want.columns]
            pd.testing.assert_frame_equal(
                got.sort_values("merchant_id", ignore_index=True), want.sort_values("merchant_id", ignore_index=True))


def test_features_exchange_an_ordinary_merchant_once_a_pass(spark, hot):
    """counts stored in between were exchanged up to six times more."""
    _, df = hot
    rows, merchants = month_rows(spark, df)
    for flow, also in ((ft.ticket_flow, 0), (lambda t: ft.month_flow(t, merchants), 1)):
        plan = ft.per_merchant(rows, None, flow)._jdf.queryExecution().executedPlan().toString()
        # The merchants' names are numbered beside it.
        assert plan.count("hashpartitioning(") <= 1 + also


def live_rows(df):
    """The fact in the live form, with missing times, cards, amounts and words, and times that cards share."""
    sec = F.col("sec")
    worded = F.try_element_at(F.array(*[F.lit(x) for x in ("SHOP ONE", "WWW.SHOP.COM", "online payment")]), (sec % 4 + 1).cast("int"))
    ts = F.timestamp_micros((sec - sec % 40).cast("long") * 25_000_000).cast("timestamp_ntz")
    rows = df.select(
        "merchant_id", F.when(sec % 29 > 0, F.col("card_token_id")).alias("card_id"), F.when(sec % 23 > 0, ts).alias("event_ts"),
        F.when(sec % 19 > 0, F.round("settlement_amount_usd")).alias("amount"), (F.col("issuer_country") == "US").alias("ecommerce"),
        F.when(sec % 4 < 3, worded).alias("merchant_descriptor"), F.when(sec % 5 > 0, F.lower(worded)).alias("product_signal"),
        F.when(sec % 17 > 0, sec % 3 == 0).alias("refund"))
    never = rows.filter("merchant_id <> 'HOT'").limit(7).withColumns({
        "merchant_id": F.lit("TIMELESS"), "event_ts": F.lit(None).cast("timestamp_ntz"), "amount": F.lit(-1.0)})
    return rows.unionByName(never).unionByName(rows.limit(40).withColumn("merchant_id", F.lit(None).cast("string")))


def test_live_features_of_ordinary_and_crowded_merchants(spark, hot):
    _, df = hot
    rows = live_rows(df).localCheckpoint()
    want = lf.merchant_spread(rows).toPandas()
    for few in (None, ft.crowded_merchants(rows, 1000)):
        got = ft.per_merchant(rows, few, lf.merchant_flow, lf.merchant_spread).toPandas()[want.columns]
        pd.testing.assert_frame_equal(*(x[x.merchant_id.notna()].fillna(0).sort_values("merchant_id", ignore_index=True) for x in (got, want)))
    assert set(want.merchant_id.dropna()) >= {"HOT", "TIMELESS"}
    assert want.set_index("merchant_id").rapid_repeat_ratio["TIMELESS"] >= 0


def test_live_features_exchange_an_ordinary_merchant_once(spark, hot):
    """F3 to F6, F10: slices, amounts, hours and words were exchanged up to nine times."""
    _, df = hot
    plan = ft.per_merchant(live_rows(df).localCheckpoint(), None, lf.merchant_flow)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1
