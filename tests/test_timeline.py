"""The fact by month and day: same results, fewer folders read, no scan for the latest date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from merchantscope.operators import activity
from merchantscope.sources import timeline as tl

SCHEMA = "merchant_id long, transaction_date date, settlement_amount_usd double, approved_flag string, txn string"


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=5 * i) for i in range(150)]
    rows = [(i % 7, days[i % 150], float(i), "Y" if i % 3 else "N", f"t{i}") for i in range(1200)]
    rows += [(8, None, 1.0, "Y", "undated"), (9, dt.date(2023, 1, 3), 2.0, "Y", "old")]
    tx = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("timeline") / "fact")
    tl.write_timeline(tx, path)
    return tx, path, tl.read_timeline(spark, path, tx.schema)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df, path):
    return {f.split("/fact/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_nothing_is_lost(fact):
    tx, _, laid_out = fact
    assert sorted(map(str, laid_out.rows.select(*tx.columns).collect())) == sorted(map(str, tx.collect()))


def test_latest_date_comes_from_the_folders(spark, fact, tmp_path):
    tx, path, laid_out = fact
    assert laid_out.latest == tx.agg(F.max("transaction_date")).first()[0]
    tl.write_timeline(tx.filter("false"), str(tmp_path / "none"))
    assert tl.latest_date(spark, str(tmp_path / "none")) is None


def test_lookback_prunes_folders_when_planned(fact):
    tx, path, laid_out = fact
    got = laid_out.recent(3)
    want = tx.filter(activity.within_lookback(tx, 3))
    assert sorted(r.txn for r in got.collect()) == sorted(r.txn for r in want.collect())
    plan = plan_of(got)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "txn_month" in filters and "txn_day" in filters
    # the plan with the latest date given reads the fact once, without a subquery
    audit = activity.activity_audit(laid_out.rows, 3, 3, laid_out.latest)
    text = plan_of(audit)
    assert "Subquery" not in text and text.split("== Initial Plan ==")[0].count("FileScan") == 1
    assert sorted(map(str, audit.collect())) == sorted(map(str, activity.activity_audit(tx, 3, 3).collect()))


def test_chosen_months_prune_folders_at_run_time(spark, fact):
    tx, _, laid_out = fact
    chosen = spark.createDataFrame([("2023-05", 1), ("2024-02", 2), ("2024-03", 9)], "txn_month string, rank int").filter("rank < 5")
    got = laid_out.of_months(chosen)
    want = tx.filter(F.date_format("transaction_date", "yyyy-MM").isin("2023-05", "2024-02"))
    assert sorted(r.txn for r in got.collect()) == sorted(r.txn for r in want.collect())
    assert "dynamicpruning" in plan_of(got)


def test_a_rewritten_day_leaves_the_other_folders(spark, fact, tmp_path):
    tx, _, _ = fact
    path = str(tmp_path / "fact")
    tl.write_timeline(tx, path)
    before = {f for f in spark.read.parquet(path).inputFiles()}
    day = tx.filter(F.col("transaction_date") == dt.date(2023, 1, 6)).withColumn("settlement_amount_usd", F.lit(0.0))
    tl.write_timeline(day, path)
    after = {f for f in spark.read.parquet(path).inputFiles()}
    changed = {f.split("/fact/")[1].rsplit("/", 1)[0] for f in before ^ after}
    assert changed == {"txn_month=2023-01/txn_day=6"}
    assert tl.read_timeline(spark, path, tx.schema).rows.count() == tx.count()


@pytest.mark.parametrize("latest,months,want", [
    ("2024-03-31", 1, "2024-02-29"), ("2023-03-31", 1, "2023-02-28"), ("2024-01-15", 12, "2023-01-15"), ("2024-12-31", 13, "2023-11-30"),
])
def test_cutoff_is_that_of_add_months(spark, latest, months, want):
    got = tl.cutoff_date(dt.date.fromisoformat(latest), months)
    assert str(got) == want == str(spark.range(1).select(F.add_months(F.lit(latest).cast("date"), -months)).first()[0])
