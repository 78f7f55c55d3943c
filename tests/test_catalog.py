"""Catalog tables with statistics, joins by cost, counts taken while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from merchantscope.operators import explorer as ex, quality as ql
from merchantscope.session import observed, stage_counted, stage_table
from merchantscope.sources import catalog


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A fact, a wide middle table and a small one, as catalog tables."""
    root, tag = tmp_path_factory.mktemp("tables"), uuid.uuid4().hex
    fact = spark.range(20_000).select((F.col("id") % 500).alias("mid"), (F.col("id") % 1000).alias("tiny"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("x"))
    middle = spark.range(5_000).select((F.col("id") % 500).alias("m_id"), F.col("id").cast("string").alias("m_name"))
    tiny = spark.range(3).select(F.col("id").alias("t_id"), F.array("id").alias("t_list"))
    names = {}
    for name, df in (("fact", fact), ("middle", middle), ("tiny", tiny)):
        names[name] = f"{name}_{tag}"
        catalog.store_table(df, names[name], f"{root}/{name}")
    yield names
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")


def joined(names):
    return f"SELECT count(*) AS n FROM {names['fact']} JOIN {names['middle']} ON mid = m_id JOIN {names['tiny']} ON tiny = t_id"


def test_statistics_come_from_the_catalog(spark, stored):
    got = {(r.table_name, r.column_name): (r.rows, r.nulls) for r in catalog.statistics(spark, list(stored.values())).collect()}
    assert got[stored["fact"], "x"] == (20_000, 5_000) and got[stored["middle"], "m_name"] == (5_000, 0)
    assert got[stored["tiny"], "t_list"] == (3, None)  # lists are not measured


def test_statistics_change_the_join_order(spark, stored):
    as_written = spark.sql(joined(stored))
    with catalog.by_cost(spark):
        by_cost = spark.sql(joined(stored))
        by_cost._jdf.queryExecution().optimizedPlan()
    assert spark.conf.get(catalog.COST_BASED[0]) == "false"

    def depth(df):
        """How deep each table lies in the plan; the tables that are joined first lie deepest."""
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return {n: next(len(x) - len(x.lstrip(" :+-")) for x in lines if stored[n] in x) for n in stored}

    assert as_written.first().n == by_cost.first().n
    assert depth(as_written)["middle"] > depth(as_written)["tiny"]
    assert depth(by_cost)["tiny"] > depth(by_cost)["middle"]


def test_adopted_files_are_not_copied(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/t")
    name = f"adopted_{uuid.uuid4().hex}"
    catalog.adopt_table(spark, name, f"{tmp_path}/t")
    assert all(f"{tmp_path}/t/part-" in f for f in spark.table(name).inputFiles())
    assert catalog.statistics(spark, [name]).first()[2:] == ("bigint", 7, 0, 7)
    spark.sql(f"DROP TABLE {name}")


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    spark.sparkContext.setJobGroup("other", "other")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_console_counts_without_another_job(spark):
    sql = "SELECT id % 10 AS d, count(*) AS n FROM range(5000) GROUP BY 1"
    _, plain = jobs(spark, lambda: stage_table(spark.sql(sql), "plain"))
    result, counted = jobs(spark, lambda: catalog.run_query(spark, sql, cap=4))
    assert plain == counted and (result.total, result.truncated, result.rows.count()) == (10, True, 4)


@pytest.mark.parametrize("where", ["false", "id < 0"])
def test_empty_results_are_counted(spark, where):
    stored, seen = stage_counted(spark.range(10).filter(where), "none", high=F.max("id"))
    assert seen == {"rows": 0, "high": None} and stored.count() == 0


def test_gates_and_metadata_of_the_writing_pass(spark, tmp_path):
    tx = spark.createDataFrame([("C-000001", 5.0), ("4000123412341234", -1.0), (None, 2.0)], "card_id string, amount double")
    watched, seen = observed(tx, **ql.transaction_gates("card_id", "amount"))
    _, n = jobs(spark, lambda: watched.write.parquet(f"{tmp_path}/tx"))
    _, plain = jobs(spark, lambda: tx.write.parquet(f"{tmp_path}/plain"))
    assert n == plain and {**seen.get} == ql.transaction_checks(tx).first().asDict()
    gates = ql.gate_rows(spark, {"tx": seen.get})
    assert sorted(map(tuple, gates.collect())) == [("tx", "bad_tokens", 2), ("tx", "clear_pans", 1), ("tx", "negative_amounts", 1)]
    made = ex.written_metadata(spark, {"tx": (tx.columns, seen.get["rows"])}, {"cap": "1"})
    assert made.collect() == ex.run_metadata({"tx": tx}, {"cap": "1"}).collect()
