"""The bucketed explorer fact: the same slice, without another exchange of the fact."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from merchantscope.operators import explorer as ex, features as ft
from merchantscope.operators.ranking import PIECE, WHOLE
from merchantscope.sources.buckets import write_bucketed
from starbook.benches import workbench

FOLDER = "/root/testdata/sf0.001"


def nodes(plan):
    """(path of node names from the root, node text) of every node of an executed plan."""
    out, todo = [], [((), plan)]
    while todo:
        path, node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            children = [node.executedPlan()]
        elif name.endswith("QueryStage"):
            children = [node.plan()]
        else:
            children = [node.children().apply(i) for i in range(node.children().size())]
        out.append(((*path, name), node.simpleString(1000)))
        todo += [((*path, name), c) for c in children]
    return out


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_slice_joins_the_fact_as_it_lies(spark, threshold):
    bench = workbench(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = ex.transaction_slice(bench.explorer_tx, bench.scores, flagged_cap=40, clean_sample=15, clean_cap=25)
        rows = sorted(map(str, got.collect()))
        found = nodes(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [path for path, text in found if "FileScan" in text and "Bucketed: true" in text]
    assert len(scans) == 1
    join = max(i for i, name in enumerate(scans[0]) if "Join" in name)
    assert not [name for name in scans[0][join:] if "Exchange" in name]
    # above the join only what survives its piece is exchanged, once
    assert sum(name.startswith(("Exchange", "ShuffleExchange")) for name in scans[0]) == 1
    plain = ex.transaction_slice(bench.tx, bench.scores, flagged_cap=40, clean_sample=15, clean_cap=25)
    assert rows == sorted(map(str, plain.collect()))


def test_every_row_is_in_the_bucketed_fact(spark):
    bench = workbench(spark, FOLDER)
    stored = bench.explorer_tx.drop("_piece")
    assert stored.exceptAll(bench.tx).count() == 0 and stored.count() == bench.tx.count()


CAPS = {"flagged_cap": 40, "clean_sample": 15, "clean_cap": 25}


def test_rows_of_an_ordinary_merchant_are_not_exchanged_again(spark):
    """F7 to F9: each was cut into 64 pieces, whose survivors, often all of its rows, were exchanged."""
    bench = workbench(spark, FOLDER)
    assert bench.crowded is None
    got = ex.transaction_slice(bench.explorer_tx, bench.scores, whole=bench.whole_pieces, **CAPS)
    rows = sorted(map(str, got.collect()))
    path, = [path for path, text in nodes(got._jdf.queryExecution().executedPlan()) if "FileScan" in text and "Bucketed: true" in text]
    assert not [name for name in path if name.startswith(("Exchange", "ShuffleExchange"))]
    assert rows == sorted(map(str, ex.transaction_slice(bench.tx, bench.scores, **CAPS).collect()))


def test_crowded_merchants_are_cut_into_pieces(spark, tmp_path):
    bench = workbench(spark, FOLDER)
    none = bench.tx.limit(5).withColumn("merchant_id", F.lit(None).cast("long"))
    tx = bench.tx.unionByName(none)
    crowded = bench.scores.filter("merchant_id % 2 = 0").select("merchant_id").unionByName(none.select("merchant_id").distinct())
    spread = ["merchant_id", "transaction_datetime_utc", "settlement_amount_usd", "card_token_id"]
    stored = write_bucketed(tx, "crowded_fact", str(tmp_path / "fact"), spread, 8, crowded)
    try:
        assert stored.drop(PIECE).exceptAll(tx).count() == 0 and stored.count() == tx.count()
        pieces = {(r[0], r[1]) for r in stored.select((F.coalesce("merchant_id", F.lit(0)) % 2).alias("k"), F.col(PIECE) == WHOLE).distinct().collect()}
        assert pieces == {(0, False), (1, True)}
        got = ex.transaction_slice(stored, bench.scores, whole=F.col(PIECE) == WHOLE, **CAPS)
        want = ex.transaction_slice(bench.tx, bench.scores, **CAPS)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.sql("DROP TABLE crowded_fact")


def test_features_read_the_bucketed_fact_as_it_lies(spark, tmp_path):
    """F7 to F9: cards, amounts and dimensions exchanged the fact that lay by merchant already."""
    bench = workbench(spark, FOLDER)
    flows = {
        "cards": lambda t, by=("merchant_id",): ft.card_burst_features(ft.card_hour_counts(t, by=by), by),
        "dims": lambda t, by=("merchant_id",): ft.dimension_features(ft.dimension_counts(t, by), by),
        "tickets": ft.ticket_flow,
    }
    crowded = bench.scores.filter("merchant_id % 2 = 0").select("merchant_id")
    spread = ["merchant_id", "transaction_datetime_utc", "settlement_amount_usd", "card_token_id"]
    cut = write_bucketed(bench.tx, "cut_fact", str(tmp_path / "fact"), spread, 8, crowded)
    try:
        for make in flows.values():
            once = ft.per_merchant(bench.tx, None, make, laid=bench.explorer_tx)
            assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
            want = ft.per_merchant(bench.tx, None, make).toPandas().sort_values("merchant_id", ignore_index=True)
            for got in (once, ft.per_merchant(bench.tx, crowded, make, laid=cut)):
                got = got.toPandas().sort_values("merchant_id", ignore_index=True)
                pd.testing.assert_frame_equal(got[want.columns], want)
    finally:
        spark.sql("DROP TABLE cut_fact")
