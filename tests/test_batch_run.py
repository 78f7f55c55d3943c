"""The whole batch run over files, its invariants, plans and determinism."""

import pytest
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope import schemas
from merchantscope.operators import activity, anatomy as an, explorer as ex, features as ft, lanes, ml, overview as ov
from merchantscope.operators import scoring as sc
from merchantscope.operators.ranking import join_in_pieces, top_per_key
from merchantscope.plans import ml_queries as mq, models
from merchantscope.plans.batch import BatchOptions, queue_quality, run_batch
from starbook.benches import workbench
from merchantscope.sources import catalog, readers, writers

FOLDER = "/root/testdata/sf0.001"


def as_schema(df, schema):
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return df.select(*cols)


@pytest.fixture(scope="module")
def book_folder(spark, tmp_path_factory):
    """The star fixture written as the input files of a batch run."""
    root = tmp_path_factory.mktemp("book")
    b = workbench(spark, FOLDER)
    tx = b.tx.withColumn("transaction_id", F.monotonically_increasing_id().cast("string"))
    as_schema(tx, schemas.SETTLEMENT).write.parquet(f"{root}/raw_transactions.parquet")
    m = b.merchants
    for name, schema in [("dim_merchant", schemas.MERCHANT_DIM), ("dim_dba", schemas.DBA_DIM),
                         ("dim_corp", schemas.CORP_DIM), ("dim_acceptance", schemas.ACCEPTANCE_DIM)]:
        writers.write_csv(as_schema(m, schema).distinct(), f"{root}/{name}.csv")
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, book_folder, tmp_path_factory):
    b = workbench(spark, FOLDER)
    out = str(tmp_path_factory.mktemp("out"))
    labels = b.fixture.labels().withColumn("merchant_id", F.col("merchant_id").cast("string"))
    made = run_batch(spark, book_folder, out, b.fixture.mcc_reference(), b.fixture.bands(),
                     BatchOptions(lookback_months=120, trees=5), labels, mq.offline(b))
    return out, made


def test_batch_stores_and_applies_its_models(spark, tables):
    out, made = tables
    store = models.ModelStore(spark, f"{out}/models")
    assert store.linear("integrity").first().features == models.Z_FEATURES
    assert store.trees("head").first().depth > 0 and len(store.linear("category").first().classes) > 1
    assert set(store.bundle().first().artifacts) == {"integrity", "category", "head"}
    scored = made["model_scores"].toPandas()
    assert len(scored) == made["merchant_scores"].count() and scored.model_score.between(0, 100).all()
    heads = made["head_scores"].toPandas()
    assert heads.head_score.between(0, 100).all() and heads.category.notna().all()


def test_a_book_laid_out_by_time_gives_the_same_features(spark, book_folder, tmp_path):
    plain = readers.load_book(spark, book_folder)
    for name in ("dim_merchant", "dim_dba", "dim_corp", "dim_acceptance"):
        (tmp_path / f"{name}.csv").symlink_to(f"{book_folder}/{name}.csv")
    writers.write_parquet(plain.transactions, f"{tmp_path}/raw_transactions.parquet")
    readers.lay_out_book(spark, str(tmp_path))
    laid_out = readers.load_book(spark, str(tmp_path))
    assert laid_out.latest == plain.transactions.agg(F.max("transaction_date")).first()[0] and plain.latest is None
    sums = [F.count("*"), F.round(F.sum("settlement_amount_usd"), 2), F.min("transaction_date")]
    want = plain.transactions.filter(activity.within_lookback(plain.transactions, 12)).agg(*sums).first()
    assert laid_out.timeline.recent(12).agg(*sums).first() == want


def test_batch_matches_the_direct_scores(spark, tables):
    _, made = tables
    want = {str(r.merchant_id): r.integrity_risk_score for r in workbench(spark, FOLDER).scores.collect()}
    got = {r.merchant_id: r.integrity_risk_score for r in made["merchant_scores"].collect()}
    assert got == want


def test_batch_outputs(spark, tables):
    out, made = tables
    doc = spark.read.json(f"{out}/overview").first()
    assert len(doc.tiers) == 5 and len(doc.families) == 6
    assert doc.portfolio[0].merchants_monitored == made["merchant_scores"].count()
    queue = spark.read.option("header", True).csv(f"{out}/flagged_merchants")
    assert queue.count() == made["merchant_scores"].filter("flag_for_investigation = 1").count()
    per_merchant = made["transactions"].groupBy("merchant_id").count().agg(F.max("count")).first()[0]
    assert per_merchant <= 400


def test_registry_and_drill_down_are_written(spark, tables):
    out, made = tables
    registry = spark.read.json(f"{out}/registry_document").first()
    assert {m.model for m in registry.models} == {r.model for r in made["model_registry"].collect()}
    anatomy = spark.read.json(f"{out}/anatomy_document").first()
    shown = {e.merchant_id for e in anatomy.exemplars}
    assert shown and {f.merchant_id for f in anatomy.fingerprint} == shown
    assert len(anatomy.evidence) <= 12 * len(shown)
    merchants = readers.read_table(spark, f"{out}/explorer/merchants_json", made["merchants"].schema, "json")
    # the export rounds measures; names, counts and families come back as they were
    kept = ["merchant_id", "merchant_name", "txn_count", "family", "flag_for_investigation"]
    assert sorted(map(str, merchants.select(*kept).collect())) == sorted(map(str, made["merchants"].select(*kept).collect()))


def test_codes_survive_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("merchant_id,pos_entry_mode,merchant_descriptor\nM1,01,\nM2,1,\"a,\"\"b\"\n")
    schema = "merchant_id string, pos_entry_mode string, merchant_descriptor string"
    rows = readers.normalise_missing(readers.read_table(spark, str(tmp_path / "t.csv"), schema, "csv")).collect()
    assert [(r.pos_entry_mode, r.merchant_descriptor) for r in rows] == [("01", None), ("1", 'a,"b')]


def test_first_present_format_wins(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert readers.read_first_present(spark, str(tmp_path), "x", "a string").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_first_present(spark, str(tmp_path), "y", "a string")


def test_console(spark):
    spark.range(2500).createOrReplaceTempView("numbers")
    result = catalog.run_query(spark, "SELECT * FROM numbers;")
    assert (result.total, result.truncated, result.rows.count()) == (2500, True, 2000)
    assert catalog.describe(spark, ["numbers"]).first()[:] == ("numbers", "id", "bigint")


def test_markdown_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.239), (None, float("nan"))], "s string, x double")
    writers.write_markdown(df, str(tmp_path / "md"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert "| s | x |" in lines and "| a\\|b | 1.239 |" in lines
    assert [r.x for r in writers.rounded(df).collect()] == [1.24, None]


def test_scores_do_not_depend_on_partitioning(spark):
    b = workbench(spark, FOLDER)
    cols = ["merchant_id", "integrity_risk_score", "rule_names", "family"]
    want = sorted(tuple(r) for r in b.scores.select(*cols).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            made = ft.merchant_features(b.tx.repartition(int(n)), b.merchants, b.fixture.mcc_reference(),
                                        b.fixture.bands())
            from merchantscope.session import stage_table
            again = sc.score_merchants(stage_table(made, "again"))
            assert sorted(tuple(r) for r in again.select(*cols).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lane_invariants(spark):
    b = workbench(spark, "/root/testdata/sf0.01")
    routed = lanes.route(b.live_records, lanes.typology_thresholds(b.live_records))
    rows = routed.collect()
    assert all(0 <= r.final_risk_score <= 100 for r in rows)
    for r in rows:
        if r.primary_typology == "CLEAN":
            assert r.lane is None and r.active_typologies == []
        else:
            assert r.lane in live.LANES and r.primary_typology in r.active_typologies
            assert r.lane in r.lanes_touched


def test_integrity_model_drivers(spark):
    from merchantscope.plans.ml_queries import clean_merchants
    model, z = ml.fit_integrity_model(clean_merchants(workbench(spark, "/root/testdata/sf0.01")))
    rows = ml.rescore(model, z).collect()
    assert sorted(r.model_percentile for r in rows)[0] == 0.0
    for r in rows:
        assert 0 <= r.model_score <= 100 and r.model_flag == int(r.model_score >= 65)
        if r.family in ("", "mcc_miscoding"):
            assert len(r.drivers) <= 6 and all(d.contribution > 0.02 for d in r.drivers)
            assert sum(d.share for d in r.drivers) <= 1 + 1e-9
        else:
            assert r.drivers is None and r.model_score == r.integrity_risk_score


def test_labels_are_evaluation_only(spark, tables):
    _, made = tables
    labels = workbench(spark, FOLDER).fixture.labels()
    quality = queue_quality(made["merchant_scores"], labels).first()
    assert quality.tp + quality.fn == quality.support
    assert not set(made["merchant_scores"].columns) & {"is_integrity_violation", "is_interchange_abuse"}


# ------------------------------------------------------------------- plans
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_never_joins_the_fact(spark):
    text = plan(activity.activity_audit(workbench(spark, FOLDER).tx))
    assert "Join" not in text and "CartesianProduct" not in text


def test_base_features_read_the_fact_once(spark):
    text = plan(ft.base_features(workbench(spark, FOLDER).tx))
    assert text.count("FileScan") == 1 and "Python" not in text


def test_trend_prunes_and_pushes_down(spark):
    b = workbench(spark, FOLDER)
    text = plan(ov.monthly_trend(b.tx, b.scores))
    assert "EqualTo(approved_flag,Y)" in text and "card_token_id" not in text


def test_feature_job_has_no_pairwise_plan(spark):
    b = workbench(spark, FOLDER)
    text = plan(ft.merchant_features(b.tx, b.merchants, b.fixture.mcc_reference(), b.fixture.bands()))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Python" not in text
    # Two pre-aggregates are stored beforehand; three more passes read the fact.
    logical = text_of_optimized(
        ft.merchant_features(b.tx, b.merchants, b.fixture.mcc_reference(), b.fixture.bands())
    )
    scans = [x for x in logical.splitlines() if "Relation [" in x and "transaction_datetime_utc" in x]
    assert len(scans) == 3


def text_of_optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _operators(df):
    """Names of a plan's operators from the result down, one path per line kept in order."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"^[\s:+\-*()0-9]*", "", line) for line in text.splitlines()]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("make", ["slice", "evidence"])
def test_large_keys_are_dealt_by_piece_before_they_are_ranked(spark, no_broadcast, make):
    b = workbench(spark, FOLDER)
    if make == "slice":
        df = ex.transaction_slice(b.tx, b.scores)
    else:
        tx = b.tx.withColumn("recurring_flag", F.lit("N"))
        df = an.evidence_sample(an.tagged_rows(tx, b.scores.filter("flag_for_investigation = 1")))
    lines = _operators(df)
    join = next(i for i, x in enumerate(lines) if x.startswith("SortMergeJoin"))
    first = next(x for x in lines[join:] if x.startswith("Exchange"))
    assert "_piece" in lines[join] and "_piece" in first
    # the cut by piece stands above that exchange, with none in between
    window = max(i for i, x in enumerate(lines) if x.startswith("Window ") and "_piece" in x)
    assert not any(x.startswith("Exchange") for x in lines[window:join])


def test_a_third_of_all_rows_in_one_merchant_is_spread(spark, no_broadcast):
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 500 + 100 END AS merchant_id", "id AS v"
    )
    few = spark.range(600).selectExpr("id AS merchant_id", "true AS wanted")
    joined = join_in_pieces(rows, few, ["merchant_id"], ["v"])
    sizes = [r["count"] for r in joined.repartition(64, "merchant_id", "_piece").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    top = top_per_key(joined, ["merchant_id"], [F.desc("v")], 5, ["v"]).filter("merchant_id = 7")
    assert sorted(r.v for r in top.collect()) == [29985, 29988, 29991, 29994, 29997]
