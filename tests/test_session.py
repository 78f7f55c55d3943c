"""Session settings: wide stages are compiled, and their rows do not depend on it."""

from merchantscope.session import ensure_conf
from starbook.fixtures import StarFixture

SMALL = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_no_stage_is_left_to_the_interpreter(spark):
    """The JVM compiles no method beyond 8000 bytes; the settlement join has a longer loop."""
    ensure_conf(spark)
    fixture = StarFixture(spark, SMALL)
    rows = fixture.settlement()
    rows.collect()  # the adaptive plan shows its compiled parts once it has run
    plan = rows._jdf.queryExecution().executedPlan()
    parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    longest = max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
    assert int(spark.conf.get(LIMIT)) <= 8000 < longest


def test_rows_do_not_depend_on_the_limit(spark):
    ensure_conf(spark)
    fixture = StarFixture(spark, SMALL)
    split = fixture.settlement().toPandas()
    kept = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "65535")
        fused = fixture.settlement().toPandas()
    finally:
        spark.conf.set(LIMIT, kept)
    order = ["merchant_id", "transaction_datetime_utc", "card_token_id", "interchange_fee_usd"]
    assert len(split) > 0
    assert split.sort_values(order).reset_index(drop=True).equals(
        fused.sort_values(order).reset_index(drop=True)
    )
