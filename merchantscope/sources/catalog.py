"""SQL surface: views over the explorer tables, schema listing, capped display."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from merchantscope.session import stage_counted

DISPLAY_CAP = 2000

#: Acceptance queries of the console, over the views ``merchants`` and
#: ``transactions``.
SAMPLE_QUERIES = {
    "top_flagged_by_exposure": """
        SELECT merchant_name, family_label, risk_tier,
               round(integrity_risk_score, 1) AS risk, gross_sales_usd
        FROM merchants WHERE flag_for_investigation = 1
        ORDER BY exposure_weighted_score DESC, merchant_name LIMIT 15""",
    "interchange_leaders": """
        SELECT merchant_name, declared_mcc, mcc_group,
               round(effective_interchange_bps, 1) AS effective_bps,
               round(interchange_advantage_bps, 1) AS advantage_bps
        FROM merchants WHERE family = 'mcc_abuse'
        ORDER BY interchange_advantage_bps DESC""",
    "split_ticket_groups": """
        SELECT merchant_name, split_group_id, count(*) AS txns,
               round(sum(settlement_amount_usd), 2) AS amount
        FROM transactions WHERE split_group_id IS NOT NULL
        GROUP BY merchant_name, split_group_id
        ORDER BY txns DESC, amount DESC, split_group_id LIMIT 20""",
    "concealed_category": """
        SELECT subtype AS concealed_category, count(*) AS merchants,
               round(sum(gross_sales_usd) / 1e6, 2) AS sales_musd
        FROM merchants WHERE family = 'mcc_miscoding' AND subtype <> ''
        GROUP BY subtype ORDER BY merchants DESC""",
    "chargeback_by_family": """
        SELECT family_label, count(*) AS merchants,
               round(avg(chargeback_rate_bps), 1) AS avg_cb_bps
        FROM merchants WHERE flag_for_investigation = 1
        GROUP BY family_label ORDER BY avg_cb_bps DESC""",
    "riskiest_merchant_transactions": """
        SELECT t.transaction_date, t.merchant_descriptor, t.settlement_amount_usd, t.channel,
               t.chargeback_flag
        FROM transactions t JOIN merchants m USING (merchant_id)
        WHERE m.flag_for_investigation = 1
        ORDER BY m.integrity_risk_score DESC, t.transaction_datetime_utc, merchant_id,
                 t.settlement_amount_usd, t.merchant_descriptor, t.channel, t.chargeback_flag
        LIMIT 50""",
}


#: What a join order by cost needs: estimates from column statistics, and the search itself.
COST_BASED = ["spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.planStats.enabled"]
_MEASURED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


@dataclass(frozen=True)
class QueryResult:
    """``rows`` for display (capped), ``table`` with all rows."""

    rows: DataFrame
    total: int
    truncated: bool
    table: DataFrame


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query_over(sql: str, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Run SQL over the given frames under their names, without any session view."""
    for name in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    used = {name: df for name, df in tables.items() if f"{{{name}}}" in sql}
    return spark.sql(sql, **used)


def describe(spark: SparkSession, views: list[str]) -> DataFrame:
    """(table, column, type) of the given views."""
    rows = [(v, f.name, f.dataType.simpleString()) for v in views for f in spark.table(v).schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def run_query(spark: SparkSession, sql: str, cap: int = DISPLAY_CAP) -> QueryResult:
    """Run any SQL; the display is capped, the total counts all rows.

    The result is written once to the shared folder and counted as it is written, so
    counting and showing do not run the query twice.
    """
    result, seen = stage_counted(spark.sql(sql.strip().rstrip(";")), "console_result")
    total = seen["rows"]
    return QueryResult(result.limit(cap), total, total > cap, result)


def measure(spark: SparkSession, name: str) -> None:
    """Row count and column statistics of a catalog table, one pass over its columns."""
    columns = [f"`{f.name}`" for f in spark.table(name).schema if isinstance(f.dataType, _MEASURED)]
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def store_table(df: DataFrame, name: str, path: str) -> None:
    """A persistent table below ``path``, with statistics."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    measure(spark, name)


def adopt_table(spark: SparkSession, name: str, path: str) -> None:
    """Parquet files that are there already as a catalog table with statistics; nothing is copied."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    measure(spark, name)


def statistics(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, column, type, rows, nulls, distinct) as the catalog holds them, without a scan; NULL where not measured."""
    out = []
    for name in names:
        stated = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        rows = re.search(r"(\d+) rows", stated.get("Statistics") or "")
        for c in spark.catalog.listColumns(name):
            info = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} `{c.name}`").collect()}
            nulls, distinct = (info.get(k) for k in ("num_nulls", "distinct_count"))
            number = [int(x) if x and x.isdigit() else None for x in (rows and rows[1], nulls, distinct)]
            out.append((name, c.name, c.dataType, *number))
    schema = "table_name string, column_name string, data_type string, rows long, nulls long, distinct_estimate long"
    return spark.createDataFrame(out, schema)


@contextmanager
def by_cost(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside order their joins by the tables' statistics."""
    before = {k: spark.conf.get(k) for k in COST_BASED}
    for k in COST_BASED:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan_by_cost(spark: SparkSession, sql: str) -> DataFrame:
    """A query whose join order is settled here, by cost."""
    with by_cost(spark):
        df = spark.sql(sql.strip().rstrip(";"))
        df._jdf.queryExecution().executedPlan()
    return df
