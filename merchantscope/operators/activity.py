"""Activity gate: which merchants have enough recent business to be scored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_lookback(tx: DataFrame, months: int, latest: dt.date | None = None) -> Column:
    """Predicate ``transaction_date > latest date - months``.

    Unless a laid-out fact tells its ``latest`` date, that is an uncorrelated scalar
    subquery: Spark evaluates it once (one narrow scan) and filters the fact with a
    literal, without a join.
    """
    if latest is not None:
        return F.col("transaction_date") > F.add_months(F.lit(latest), -months)
    cutoff = tx.agg(F.add_months(F.max("transaction_date"), -months)).scalar()
    return F.col("transaction_date") > cutoff


def activity_audit(tx: DataFrame, min_txn: int = 3, lookback_months: int = 12, latest: dt.date | None = None) -> DataFrame:
    """One row per merchant in the file, with its gate decision and the reason.

    Merchants without rows in the lookback are kept through the same grouped
    pass: every sum is conditional, so neither an anti-join nor a second scan of
    the fact is needed.
    """
    asof = F.lit(latest) if latest is not None else tx.agg(F.max("transaction_date")).scalar()
    flagged = tx.select(
        "merchant_id", "transaction_date", "settlement_amount_usd", "approved_flag",
        within_lookback(tx, lookback_months, latest).alias("recent"),
    )
    recent_date = F.when(F.col("recent"), F.col("transaction_date"))
    audit = (
        flagged.groupBy("merchant_id")
        .agg(
            F.count_if("recent").alias("txn_count_lookback"),
            F.count_if(F.col("recent") & (F.col("approved_flag") == "Y")).alias(
                "approved_count_lookback"
            ),
            F.coalesce(
                F.sum(F.when(F.col("recent"), F.col("settlement_amount_usd"))), F.lit(0.0)
            ).alias("sales_usd_lookback"),
            F.min(recent_date).alias("first_txn"),
            F.max(recent_date).alias("last_txn"),
        )
        .withColumn(
            "active_days",
            F.coalesce(F.datediff("last_txn", "first_txn") + 1, F.lit(0)),
        )
        .withColumn(
            "days_since_last_txn",
            F.coalesce(F.datediff(asof, F.col("last_txn")), F.lit(999)),
        )
    )
    few = F.col("txn_count_lookback") < min_txn
    dead = F.col("approved_count_lookback") == 0
    return audit.withColumn("passes_activity_filter", ~(few | dead)).withColumn(
        "exclusion_reason",
        F.when(few, F.lit(f"fewer than {min_txn} transactions in trailing {lookback_months} months"))
        .when(dead, F.lit("no approved transactions in lookback window"))
        .otherwise(F.lit("")),
    )


def passing_merchants(audit: DataFrame) -> DataFrame:
    return audit.filter("passes_activity_filter").select("merchant_id")
