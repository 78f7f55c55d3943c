"""Acquirer cases, their members, patches, filing and service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions.numeric import round_half_up
from merchantscope.operators.lanes import GOVERNED
from merchantscope.operators.scoring import label_of

M = "merchant_id"


def case_members(records: DataFrame) -> DataFrame:
    """Flagged merchants with exposure and proposed fine, one row per member.

    Members stay rows: an acquirer with very many merchants makes many rows, not one
    large value. Expects ``exposure``.
    """
    def by_tier(values: dict[str, float]) -> Column:
        return F.when(F.col("risk_tier") == "critical", F.lit(values["critical"])).otherwise(
            F.lit(values["high"])
        )

    fine = F.col("exposure") * by_tier(live.FINE_RATE) + by_tier(live.FINE_FLAT)
    return records.filter(F.col("risk_tier").isin(GOVERNED)).select(
        "acquirer_id", M, "trade_name", F.col("primary_typology").alias("typology"), "risk_tier",
        F.col("final_risk_score").alias("model_score"), "exposure",
        round_half_up(fine, 0).alias("fine_usd"),
    )


def recommended_action(typology: Column, severity: Column) -> Column:
    critical = F.coalesce(
        F.nullif(label_of(typology, live.ACTION_CRITICAL), F.lit("")),
        F.lit(live.ACTION_CRITICAL_OTHERWISE),
    )
    standard = F.coalesce(
        F.nullif(label_of(typology, live.ACTION_STANDARD), F.lit("")),
        F.lit(live.ACTION_STANDARD_OTHERWISE),
    )
    return F.when(severity == "critical", critical).otherwise(standard)


def acquirer_cases(members: DataFrame, opened: Column) -> DataFrame:
    """One case per acquirer: dominant typology, severity, queue, action, totals, due date.

    ``opened`` is the opening date. Ties for the dominant typology go to the one of
    the highest-scored member.
    """
    by_typology = members.groupBy("acquirer_id", "typology").agg(
        F.count("*").alias("_n"),
        F.max("model_score").alias("_top"),
        F.count_if(F.col("risk_tier") == "critical").alias("_critical"),
        F.sum("exposure").alias("_exposure"),
        F.sum("fine_usd").alias("_fine"),
        F.min(F.struct((-F.col("model_score")).alias("k"), F.col(M))).alias("_lead"),
    )
    grouped = by_typology.groupBy("acquirer_id").agg(
        F.sum("_n").alias("merchant_count"),
        F.sum("_critical").alias("critical_count"),
        F.sum("_exposure").alias("total_exposure"),
        F.sum("_fine").alias("total_fine_usd"),
        F.min("_lead")[M].alias(M),
        F.max("_top").alias("model_score"),
        F.min(F.struct((-F.col("_n")).alias("a"), (-F.col("_top")).alias("b"), "typology"))[
            "typology"
        ].alias("typology"),
    )
    severity = F.when(F.col("critical_count") > 0, F.lit("critical")).otherwise(F.lit("high"))
    queue = F.coalesce(
        F.nullif(label_of(F.col("typology"), live.QUEUE_BY_TYPOLOGY), F.lit("")),
        F.lit(live.QUEUE_OTHERWISE),
    )
    days = F.when(F.col("severity") == "critical", live.SLA_DAYS["critical"]).otherwise(
        live.SLA_DAYS["high"]
    )
    return (
        grouped.withColumn("case_id", F.concat(F.lit("CASE-"), F.col("acquirer_id").cast("string")))
        .withColumn("severity", severity)
        .withColumn("queue", queue)
        .withColumn("recommended_action", recommended_action(F.col("typology"), F.col("severity")))
        .withColumn("status", F.lit("new"))
        .withColumn("opened", opened.cast("date"))
        .withColumn("sla_due", F.date_add("opened", days))
    )


def sla_state(cases: DataFrame, as_of: Column) -> DataFrame:
    """Days left (negative when overdue) and the state in words."""
    days = F.datediff("sla_due", as_of.cast("date"))
    return cases.withColumn("days_left", days).withColumn(
        "sla_state",
        F.when(days < 0, F.concat(F.abs(days).cast("string"), F.lit("d overdue")))
        .when(days == 0, F.lit("due today"))
        .otherwise(F.concat(days.cast("string"), F.lit("d left"))),
    )


def filter_cases(cases: DataFrame, status: str = "ALL") -> DataFrame:
    """All cases, the open ones, or one status; highest score first."""
    if status == "OPEN":
        cases = cases.filter(F.col("status").isin(live.OPEN_STATUSES))
    elif status != "ALL":
        cases = cases.filter(F.col("status") == status)
    return cases.orderBy(F.desc("model_score"), "case_id")


def status_counts(cases: DataFrame) -> DataFrame:
    """Cases per status, statuses without a case included."""
    spine = cases.sparkSession.createDataFrame([(s,) for s in live.CASE_STATUSES], "status string")
    counts = cases.groupBy("status").agg(F.count("*").alias("cases"))
    return spine.join(counts, "status", "left").na.fill(0, ["cases"])


def merge_patches(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """Patched values win; notes and audit entries are appended.

    ``patches`` holds one row per case_id with the patchable columns (NULL = keep).
    """
    fields = ["status", "disposition", "recommended_action", "assigned_analyst"]
    logs = ["notes", "audit"]
    p = patches.select(
        "case_id", *[F.col(c).alias(f"_p_{c}") for c in [*fields, *logs] if c in patches.columns]
    )
    joined = cases.join(p, "case_id", "left")
    merged = {
        c: F.coalesce(f"_p_{c}", c)
        for c in fields
        if c in cases.columns and f"_p_{c}" in joined.columns
    }
    for c in logs:
        if c in cases.columns and f"_p_{c}" in joined.columns:
            merged[c] = F.when(
                F.col(f"_p_{c}").isNotNull(), F.concat(F.col(c), F.col(f"_p_{c}"))
            ).otherwise(F.col(c))
    return joined.withColumns(merged).drop(*[c for c in joined.columns if c.startswith("_p_")])


def file_cases(filed: DataFrame) -> DataFrame:
    """Filing log to state: the newest entry of every merchant."""
    row, age = F.struct(*filed.columns), F.struct("filed_at", "filing_id")
    return filed.groupBy(F.col(M).alias("_m")).agg(F.max_by(row, age).alias("_row")).select("_row.*")


def newest_cases(state: DataFrame, shown: int = 50) -> DataFrame:
    """What a panel shows of the state: the newest entries."""
    return state.orderBy(F.desc("filed_at"), F.desc("filing_id")).limit(shown)


def fold_patches(log: DataFrame) -> DataFrame:
    """A log of patches to one row per case, as ``merge_patches`` takes it.

    Expects ``case_id``, ``patched_at`` and ``patch_id``. The newest given value of a field
    stays; notes and audit entries follow each other by time. Every patch counts once, if the
    log holds each ``patch_id`` once (a state keyed by it does).
    """
    age = F.struct("patched_at", "patch_id")
    fields = [c for c in ("status", "disposition", "recommended_action", "assigned_analyst") if c in log.columns]
    logs = [c for c in ("notes", "audit") if c in log.columns]

    def entries(c: str) -> Column:
        given = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("patched_at", "patch_id", c))))
        return F.when(F.size(given) > 0, F.flatten(F.transform(given, lambda e: e[c])))

    return log.groupBy("case_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), age)).alias(c) for c in fields],
        *[entries(c).alias(c) for c in logs],
    )
