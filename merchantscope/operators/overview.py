"""Portfolio marts on the merchant grain: headline, tiers, families, rollups, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions.numeric import ratio0
from merchantscope.operators.scoring import label_of

M = "merchant_id"


def _sum_if(cond: Column, col: str = "gross_sales_usd") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0))


def headline(scores: DataFrame) -> DataFrame:
    flagged = F.col("flag_for_investigation") == 1
    return scores.agg(
        F.count("*").alias("merchants_monitored"),
        F.sum("txn_count").alias("transactions_scored"),
        F.coalesce(F.sum("gross_sales_usd"), F.lit(0.0)).alias("gross_sales_usd"),
        F.count_if(flagged).alias("flagged_merchants"),
        _sum_if(flagged).alias("flagged_exposure_usd"),
        ratio0(_sum_if(flagged), F.sum("gross_sales_usd")).alias("flagged_exposure_pct"),
        F.count_if(F.col("risk_tier") == "Critical").alias("critical_merchants"),
    )


def tier_distribution(scores: DataFrame) -> DataFrame:
    """All tiers, also empty ones, with merchants and exposure."""
    spine = scores.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate(ref.TIER_ORDER)], "tier_rank int, risk_tier string"
    )
    grouped = scores.groupBy("risk_tier").agg(
        F.count("*").alias("merchants"), F.sum("gross_sales_usd").alias("exposure")
    )
    return (
        spine.join(grouped, "risk_tier", "left")
        .na.fill(0, ["merchants"])
        .na.fill(0.0, ["exposure"])
        .orderBy("tier_rank")
    )


def family_summary(scores: DataFrame) -> DataFrame:
    """One row per family (also empty ones): alerts, exposure, tiers, priorities."""
    spine = scores.sparkSession.createDataFrame(
        [(i, f) for i, f in enumerate(ref.FAMILY_ORDER)], "family_rank int, family string"
    )
    flagged = scores.filter("flag_for_investigation = 1")
    priority = label_of(F.col("top_category"), ref.CATEGORY_PRIORITY)
    counts = {f"tier_{t.lower()}": F.count_if(F.col("risk_tier") == t) for t in ref.TIER_ORDER}
    counts |= {f"alerts_{p.lower()}": F.count_if(priority == p) for p in ("P1", "P2", "P3")}
    grouped = flagged.groupBy("family").agg(
        F.count("*").alias("alerts"),
        F.sum("gross_sales_usd").alias("exposure"),
        *[c.alias(n) for n, c in counts.items()],
    )
    return (
        spine.join(grouped, "family", "left")
        .na.fill(0, ["alerts", *counts])
        .na.fill(0.0, ["exposure"])
        .withColumn("label", label_of(F.col("family"), ref.FAMILY_LABELS))
        .withColumn("separate_class", F.col("family") == "mcc_abuse")
        .orderBy("family_rank")
    )


def family_subtypes(scores: DataFrame) -> DataFrame:
    """Alerts and exposure by family and concealed category."""
    flagged = scores.filter("flag_for_investigation = 1")
    return (
        flagged.groupBy("family", F.col("top_category").alias("category"))
        .agg(F.count("*").alias("alerts"), F.sum("gross_sales_usd").alias("exposure"))
        .withColumn("label", label_of(F.col("category"), ref.CATEGORY_LABELS))
        .withColumn("priority", label_of(F.col("category"), ref.CATEGORY_PRIORITY, "—"))
        .filter(F.col("label") != "")
    )


def priority_queue(scores: DataFrame, k: int = 12) -> DataFrame:
    """The k most exposed flagged merchants with their rules as an array."""
    return (
        scores.filter("flag_for_investigation = 1")
        .orderBy(F.desc("exposure_weighted_score"), M)
        .limit(k)
        .select(
            M, "merchant_name", "declared_mcc", "mcc_group", "integrity_risk_score", "risk_tier",
            "family", "family_label",
            F.when(F.col("subtype") != "", F.col("subtype")).alias("subtype"),
            "gross_sales_usd", "exposure_weighted_score", "rule_names", "flag_reason",
            F.filter(F.split("rule_names", r"\|"), lambda r: r != "").alias("rules"),
        )
    )


def hierarchy_rollup(scores: DataFrame) -> DataFrame:
    """DBA and corporation rollups in one pass (grouping sets).

    ``level`` tells which of the two ids is set.
    """
    by_dba = F.grouping("corp_id") == 1
    return (
        scores.select("dba_id", "dba_name", "corp_id", "corp_name", M, "txn_count",
                      "gross_sales_usd", "integrity_risk_score", "flag_for_investigation")
        .groupingSets(
            [["dba_id", "dba_name"], ["corp_id", "corp_name"]],
            "dba_id", "dba_name", "corp_id", "corp_name",
        )
        .agg(
            F.when(by_dba, F.lit("dba")).otherwise(F.lit("corp")).alias("level"),
            F.count(M).alias("merchants"),
            F.sum("txn_count").alias("txns"),
            F.sum("gross_sales_usd").alias("sales_usd"),
            F.max("integrity_risk_score").alias("max_score"),
            F.avg("integrity_risk_score").alias("mean_score"),
            F.sum("flag_for_investigation").alias("flagged"),
        )
        .select(
            "level",
            F.coalesce("dba_id", "corp_id").alias("entity_id"),
            F.coalesce("dba_name", "corp_name").alias("entity_name"),
            "merchants", "txns", "sales_usd", "max_score", "mean_score", "flagged",
        )
    )


def monthly_trend(tx: DataFrame, scores: DataFrame) -> DataFrame:
    """Approved non-refund volume per month, total and of flagged merchants.

    Volume is reduced to (merchant, month) before the flags are joined, so the
    fact itself is never shuffled by merchant in full.
    """
    volume = (
        tx.filter((F.col("approved_flag") == "Y") & (F.coalesce("refund_flag", F.lit("")) != "Y"))
        .groupBy(M, F.date_format("transaction_date", "yyyy-MM").alias("month"))
        .agg(F.sum(F.abs("settlement_amount_usd")).alias("amt"))
    )
    flagged = scores.filter("flag_for_investigation = 1").select(M, F.lit(True).alias("hit"))
    return (
        volume.join(flagged, M, "left")
        .groupBy("month")
        .agg(
            F.sum("amt").alias("volume"),
            _sum_if(F.col("hit"), "amt").alias("flagged_volume"),
        )
        .orderBy("month")
    )


def scope_totals(scores: DataFrame, families: list[str]) -> DataFrame:
    """Headline figures over a chosen set of families."""
    inside = F.col("family").isin(families)
    return scores.agg(
        F.count_if(inside).alias("alerts"),
        F.count_if(inside & (F.col("risk_tier") == "Critical")).alias("critical"),
        _sum_if(inside).alias("exposure"),
        ratio0(_sum_if(inside), F.sum("gross_sales_usd")).alias("exposure_pct"),
    )


def rule_hits(scores: DataFrame, rules: list[str] = ref.BATCH_RULES) -> DataFrame:
    """How many merchants each rule fired on, rules without a hit included."""
    once = scores.agg(*[F.sum(r).alias(r) for r in rules])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("fired")) for r in rules])
    return once.select(F.inline(pairs))


def cohort(scores: DataFrame, family: str, category: str) -> DataFrame:
    """Merchants of one family and category, riskiest first."""
    return scores.filter(
        (F.col("family") == family) & (F.col("top_category") == category)
    ).orderBy(F.desc("integrity_risk_score"), M)


def cohort_summary(scores: DataFrame) -> DataFrame:
    """Per family and category: size, exposure, mean score, acute and model-flagged."""
    return (
        scores.filter("flag_for_investigation = 1")
        .groupBy("family", "top_category")
        .agg(
            F.count("*").alias("merchants"),
            F.sum("gross_sales_usd").alias("exposure"),
            F.avg("integrity_risk_score").alias("mean_score"),
            F.count_if(F.col("risk_tier").isin("Critical", "High")).alias("acute"),
            F.count_if(F.col("flag_reason").contains("model")).alias("model_flagged"),
        )
    )


def queue_view(
    merchants: DataFrame,
    tier: str | None = None,
    min_signals: int = 0,
    text: str = "",
    cased: DataFrame | None = None,
    sort_by: str = "integrity_risk_score",
) -> DataFrame:
    """Queue filter: tier, elevated signals, free text, not yet cased; sorted."""
    out = merchants
    if tier:
        out = out.filter(F.col("risk_tier") == tier)
    if min_signals:
        out = out.filter(F.col("elevated_signals") >= min_signals)
    if text:
        needle = text.strip().lower()
        out = out.filter(
            F.lower("merchant_name").contains(needle)
            | F.lower(F.col(M).cast("string")).contains(needle)
            | F.lower("mcc_group").contains(needle)
        )
    if cased is not None:
        out = out.join(cased.select(M), M, "left_anti")
    return out.orderBy(F.desc(sort_by), M)


def entity_search(
    merchants: DataFrame, text: str, cols: list[str], order: str, k: int = 8,
    when_blank: Column | None = None,
) -> DataFrame:
    """Top k merchants whose id or a name contains the text.

    A blank text keeps the rows of ``when_blank`` (for instance the critical tier).
    """
    needle = text.strip().lower()
    if not needle:
        hit = when_blank if when_blank is not None else F.lit(True)
    else:
        hit = F.lit(False)
        for c in cols:
            found = F.lower(F.col(c).cast("string")).contains(needle)
            hit = hit | F.coalesce(found, F.lit(False))
    return merchants.filter(hit).orderBy(F.desc(order), M).limit(k)
