"""Response lanes and the portfolio marts of the live engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions.numeric import ratio0, round_half_up
from merchantscope.operators.live_scoring import exposure
from merchantscope.operators.ordering import exact_percentiles, value_counts

M = "merchant_id"
GOVERNED = ["high", "critical"]
TIERS = ["critical", "high", "elevated", "watch", "clear"]


def with_exposure(records: DataFrame) -> DataFrame:
    return records.withColumn("exposure", exposure())


def typology_thresholds(
    records: DataFrame, p: float = live.SECONDARY_TYPOLOGY_PERCENTILE
) -> DataFrame:
    """Portfolio cut per typology: the element at floor(p*(n-1)), one decimal."""
    long = records.select(F.explode("typology_scores").alias("typology", "score"))
    cuts = exact_percentiles(
        value_counts(long, ["typology"], "score"), ["typology"], "score", floor={"cut": p}
    )
    return cuts.withColumn("cut", round_half_up(F.col("cut"), 1))


def lane_of(typology: Column) -> Column:
    """Owning lane of a typology; NULL for CLEAN."""
    out = F.lit(None).cast("string")
    for lane, (members, _, _) in live.LANES.items():
        out = F.when(typology.isin(members), F.lit(lane)).otherwise(out)
    return out


def queue_verb(lane: Column, tier: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, critical, standard) in live.LANES.items():
        verb = F.when(tier == "critical", F.lit(critical)).otherwise(F.lit(standard))
        out = F.when(lane == name, verb).otherwise(out)
    return out


def route(records: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Active typologies (strongest first), owning lane, lanes touched and verb."""
    cuts = thresholds.agg(
        F.map_from_entries(F.collect_list(F.struct("typology", "cut"))).alias("_cuts")
    )
    primary = F.col("primary_typology")
    active = F.filter(
        F.map_entries("typology_scores"),
        lambda e: (e["key"] == primary) | (e["value"] > F.element_at("_cuts", e["key"])),
    )
    places = F.array(*[F.lit(t) for t in live.TYPOLOGIES])
    ordered = F.transform(
        F.sort_array(
            F.transform(
                active,
                lambda e: F.struct(
                    (-e["value"]).alias("neg"), F.array_position(places, e["key"]).alias("place"),
                    e["key"].alias("typology"),
                ),
            )
        ),
        lambda s: s["typology"],
    )
    none = F.array().cast("array<string>")
    touched = F.filter(
        F.array(*[F.lit(lane) for lane in live.LANES]),
        lambda lane: F.exists("active_typologies", lambda t: lane_of(t) == lane),
    )
    return (
        records.crossJoin(F.broadcast(cuts))
        .withColumn("active_typologies", F.when(primary == "CLEAN", none).otherwise(ordered))
        .withColumn("lane", lane_of(primary))
        .withColumn("lanes_touched", touched)
        .withColumn("queue_verb", queue_verb(F.col("lane"), F.col("risk_tier")))
        .drop("_cuts")
    )


# --------------------------------------------------------------------- marts
def portfolio_totals(records: DataFrame) -> DataFrame:
    """Counts by tier, volume and at-risk exposure. Expects ``exposure``."""
    governed = F.col("risk_tier").isin(GOVERNED)
    watch = ~governed & (F.col("risk_tier") != "clear")
    zero = F.lit(0.0)
    gov = F.sum(F.when(governed, F.col("exposure")).otherwise(zero))
    wat = F.sum(F.when(watch, F.col("exposure")).otherwise(zero))
    return records.agg(
        F.count("*").alias("merchants_monitored"),
        F.sum("txn_count").alias("approved_transactions"),
        round_half_up(F.sum("total_volume"), 0).alias("total_volume"),
        *[F.count_if(F.col("risk_tier") == t).alias(f"tier_{t}") for t in TIERS],
        gov.alias("governed_exposure"),
        wat.alias("watch_exposure"),
        (gov + wat).alias("total_at_risk_exposure"),
        round_half_up(ratio0(gov, gov + wat), 4).alias("governed_share"),
        F.count_if(watch).alias("watch_merchants"),
    )


def _governed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("risk_tier").isin(GOVERNED))


def typology_summary(records: DataFrame) -> DataFrame:
    """Alerts, exposure, mean confidence and top merchant per typology."""
    spine = records.sparkSession.createDataFrame([(t,) for t in live.TYPOLOGIES], "typology string")
    own = F.element_at("typology_scores", F.col("primary_typology"))
    grouped = (
        _governed(records)
        .filter(F.col("primary_typology") != "CLEAN")
        .groupBy(F.col("primary_typology").alias("typology"))
        .agg(
            F.count("*").alias("alerts"),
            F.sum("exposure").alias("exposure"),
            (F.avg(own) / 100).alias("mean_confidence"),
            F.min(F.struct((-F.col("final_risk_score")).alias("k"), F.col(M)))[M].alias(
                "top_merchant_id"
            ),
        )
    )
    return (
        spine.join(grouped, "typology", "left")
        .na.fill(0, ["alerts"])
        .na.fill(0.0, ["exposure", "mean_confidence"])
    )


def lane_summary(records: DataFrame, daily: DataFrame) -> DataFrame:
    """Merchants, critical ones, exposure and volume trend per lane.

    ``daily`` is the (merchant, day) volume with ``second_half`` marking the later
    half of the window.
    """
    spine = records.sparkSession.createDataFrame([(x,) for x in live.LANES], "lane string")
    routed = _governed(records).withColumn("lane", lane_of(F.col("primary_typology")))
    sizes = routed.filter(F.col("lane").isNotNull()).groupBy("lane").agg(
        F.count("*").alias("merchants"),
        F.count_if(F.col("risk_tier") == "critical").alias("critical"),
        F.sum("exposure").alias("exposure"),
    )
    zero = F.lit(0.0)
    halves = (
        daily.join(routed.select(M, "lane"), M)
        .filter(F.col("lane").isNotNull())
        .groupBy("lane")
        .agg(
            F.sum(F.when(~F.col("second_half"), F.col("volume")).otherwise(zero)).alias("_first"),
            F.sum(F.when(F.col("second_half"), F.col("volume")).otherwise(zero)).alias("_second"),
        )
    )
    trend = F.when(
        F.col("_first") > 0,
        round_half_up((F.col("_second") - F.col("_first")) / F.col("_first") * 100, 1),
    ).otherwise(zero)
    return (
        spine.join(sizes, "lane", "left")
        .join(halves, "lane", "left")
        .na.fill(0, ["merchants", "critical"])
        .na.fill(0.0, ["exposure", "_first", "_second"])
        .withColumn("trend_pct", trend)
        .drop("_first", "_second")
    )


def data_window(tx: DataFrame) -> tuple[Column, int]:
    """First day and number of days that the transactions span (one row is fetched)."""
    day = F.to_date("event_ts")
    first, days = tx.agg(F.min(day).cast("string"), F.date_diff(F.max(day), F.min(day)) + 1).first()
    return F.lit(first or "1970-01-01").cast("timestamp_ntz"), days or 0


def daily_volume(tx: DataFrame, start: Column, days: int) -> DataFrame:
    """Positive volume per (merchant, day index) inside the window.

    The only pass over the fact; everything after works on this reduced table.
    ``start`` is a timestamp expression.
    """
    us = F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    day_us = 86_400_000_000
    rows = tx.filter(F.col("amount") > 0).select(
        M, "amount", us.alias("_us"), F.floor(us / day_us).alias("day")
    )
    inside = rows.filter((F.col("day") >= 0) & (F.col("day") < days))
    half = F.col("_us") >= F.lit(days * day_us // 2)
    return inside.groupBy(M, "day", half.alias("second_half")).agg(F.sum("amount").alias("volume"))


def daily_trend(daily: DataFrame, records: DataFrame, start: Column, days: int) -> DataFrame:
    """Volume, flagged volume and volume-weighted risk, all days present."""
    spark = daily.sparkSession
    risk = records.select(
        M, "final_risk_score", F.col("risk_tier").isin(GOVERNED).alias("_governed")
    )
    grouped = (
        daily.join(risk, M, "left")
        .groupBy("day")
        .agg(
            F.sum("volume").alias("volume"),
            F.coalesce(F.sum(F.when(F.col("_governed"), F.col("volume"))), F.lit(0.0)).alias(
                "flagged_volume"
            ),
            F.sum(F.col("volume") * F.coalesce("final_risk_score", F.lit(0.0))).alias("_weighted"),
        )
    )
    spine = spark.range(0, days).withColumnRenamed("id", "day")
    return (
        spine.join(grouped, "day", "left")
        .na.fill(0.0)
        .select(
            "day",
            F.date_add(start.cast("date"), F.col("day").cast("int")).alias("date"),
            round_half_up(F.col("volume"), 0).alias("volume"),
            round_half_up(F.col("flagged_volume"), 0).alias("flagged_volume"),
            round_half_up(ratio0(F.col("_weighted"), F.col("volume")), 1).alias("risk_index"),
        )
    )


def geo_summary(records: DataFrame, col: str = "state") -> DataFrame:
    return records.groupBy(col).agg(
        F.count("*").alias("merchants"),
        F.count_if(F.col("risk_tier").isin(GOVERNED)).alias("high_risk"),
        round_half_up(F.sum("total_volume"), 0).alias("volume"),
    )


def score_histogram(records: DataFrame, score: str = "final_risk_score", buckets: int = 10) -> DataFrame:
    """Merchants per score bucket, empty buckets included."""
    width = 100 // buckets
    slot = F.least(F.lit(buckets - 1), F.floor(F.col(score) / width)).cast("long")
    spine = records.sparkSession.range(0, buckets).withColumnRenamed("id", "bucket")
    counts = records.groupBy(slot.alias("bucket")).agg(F.count("*").alias("merchants"))
    return spine.join(counts, "bucket", "left").na.fill(0, ["merchants"])
