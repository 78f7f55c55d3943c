"""Bursts of a card as session windows over a stream of transactions.

A session ends when the watermark passes its last row by more than the burst gap; then
its moments are written and its state is dropped, so the state holds open sessions only.
The moments have the columns of the batch form's slices: numbering a card's bursts and
measuring the idle time between them is the same window over the (few) finished sessions.
Rows later than the watermark are dropped and counted.

A heartbeat - a row without card - moves the clock of a quiet source. Rows without card
never belong to a burst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope import reference as ref
from merchantscope.operators import features as ft
from merchantscope.streaming.sinks import RunSummary, overwrite_batch, read_batches, run_available

M = "merchant_id"
TIME = "transaction_datetime_utc"


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, oldest first; ``files`` of them a batch (None: all)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def sessions(events: DataFrame, delay: str, gap_seconds: int = ref.BURST_GAP_SECONDS) -> DataFrame:
    """Moments of each run of a card's rows with gaps <= gap_seconds; works on streams and tables.

    Sessions that touch are one, so a gap of exactly ``gap_seconds`` does not end a run.
    """
    timed = ft.with_flags(events, "abs_amt", "is_near_ceiling").withColumn("_ts", F.col(TIME).cast("timestamp"))
    us = F.unix_micros("_ts")
    # rows without card have no session; a filter on cards alone would run before the watermark sees them
    gap = F.when(F.col("card_token_id").isNotNull(), f"{gap_seconds} seconds").otherwise("0 seconds")
    return (
        timed.withWatermark("_ts", delay)
        .groupBy(M, "card_token_id", F.session_window("_ts", gap).alias("_window"))
        .agg(
            F.count("*").alias("n"),
            F.sum("abs_amt").alias("amt"),
            F.sum(F.col("abs_amt") * F.col("abs_amt")).alias("amt_sq"),
            F.sum("is_near_ceiling").alias("near"),
            F.min(us).alias("first_us"),
            F.max(us).alias("last_us"),
        )
        .drop("_window")
    )


def run_sessions(events: DataFrame, out: str, checkpoint: str, delay: str, gap_seconds: int = ref.BURST_GAP_SECONDS) -> RunSummary:
    """Write the sessions that what has arrived finishes below ``out``, a partition per batch."""
    return run_available(sessions(events, delay, gap_seconds), lambda df, n: overwrite_batch(df, out, n), checkpoint)


def finished_bursts(spark: SparkSession, out: str, event_schema: T.StructType, gap_seconds: int = ref.BURST_GAP_SECONDS) -> DataFrame:
    """Bursts of the sessions written so far, as the batch form gives them."""
    kinds = {f.name: f.dataType.simpleString() for f in event_schema.fields}
    schema = spark.createDataFrame(
        [], f"{M} {kinds[M]}, card_token_id {kinds['card_token_id']}, n long, amt double, amt_sq double, near long, first_us long, last_us long"
    ).schema
    return ft.bursts(read_batches(spark, out, schema).withColumn("slice", F.col("first_us")), gap_seconds)


def heartbeat(spark: SparkSession, schema: T.StructType, at: str) -> DataFrame:
    """One row without card at a time ``at``."""
    stamp = F.to_timestamp_ntz(F.lit(at))
    return spark.range(1).select(*[(stamp if f.name == TIME else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
