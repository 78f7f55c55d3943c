"""Rules on the features of a merchant's time windows, fired when a window closes.

The features are the grouped pass of the live engine with the window as a second key; the
rules are the same data. Hits are written by ``foreachBatch`` into one partition per
batch, so replaying a batch replaces its hits and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope import live_reference as live
from merchantscope.operators import live_features as lf, live_rules as lr
from merchantscope.streaming.sinks import RunSummary, overwrite_batch, read_batches, run_available

M = "merchant_id"


def windowed_features(tx: DataFrame, window: str, delay: str | None = None) -> DataFrame:
    """Base features per merchant and tumbling window; of a stream once the watermark passes its end."""
    timed = tx.withWatermark("event_ts", delay) if delay else tx
    made = lf.base_features(lf.approved(timed), [F.window("event_ts", window).alias("_window")])
    return made.withColumn("window_start", F.col("_window.start")).drop("_window")


def window_hits(features: DataFrame, merchants: DataFrame, rules: list[live.Rule] = live.DEFAULT_RULES) -> DataFrame:
    """One row per merchant, window and rule that holds; rules on features a window lacks never do."""
    declared = features.join(merchants.select(M, "declared_mcc"), M, "left")
    return lr.evaluate_rules(declared, rules).select(M, "window_start", F.inline("rule_hits"))


def run_rules(
    tx: DataFrame, merchants: DataFrame, out: str, checkpoint: str, window: str, delay: str,
    rules: list[live.Rule] = live.DEFAULT_RULES,
) -> RunSummary:
    """Write the hits of the windows that what has arrived closes below ``out``."""
    closed = windowed_features(tx, window, delay)
    return run_available(closed, lambda df, n: write_hits(df, merchants, out, n, rules), checkpoint)


def write_hits(features: DataFrame, merchants: DataFrame, out: str, batch_id: int, rules: list[live.Rule] = live.DEFAULT_RULES) -> None:
    """The body of a batch: safe to run again with the same batch."""
    overwrite_batch(window_hits(features, merchants, rules), out, batch_id)


def read_hits(spark: SparkSession, out: str, like: T.StructType) -> DataFrame:
    """All hits written so far; ``like``: the schema that ``window_hits`` gives."""
    return read_batches(spark, out, like)
