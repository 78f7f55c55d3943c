"""A sink that a replayed batch cannot change, and runs that take what is there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch as its own partition; a second run of the batch replaces the first one."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written below ``path``; none yet give an empty frame."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


@dataclass(frozen=True)
class RunSummary:
    """What a run did: its batches, the rows it read, and the rows dropped as too late."""

    batches: int
    rows: int
    dropped: int


def watch(query: StreamingQuery, every: float = 0.2) -> RunSummary:
    """Wait for a query to end, noting the progress of each batch while it is still kept."""
    seen: dict[int, tuple[int, int]] = {}
    ended = False
    while not ended:
        ended = bool(query.awaitTermination(every))
        for p in query.recentProgress:
            late = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
            # an idle trigger reports the last batch's number once more, without rows
            rows, dropped = seen.get(p["batchId"], (0, 0))
            seen[p["batchId"]] = (max(rows, p["numInputRows"]), max(dropped, late))
    return RunSummary(len(seen), sum(n for n, _ in seen.values()), sum(late for _, late in seen.values()))


def run_available(result: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> RunSummary:
    """Process what the sources hold now, in append mode, and stop; the next run goes on from there."""
    query = (
        result.writeStream.outputMode("append").foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    return watch(query)
