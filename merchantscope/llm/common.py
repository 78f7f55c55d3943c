"""What the corpus operators share: staged tables, Arrow row maps, hashed words.

Every operator picks the columns it needs by name first, so extra columns of the
input, whatever they are called, never meet the operator's own ones.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope.session import stage_table

__all__ = ["annotate", "chunks", "partitions_of", "stage_table", "table"]

#: Bytes of text that a task turns into arrays at a time (a longer text is one chunk).
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(texts: Iterable[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts (None counts as empty) in lists of about ``limit`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def annotate(
    df: DataFrame,
    text: str,
    fn: Callable[[list[bytes]], list[dict]],
    result: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows as they are (struct ``row``) with what ``fn`` says of their text (struct ``res``).

    ``fn`` gets the UTF-8 texts of a chunk and returns one dict for each. Row-local:
    no shuffle, memory bounded by one Arrow batch plus one chunk.
    """
    names = keep if keep is not None else df.columns
    columns = list(dict.fromkeys([*names, text]))
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.struct(F.lit(0)).alias("row"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    assert columns
    schema = T.StructType([packed.schema["row"], T.StructField("res", result)])
    kind = arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(x.as_py() for x in batch.column(1)):
                rows = batch.column(0).slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([rows, pa.array(fn(part), kind)], names=["row", "res"])

    return packed.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow type of the few Spark types that results use."""
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32(),
    }[kind.simpleString()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


def numbered(df: DataFrame, order: list, out: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Rows with their position (from 0) in a total order, and sums over the rows before.

    Ranges of the order are ordered in a task each; only their totals (one row per
    partition) pass one task. ``sums`` maps new names to integer columns.
    """
    ranged = df.repartitionByRange(partitions_of(df.sparkSession), *order)
    parts = stage_table(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sums or {}
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{o}") for o, c in [(out, "_n"), *[(o, f"_t_{o}") for o in sums]]],
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.row_number().over(inside) - 1 + F.col(f"_o_{out}")).alias(out)]
    added += [(F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"_o_{o}")).alias(o) for o, c in sums.items()]
    return parts.join(offsets, "_part").select(*df.columns, *added)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that nothing refers to any more.

    They go when the driver's JVM collects its garbage, which a large heap may put off
    until the next large shuffle stands beside the last one.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
