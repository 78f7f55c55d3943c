"""The explorer's fact, bucketed and sorted by merchant and piece.

A crowded merchant's rows lie in ``KEY_PIECES`` pieces, so that it is many buckets; an ordinary
one's lie together, in the piece ``WHOLE``. What joins or ranks by (merchant, piece) reads the
table as it lies: the fact is not exchanged again, however often merchants are picked from it,
and a rank inside ``WHOLE`` is the merchant's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope.operators.ranking import PIECE, WHOLE, in_pieces

M = "merchant_id"


def write_bucketed(
    tx: DataFrame, table: str, path: str, spread: list[str], buckets: int, crowded: DataFrame | None
) -> DataFrame:
    """Store ``tx`` as a table of ``buckets`` files, one a bucket; ``spread`` decides a row's piece.

    ``crowded`` are the merchants that are cut into pieces (None: there are none), the missing
    id among them. The rows are dealt once, by the hash that bucketing uses. The number of
    buckets is to grow with the fact: a bucket is read by one task.
    """
    if crowded is None:
        pieced = tx.withColumn(PIECE, F.lit(WHOLE))
    else:
        many = crowded.select(F.col(M).alias("_crowded"), F.lit(True).alias("_many"))
        found = in_pieces(tx, spread).join(F.broadcast(many), F.col(M).eqNullSafe(F.col("_crowded")), "left")
        pieced = found.withColumn(PIECE, F.when(F.col("_many"), F.col(PIECE)).otherwise(F.lit(WHOLE)))
    # Texts of any length come last: what stands before them is then alike from row to row,
    # and an exchange compresses it better.
    texts = [f.name for f in tx.schema.fields if f.dataType.typeName() == "string"]
    flags = [c for c in texts if c.endswith(("_flag", "_code", "_mode"))]
    compact = [c for c in tx.columns if c not in texts] + flags + [c for c in texts if c not in flags]
    dealt = pieced.select(PIECE, *compact).repartition(buckets, M, PIECE).select(*tx.columns, PIECE)
    writer = dealt.write.mode("overwrite").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, M, PIECE).sortBy(M, PIECE).saveAsTable(table)
    return read_bucketed(tx.sparkSession, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
