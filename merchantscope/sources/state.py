"""State by key in hash slots: a change rewrites only the slots it alters.

Changes are log entries; of the entries of a key the newest stays. Entries that are no news
(a replayed batch, a late one) alter nothing, and slots without news keep their files.
A slot is a folder of several files, so no slot has to fit in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope.session import stage_table

SLOT = "slot"


def newest(log: DataFrame, key: list[str], age: list[str]) -> DataFrame:
    """The newest entry per key; ``age`` orders the entries of a key totally, NULL is oldest."""
    row = F.struct(*log.columns)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    return log.groupBy(*named).agg(F.max_by(row, F.struct(*age)).alias("_row")).select("_row.*")


@dataclass(frozen=True)
class KeyedState:
    """The newest entry of every key. ``slots`` belongs to the layout: a path keeps the number it began with."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    age: tuple[str, ...]
    slots: int = 64
    files_per_slot: int = 4

    def _root(self) -> tuple[str, bool]:
        """The folder of this layout and whether it holds rows."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        layouts = [n for n in names if n.startswith("slots=")]
        mine = f"slots={self.slots}"
        if layouts and layouts != [mine]:
            raise ValueError(f"{self.path} is laid out as {layouts}, not {mine}")
        return f"{self.path}/{mine}", bool(layouts)

    def _dealt(self) -> DataFrame:
        root, there = self._root()
        fields = T.StructType([*self.schema.fields, T.StructField(SLOT, T.IntegerType())])
        return self.spark.read.schema(fields).parquet(root) if there else self.spark.createDataFrame([], fields)

    def rows(self) -> DataFrame:
        return self._dealt().select(*self.schema.names)

    def upsert(self, changes: DataFrame) -> list[int]:
        """Take in log entries; the slots that were rewritten (at most ``slots`` numbers)."""
        key, age = list(self.key), list(self.age)
        slot = F.pmod(F.xxhash64(*key), F.lit(self.slots)).cast("int")
        latest = newest(changes.select(*self.schema.names), key, age).withColumn(SLOT, slot)
        incoming = stage_table(latest, "changes")
        met = [r[0] for r in incoming.select(SLOT).distinct().collect()]
        old = self._dealt().filter(F.col(SLOT).isin(met))
        before = old.select(SLOT, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*age).alias("_age"))
        same = incoming[SLOT] == before[SLOT]
        for i, k in enumerate(key):
            same = same & incoming[k].eqNullSafe(before[f"_k{i}"])
        stale = same & (before["_age"] >= F.struct(*[incoming[a] for a in age]))
        news = stage_table(incoming.join(before, stale, "left_anti"), "news")
        altered = sorted(r[0] for r in news.select(SLOT).distinct().collect())
        if altered:
            merged = newest(old.filter(F.col(SLOT).isin(altered)).unionByName(news), key, age)
            ready = stage_table(merged, "slots")  # whole before a folder is replaced
            piece = F.pmod(F.xxhash64(*key, F.lit("file")), F.lit(self.files_per_slot))
            spread = ready.withColumn("_piece", piece).repartition(SLOT, "_piece").drop("_piece")
            writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            writer.partitionBy(SLOT).parquet(self._root()[0])
        return altered
