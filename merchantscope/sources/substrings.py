"""Substring search by an index of trigrams with their positions.

A posting says that a text of a key has these (up to three) letters at this position. A
needle is found where its trigrams stand at matching distances in one text (told apart by
a 64-bit hash among the texts of a key): texts are not read again. Repeated rows change
nothing, a search counts distinct distances. The last two positions of a text give shorter grams, so that needles of one
or two letters are the beginnings of grams. Postings are stored in gram order, so
a search reads the row groups of its grams; a very frequent gram covers several files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3


def postings(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(gram, key, source, body, at) of every position of the lower-cased texts; NULL and "" have none."""
    named = F.array(*[F.struct(F.lit(c).alias("source"), F.lower(F.col(c).cast("string")).alias("text")) for c in cols])
    texts = df.select(F.col(key).alias("key"), F.inline(named)).filter(F.length("text") > 0)
    places = texts.select("key", "source", "text", F.xxhash64("text").alias("body"), F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return places.select(F.substring("text", F.col("at"), F.lit(GRAM)).alias("gram"), "key", "source", "body", "at")


def write_index(df: DataFrame, key: str, cols: list[str], path: str) -> None:
    """Store the postings in gram order; ranges of (gram, key) let several files share a frequent gram."""
    made = postings(df, key, cols)
    made.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class SubstringIndex:
    """Postings below ``path`` of texts whose key has the given type."""

    spark: SparkSession
    path: str
    key_type: T.DataType

    @property
    def rows(self) -> DataFrame:
        fields = [("gram", T.StringType()), ("key", self.key_type), ("source", T.StringType()), ("body", T.LongType()), ("at", T.IntegerType())]
        return self.spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).parquet(self.path)

    def find(self, needle: str) -> DataFrame:
        """Distinct keys that have a text with the needle in it; a blank needle is refused, every text has it."""
        needle = needle.strip().lower()
        if not needle:
            raise ValueError("a blank needle is no search")
        if len(needle) < GRAM:
            return self.rows.filter(F.col("gram").startswith(needle)).select("key").distinct()
        offsets = cover(len(needle))
        grams: dict[str, list[int]] = {}
        for o in offsets:
            grams.setdefault(needle[o : o + GRAM], []).append(o)
        here = self.rows.filter(F.col("gram").isin(list(grams)))
        if len(offsets) == 1:
            return here.select("key").distinct()
        shift = F.create_map(*[x for g, os in grams.items() for x in (F.lit(g), F.array(*[F.lit(o) for o in os]))])
        starts = here.select("key", "source", "body", "at", F.explode(shift[F.col("gram")]).alias("o"))
        whole = starts.groupBy("key", "source", "body", (F.col("at") - F.col("o")).alias("start")).agg(F.count_distinct("o").alias("n"))
        return whole.filter(F.col("n") == len(offsets)).select("key").distinct()

    def find_all(self, needles: DataFrame) -> DataFrame:
        """(needle, key) for a table of needles, all at once; blank and NULL needles find nothing."""
        asked = needles.select("needle", F.lower(F.trim("needle")).alias("_n")).distinct().filter(F.length("_n") > 0)
        wide = asked.filter(F.length("_n") >= GRAM)
        last = F.length("_n") - GRAM
        steps = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
        parts = wide.select("needle", F.size(steps).alias("_parts"), "_n", F.explode(steps).alias("o")).select(
            "needle", "_parts", "o", F.substring("_n", F.col("o") + 1, F.lit(GRAM)).alias("gram")
        )
        place = ["needle", "_parts", "key", "source", "body", (F.col("at") - F.col("o")).alias("start")]
        starts = self.rows.join(parts, "gram").groupBy(*place).agg(F.count_distinct("o").alias("n"))
        long_ = starts.filter(F.col("n") == F.col("_parts")).select("needle", "key")
        short = asked.filter(F.length("_n") < GRAM).select("needle", F.col("_n").alias("head"))
        heads = F.array_distinct(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2)))
        begun = self.rows.select("gram").distinct().select("gram", F.explode(heads).alias("head")).join(short, "head").select("needle", "gram")
        return long_.unionByName(self.rows.join(begun, "gram").select("needle", "key")).distinct()


def cover(length: int) -> list[int]:
    """Offsets of trigrams that cover a needle of three letters or more."""
    return sorted({*range(0, length - GRAM + 1, GRAM), length - GRAM})


def indexed_search(index: SubstringIndex, merchants: DataFrame, key: str, text: str, order: str, k: int = 8, when_blank: Column | None = None) -> DataFrame:
    """``overview.entity_search`` with the index in place of the scan of names."""
    if not text.strip():
        hit = merchants.filter(when_blank if when_blank is not None else F.lit(True))
    else:
        hit = merchants.join(index.find(text).withColumnRenamed("key", key), key, "left_semi")
    return hit.orderBy(F.desc(order), key).limit(k)
