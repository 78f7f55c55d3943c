"""The fact laid out by time: a folder per month, in it one per day.

Filters on time become lists of folders: a date range prunes when the query is planned, a
join with chosen months prunes when their table is known. The latest date is read off
the folder names, without a scan. A day is dealt over several files, so a busy day is no
single task; rows without a date have a folder of their own.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH, DAY = "txn_month", "txn_day"
_PARTS = T.StructType([T.StructField(MONTH, T.StringType()), T.StructField(DAY, T.IntegerType())])


def write_timeline(tx: DataFrame, path: str, files_per_day: int = 4, mode: str = "overwrite", date: str = "transaction_date") -> None:
    """Write ``tx`` below ``path``; days that ``tx`` does not hold keep their folders with ``mode`` "overwrite" too."""
    day = F.col(date)
    dealt = tx.withColumn(MONTH, F.date_format(day, "yyyy-MM")).withColumn(DAY, F.dayofmonth(day))
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_day))
    spread = dealt.withColumn("_piece", piece).repartition(MONTH, DAY, "_piece").drop("_piece")
    writer = spread.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH, DAY).parquet(path)


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the partition folders right below a path (their number is that of the months, or of a month's days)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    return sorted(m[1] for n in names if (m := re.fullmatch(rf"{key}=(\d[\d-]*)", n)))


def latest_date(spark: SparkSession, path: str) -> dt.date | None:
    """The last day that has rows, from the folder names."""
    months = _folders(spark, path, MONTH)
    if not months:
        return None
    days = _folders(spark, f"{path}/{MONTH}={months[-1]}", DAY)
    return dt.date.fromisoformat(f"{months[-1]}-{max(map(int, days)):02d}")


@dataclass(frozen=True)
class Timeline:
    """The rows of a laid-out fact (with its month and day) and its last day."""

    rows: DataFrame
    latest: dt.date | None

    def since(self, first: dt.date, date: str = "transaction_date") -> DataFrame:
        """Rows from a day on; months before it are not read."""
        return self.rows.filter(from_day(first) & (F.col(date) >= F.lit(first)))

    def recent(self, months: int, date: str = "transaction_date") -> DataFrame:
        """Rows later than ``months`` months before the last day."""
        cutoff = cutoff_date(self.latest, months)
        return self.rows.filter("false") if cutoff is None else self.since(cutoff + dt.timedelta(days=1), date)

    def of_months(self, months: DataFrame) -> DataFrame:
        """Rows of the months in a table with ``txn_month``; the others' folders are left out at run time."""
        return self.rows.join(F.broadcast(months.select(MONTH).distinct()), MONTH, "left_semi")


def from_day(first: dt.date) -> Column:
    """A predicate on the folders alone: their rows may be of ``first`` or later."""
    month = first.strftime("%Y-%m")
    return (F.col(MONTH) > month) | ((F.col(MONTH) == month) & (F.col(DAY) >= first.day))


def cutoff_date(latest: dt.date | None, months: int) -> dt.date | None:
    """``months`` months before, on the last day of a shorter month where the day is missing."""
    if latest is None:
        return None
    count = latest.year * 12 + latest.month - 1 - months
    first = dt.date(count // 12, count % 12 + 1, 1)
    following = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return first.replace(day=min(latest.day, (following - first).days))


def read_timeline(spark: SparkSession, path: str, schema: T.StructType) -> Timeline:
    """A laid-out fact with the columns of ``schema``."""
    columns = [f for f in schema.fields if f.name not in (MONTH, DAY)]
    rows = spark.read.schema(T.StructType([*columns, *_PARTS.fields])).parquet(path)
    return Timeline(rows, latest_date(spark, path))
