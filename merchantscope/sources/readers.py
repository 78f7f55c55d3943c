"""Reading settlement data and dimensions with explicit schemas."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope import schemas
from merchantscope.sources import timeline

TEXT_COLUMNS = [
    "merchant_descriptor", "sub_merchant_id", "split_group_id", "chargeback_reason_code",
    "wallet_provider",
]


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read Parquet, CSV (plain or gzip, with header) or JSON lines with a schema.

    Parquet may hold more columns than the schema; only the named ones are read.
    """
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        return reader.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unknown format {fmt!r}")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_first_present(
    spark: SparkSession, folder: str, name: str, schema: T.StructType,
    formats: tuple[str, ...] = ("parquet", "csv", "csv.gz"),
) -> DataFrame:
    """Read ``name`` in the first format present in the folder."""
    for suffix in formats:
        path = f"{folder.rstrip('/')}/{name}.{suffix}"
        if exists(spark, path):
            return read_table(spark, path, schema, "csv" if suffix.startswith("csv") else suffix)
    raise FileNotFoundError(f"{folder}/{name}.({'|'.join(formats)})")


def normalise_missing(tx: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spellings of a missing text value become NULL (never "", "nan", ...)."""
    names = [c for c in (cols or TEXT_COLUMNS) if c in tx.columns]
    missing = ["", "nan", "None", "NaT"]
    return tx.withColumns({c: F.when(~F.col(c).isin(missing), F.col(c)) for c in names})


@dataclass(frozen=True)
class SettlementBook:
    """The input tables of one batch run."""

    transactions: DataFrame
    merchants: DataFrame
    dba: DataFrame
    corp: DataFrame
    acceptance: DataFrame
    #: the fact laid out by time, if it is
    timeline: timeline.Timeline | None = None

    @property
    def latest(self) -> dt.date | None:
        return self.timeline.latest if self.timeline else None


def lay_out_book(spark: SparkSession, folder: str) -> None:
    """Store a book's transactions by month and day; ``load_book`` then reads those."""
    tx = read_first_present(spark, folder, "raw_transactions", schemas.SETTLEMENT)
    timeline.write_timeline(tx, f"{folder}/raw_transactions.timeline")


def load_book(spark: SparkSession, folder: str) -> SettlementBook:
    """Transactions (laid out by time, else in the first format present) and the four dimension files."""
    def dim(name: str, schema: T.StructType) -> DataFrame:
        return read_table(spark, f"{folder}/{name}.csv", schema, "csv")

    laid_out = None
    if exists(spark, path := f"{folder.rstrip('/')}/raw_transactions.timeline"):
        laid_out = timeline.read_timeline(spark, path, schemas.SETTLEMENT)
        laid_out = timeline.Timeline(normalise_missing(laid_out.rows), laid_out.latest)
    return SettlementBook(
        laid_out.rows if laid_out else normalise_missing(read_first_present(spark, folder, "raw_transactions", schemas.SETTLEMENT)),
        dim("dim_merchant", schemas.MERCHANT_DIM),
        dim("dim_dba", schemas.DBA_DIM),
        dim("dim_corp", schemas.CORP_DIM),
        dim("dim_acceptance", schemas.ACCEPTANCE_DIM),
        laid_out,
    )
