"""Exports: Parquet (zstd), CSV, JSON, Markdown, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with RFC quoting. Ordered input keeps its order across the part files."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def rounded(df: DataFrame, dp: int = 2) -> DataFrame:
    """Doubles rounded; NaN and infinities become NULL."""
    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            return F.when(~bad, F.round(c, dp)).alias(f.name)
        return c

    return df.select(*[clean(f) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, dp: int = 2) -> None:
    rounded(df, dp).write.mode("overwrite").json(path)


def document(sections: dict[str, DataFrame]) -> DataFrame:
    """One row holding each (small, already reduced) section as an array of structs.

    Meant for report tables whose size is fixed by the report: tiers, families,
    months, a top-k queue.
    """
    out = None
    for name, df in sections.items():
        part = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = part if out is None else out.crossJoin(part)
    return out


def write_document(sections: dict[str, DataFrame], path: str) -> None:
    document(sections).write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Rows as Markdown table lines in a single text column."""
    cells = [
        F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\|", r"\\|"), F.lit(""))
        for c in df.columns
    ]
    return df.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    )


def markdown_header(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]


def write_markdown(df: DataFrame, path: str) -> None:
    """Markdown table; the header lines lead the first part file."""
    spark = df.sparkSession
    head = spark.createDataFrame([(line,) for line in markdown_header(df)], "value string")
    head.coalesce(1).unionByName(markdown_rows(df)).write.mode("overwrite").text(path)
