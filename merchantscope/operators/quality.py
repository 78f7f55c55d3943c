"""Data-quality gates: violation counts in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARD_TOKEN = r"^C-\d{6}$"
PAN = r"\d{13,19}"


def token_violations(card: Column) -> Column:
    return F.count_if(~F.coalesce(card.rlike(CARD_TOKEN), F.lit(False)))


def pan_violations(card: Column) -> Column:
    return F.count_if(F.coalesce(card.rlike(PAN), F.lit(False)))


def transaction_checks(tx: DataFrame, card: str = "card_id", amount: str = "amount") -> DataFrame:
    """Rows, malformed card tokens, card numbers in the clear, negative amounts."""
    return tx.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in transaction_gates(card, amount).items()])


def transaction_gates(card: str, amount: str) -> dict[str, Column]:
    """Violation counts of transactions by name, for a pass of its own or one that writes them."""
    token = F.col(card).cast("string")
    return {
        "bad_tokens": token_violations(token),
        "clear_pans": pan_violations(token),
        "negative_amounts": F.count_if(F.col(amount) < 0),
    }


def share_gates(cols: list[str], tolerance: float = 1e-9) -> dict[str, Column]:
    """Per share column: how many values lie outside [0, 1]."""
    return {c: F.count_if((F.col(c) < -tolerance) | (F.col(c) > 1 + tolerance)) for c in cols}


def gate_rows(spark: SparkSession, seen: dict[str, dict[str, int]]) -> DataFrame:
    """(table, gate, violations) of the gates that were counted while tables were written."""
    rows = [(t, g, n) for t, gates in seen.items() for g, n in gates.items() if g != "rows"]
    return spark.createDataFrame(rows, "table string, gate string, violations long")


def share_checks(features: DataFrame, cols: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per share column: values outside [0, 1]."""
    once = features.agg(*[n.alias(c) for c, n in share_gates(cols, tolerance).items()])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("violations")) for c in cols]
    )
    return once.select(F.inline(pairs))


def label_checks(labels: DataFrame, abuse: str, typology: str) -> DataFrame:
    """Missing labels and labels that contradict the typology."""
    clean = F.col(typology) == "CLEAN"
    return labels.agg(
        F.count_if(F.col(abuse).isNull()).alias("missing_labels"),
        F.count_if(F.col(abuse) == clean).alias("inconsistent_labels"),
    )


def missing_ids(df: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    """Required ids that the table lacks."""
    return required.select(id_col).distinct().join(df.select(id_col), id_col, "left_anti")


def row_bounds(df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Row count and whether it lies within the bounds."""
    n = F.count("*")
    inside = n >= low if high is None else (n >= low) & (n <= high)
    return df.agg(n.alias("rows"), inside.alias("within_bounds"))


def enum_checks(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Per column: values outside its allowed set."""
    once = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(values)).alias(c)
            for c, values in allowed.items()
        ]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in allowed]
    )
    return once.select(F.inline(pairs))
