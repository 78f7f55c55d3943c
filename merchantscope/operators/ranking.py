"""Top-k per key, best row per group and fixed samples, safe for very large keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces a key is cut into before its last ranking step.
KEY_PIECES = 64
#: Column of the piece, and the piece of a key that is not cut: its rows lie together.
PIECE, WHOLE = "_piece", -1


def in_pieces(df: DataFrame, spread: list[str]) -> DataFrame:
    """Rows with the piece (``_piece``) of their key that they belong to."""
    return df.withColumn("_piece", F.pmod(F.xxhash64(*spread), F.lit(KEY_PIECES)).cast("int"))


def join_in_pieces(df: DataFrame, small: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Inner join on key and piece, ``small`` repeated for every piece.

    A join on the key alone would bring a large key to one task, and what ranks its
    pieces afterwards would find the rows already there. ``_piece`` stays for that. Rows
    that come with a piece (a bucketed table) are joined as they lie, whole keys included.
    """
    every = small.withColumn("_piece", F.explode(F.sequence(F.lit(WHOLE), F.lit(KEY_PIECES - 1))))
    return (df if "_piece" in df.columns else in_pieces(df, spread)).join(every, [*keys, "_piece"])


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    limit: int,
    spread: list[str],
    cap: Column | None = None,
    rank_col: str | None = None,
    whole: Column | None = None,
) -> DataFrame:
    """First ``limit`` rows of each key in the given order.

    Rows are first ranked inside (key, hash piece) and cut there; Spark also cuts
    before that shuffle, because the limit is a literal. At most
    ``KEY_PIECES * limit`` rows of a key then meet in one task, however many rows
    the key has. ``cap`` is an optional smaller per-row limit. ``spread`` names the
    columns that decide the piece (unless ``join_in_pieces`` has dealt the rows).
    ``whole`` tells the pieces that hold all rows of their key: their first rank is the last.
    """
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    pieces = (
        (df if "_piece" in df.columns else in_pieces(df, spread))
        .withColumn("_rn", F.row_number().over(local))
        .filter(F.col("_rn") <= limit)
    )
    survivors = (pieces if whole is None else pieces.filter(~whole)).drop("_rn", "_piece")
    ranked = survivors.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= limit)
    if whole is not None:
        ranked = pieces.filter(whole).drop("_piece").unionByName(ranked)
    if cap is not None:
        ranked = ranked.filter(F.col("_rn") <= cap)
    return ranked.withColumnRenamed("_rn", rank_col) if rank_col else ranked.drop("_rn")


def best_per_group(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """One row per group: the smallest by ``order`` (a grouped minimum, no sort)."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)])
    row = F.struct(*df.columns)
    return df.groupBy(F.col(group).alias("_g")).agg(F.min_by(row, keys).alias("_row")).select("_row.*")


def fixed_sample(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """A sample of ``size`` rows that is the same in every run (hash order)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.orderBy(order, id_col).limit(size)
