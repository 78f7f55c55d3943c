"""Exact ranks, percentiles and prefix counts without a one-task global sort.

A window over a whole table, or over one very large key, sorts everything in a
single task. These operators avoid that. Rows are first reduced to distinct
values with counts (map-side combined), values fall into order-preserving
buckets, bucket totals are summed up per key (few rows), and only then are values
ordered *inside* a bucket. Every task sees one bucket of one key, and the results
are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per power of two. 256 gives a relative bucket width of 0.27 %.
BUCKETS_PER_OCTAVE = 256


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Order-preserving bucket number of a double, logarithmic on both sides of 0."""
    magnitude = F.floor(F.log2(F.abs(value)) * F.lit(per_octave)) + F.lit(1100 * per_octave)
    return (
        F.when(value > 0, magnitude)
        .when(value < 0, -magnitude)
        .otherwise(F.lit(0))
        .cast("long")
    )


def value_counts(df: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Distinct non-null values per key with their number of rows."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(n))


def prefix_counts(
    counts: DataFrame, keys: list[str], value: str, sums: list[str]
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_total`` per key.

    ``counts`` holds one row per (keys, value) with the numeric columns ``sums``.
    """
    bucketed = counts.withColumn("_b", order_bucket(F.col(value)))
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_{s}_in") for s in sums])
    by_key = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    running = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_{s}_in").over(running), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}_in").over(by_key).alias(f"{s}_total") for s in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = bucketed.join(totals, [*keys, "_b"])
    return joined.select(
        *counts.columns,
        *[
            (F.col(f"_{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
    )


def order_statistics(
    counts: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    n: str = "n",
    bucket: Column | None = None,
) -> DataFrame:
    """Exact values at given 0-based ranks per key, from distinct values with counts.

    Each entry of ``ranks`` maps the key's row count to a rank. Only buckets that
    hold a wanted rank are ordered; the rest stop at their totals. ``bucket``
    replaces the logarithmic bucket where another one spreads the values better
    (hours for timestamps); it must not decrease with the value. ``counts`` is read
    twice: hand in a stored table where it comes from a large scan.
    """
    slot = bucket if bucket is not None else order_bucket(F.col(value))
    bucketed = counts.filter(F.col(n) > 0).withColumn("_b", slot)
    by_key = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    running = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.sum(n).alias("_in"))
        .select(
            *keys,
            "_b",
            "_in",
            F.coalesce(F.sum("_in").over(running), F.lit(0)).alias("_off"),
            F.sum("_in").over(by_key).alias("_total"),
        )
    )
    wanted = {name: rank(F.col("_total")).cast("long") for name, rank in ranks.items()}
    holds = F.lit(False)
    for r in wanted.values():
        holds = holds | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_in")))
    needed = totals.filter(holds).drop("_in")

    inside = (
        Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_off") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    ranked = bucketed.join(needed, [*keys, "_b"]).withColumn("_first", first)
    found = [
        F.max(
            F.when((r >= F.col("_first")) & (r < F.col("_first") + F.col(n)), F.col(value))
        ).alias(name)
        for name, r in wanted.items()
    ]
    return ranked.groupBy(*keys).agg(*found, F.max("_total").alias("_total"))


def exact_percentiles(
    counts: DataFrame,
    keys: list[str],
    value: str,
    linear: dict[str, float] | None = None,
    n: str = "n",
    floor: dict[str, float] | None = None,
) -> DataFrame:
    """Exact percentiles per key from distinct values with counts.

    ``linear`` ones interpolate between the two neighbouring ranks; ``floor`` ones
    take the element at index floor(p*(N-1)).
    """
    linear, floor = linear or {}, floor or {}

    def position(p: float, total: Column) -> Column:
        return F.lit(float(p)) * (total - 1)

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in linear.items():
        ranks[f"_lo_{name}"] = lambda t, p=p: F.floor(position(p, t))
        ranks[f"_hi_{name}"] = lambda t, p=p: F.ceil(position(p, t))
    for name, p in floor.items():
        ranks[name] = lambda t, p=p: F.floor(position(p, t))
    stats = order_statistics(counts, keys, value, ranks, n)
    return stats.select(*keys, *[_between(name, p) for name, p in linear.items()], *floor)


def _between(name: str, p: float) -> Column:
    """Linear percentile from the values at its two neighbouring ranks."""
    pos = F.lit(float(p)) * (F.col("_total") - 1)
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return (low + (pos - F.floor(pos)) * (high - low)).alias(name)


def small_key_percentiles(
    counts: DataFrame, keys: list[str], value: str, linear: dict[str, float], n: str = "n", distinct: str = "distinct"
) -> DataFrame:
    """Linear percentiles of ``exact_percentiles`` and the number of distinct values, ordering a key in one task.

    For keys known to be small. Needs no exchange where the rows of a key lie together
    and reads ``counts`` once. Values of no rows (``n`` = 0) count as distinct ones.
    """
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_first", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(
        "_all", F.sum(n).over(by_key)
    )
    found = []
    for name, p in linear.items():
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col(n))
            found.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
    stats = ranked.groupBy(*keys).agg(F.count("*").alias(distinct), F.max("_all").alias("_total"), *found)
    return stats.select(*keys, distinct, *[_between(name, p) for name, p in linear.items()])


def average_rank_percent(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Add the average-rank percentile in (0, 1]: (mean rank of the tie)/N.

    Rows without a value get NULL, as they hold no rank.
    """
    keys = keys or []
    ranks = prefix_counts(value_counts(df, keys, value, "_n"), keys, value, ["_n"]).select(
        *keys,
        value,
        ((F.col("_n_before") + (F.col("_n") + 1) / 2.0) / F.col("_n_total")).alias(out),
    )
    return df.join(ranks, [*keys, value], "left")


def ordinal_rank(
    df: DataFrame, value: str, tiebreak: str, out: str, descending: bool = False
) -> DataFrame:
    """Add the 0-based position in the order (value, tiebreak) and ``<out>_total``.

    ``tiebreak`` must be unique. A numeric tiebreak is ordered as a number; a
    string one by (hash bucket, string), which is just as fixed and spreads ids
    with a common prefix evenly. A tie of any size is therefore split as well.
    """
    key = -F.col(value) if descending else F.col(value)
    keyed = df.withColumn("_v", key.cast("double")).withColumn(
        "_tb",
        F.shiftrightunsigned(F.xxhash64(tiebreak), 48)
        if df.schema[tiebreak].dataType.typeName() == "string"
        else order_bucket(F.col(tiebreak).cast("double")),
    )
    offsets = prefix_counts(value_counts(keyed, [], "_v", "_n"), [], "_v", ["_n"]).select(
        "_v", "_n_before", "_n_total"
    )
    running = Window.partitionBy("_v").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        keyed.groupBy("_v", "_tb")
        .agg(F.count("*").alias("_c"))
        .withColumn("_o", F.coalesce(F.sum("_c").over(running), F.lit(0)))
        .join(offsets, "_v")
        .withColumn("_o", F.col("_o") + F.col("_n_before"))
        .select("_v", "_tb", "_o", "_n_total")
    )
    inside = Window.partitionBy("_v", "_tb").orderBy(tiebreak)
    return (
        keyed.join(pieces, ["_v", "_tb"])
        .withColumn(out, F.col("_o") + F.row_number().over(inside) - 1)
        .withColumn(f"{out}_total", F.col("_n_total"))
        .drop("_v", "_tb", "_o", "_n_total")
    )
