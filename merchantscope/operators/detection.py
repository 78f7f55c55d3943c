"""Detection models: elevated signals and a merchant's place among its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.operators.ordering import prefix_counts

M = "merchant_id"
EVERYONE = "*"


def elevated_signals(
    models: dict[str, dict[str, list[str]]] = ref.DETECTION_MODELS,
    thresholds: dict[str, float] = ref.SIGNAL_THRESHOLDS,
    columns: list[str] | None = None,
) -> Column:
    """How many signals of the merchant's own model reach their threshold.

    Signals the table lacks count as not elevated. NULL where no model applies.
    """
    out = F.lit(None).cast("int")
    for family, by_category in models.items():
        for category, signals in by_category.items():
            known = [s for s in signals if columns is None or s in columns]
            hits = sum(
                (
                    F.when(F.col(s) >= thresholds[s], 1).otherwise(0)
                    for s in known
                ),
                F.lit(0),
            )
            out = F.when(
                (F.col("family") == family) & (F.col("top_category") == category), hits
            ).otherwise(out)
    return out


def with_elevated_signals(merchants: DataFrame, **kw) -> DataFrame:
    return merchants.withColumn(
        "elevated_signals", elevated_signals(columns=merchants.columns, **kw)
    )


#: Detection model of each kind of surcharge violation.
SURCHARGE_MODELS = {
    "Over-cap": "surcharge_over_cap",
    "Regional ban": "surcharge_prohibited",
    "Prohibited debit/prepaid": "surcharge_prohibited",
    "Undisclosed": "surcharge_undisclosed",
}


def surcharge_records(scores: DataFrame, violating: DataFrame) -> DataFrame:
    """Score rows of merchants in violation, under the surcharge family and their model.

    A merchant keeps its own row under its own family; this adds one for the surcharge
    models, with the surcharge inputs beside the score columns.
    """
    model = F.lit(None).cast("string")
    for kind, name in SURCHARGE_MODELS.items():
        model = F.when(F.col("violation") == kind, F.lit(name)).otherwise(model)
    found = violating.select(M, "surcharge_rate_bps", "pct_txn_surcharged", F.lit("surcharge").alias("family"), model.alias("top_category"))
    new = [c for c in found.columns if c != M]
    return scores.drop(*new).join(found.filter("top_category IS NOT NULL"), M)


def _long(merchants: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals]
    )
    return merchants.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def with_peer_population(
    merchants: DataFrame, group: str = "mcc_group", min_peers: int = ref.PEER_MIN
) -> DataFrame:
    """Add ``population``: clean peers, else the group, else everyone.

    ``label`` = 'clean' marks clean merchants. The value is the group's name with
    its kind, or "*" for everyone.
    """
    sizes = merchants.groupBy(group).agg(
        F.count("*").alias("_all"), F.count_if(F.col("label") == "clean").alias("_clean")
    )
    kind = (
        F.when(F.col("_clean") >= min_peers, F.lit("clean"))
        .when(F.col("_all") >= min_peers, F.lit("group"))
        .otherwise(F.lit("everyone"))
    )
    return (
        merchants.join(sizes, group, "left")
        .withColumn("peer_kind", kind)
        .withColumn(
            "population",
            F.when(F.col("peer_kind") == "everyone", F.lit(EVERYONE)).otherwise(F.col(group)),
        )
        .drop("_all", "_clean")
    )


def _memberships(placed: DataFrame, signals: list[str]) -> DataFrame:
    """(population, signal, value, weight): peers weigh 1, bystanders 0.

    Bystanders are listed so that their value gets a position among the peers.
    """
    rows = _long(placed, signals, ["population", "peer_kind", "label"])
    is_peer = F.when(F.col("peer_kind") == "clean", F.col("label") == "clean").otherwise(
        F.col("peer_kind") == "group"
    )
    own = rows.filter(F.col("population") != EVERYONE).select(
        "population", "signal", "value", F.when(is_peer, 1).otherwise(0).alias("w")
    )
    # The whole book is a population only if some group falls back to it.
    needed = placed.agg(F.max(F.col("population") == EVERYONE).alias("_any"))
    everyone = (
        rows.crossJoin(F.broadcast(needed))
        .filter("_any")
        .select(F.lit(EVERYONE).alias("population"), "signal", "value", F.lit(1).alias("w"))
    )
    return own.unionByName(everyone)


def peer_standing(
    merchants: DataFrame,
    signals: list[str],
    group: str = "mcc_group",
    thresholds: dict[str, float] = ref.SIGNAL_THRESHOLDS,
) -> DataFrame:
    """Per merchant and signal: peer mean, spread, z, 3-sigma ceiling and percentile.

    The percentile (share of peers at or below the value) comes from prefix counts
    over distinct values, not from comparing merchants with each other.
    """
    placed = with_peer_population(merchants, group)
    counts = (
        _memberships(placed, signals)
        .groupBy("population", "signal", "value")
        .agg(F.sum("w").alias("n"))
    )
    keys = ["population", "signal"]
    n, v = F.col("n"), F.col("value")
    mean = F.sum(v * n) / F.sum(n)
    moments = counts.groupBy(*keys).agg(
        F.sum("n").alias("peers"),
        mean.alias("peer_mean"),
        F.sqrt(F.greatest(F.sum(v * v * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("_sd"),
    )
    position = prefix_counts(counts, keys, "value", ["n"]).select(
        *keys, "value", (F.col("n_before") + F.col("n")).alias("_at_or_below"),
    )
    floor = F.lit(0.0)
    for s in signals:
        floor = F.when(F.col("signal") == s, F.lit(thresholds[s] * ref.PEER_SIGMA_FLOOR)).otherwise(floor)
    sd = F.greatest(F.when(F.col("peers") < 2, F.lit(0.0)).otherwise(F.col("_sd")), floor)
    return (
        _long(placed, signals, [M, "population", "peer_kind"])
        .join(moments, keys)
        .join(position, [*keys, "value"])
        .withColumn("peer_sd", sd)
        .select(
            M, "signal", "value", "peer_kind", "peers", "peer_mean", "peer_sd",
            ((F.col("value") - F.col("peer_mean")) / F.col("peer_sd")).alias("z"),
            (F.col("peer_mean") + 3 * F.col("peer_sd")).alias("ceiling"),
            F.coalesce(F.try_divide("_at_or_below", "peers"), F.lit(1.0)).alias("percentile"),
        )
    )


def peer_histogram(
    merchants: DataFrame, signals: list[str], group: str = "mcc_group", bins: int = 48
) -> DataFrame:
    """Counts of a group's merchants in ``bins`` equal bins from 0 to 1.06*maximum."""
    rows = _long(merchants, signals, [group])
    tops = rows.groupBy(group, "signal").agg(F.max("value").alias("_top"))
    hi = F.when(F.col("_top") * 1.06 > 0, F.col("_top") * 1.06).otherwise(F.lit(1.0))
    counts = rows.groupBy(group, "signal", "value").agg(F.count("*").alias("n"))
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("value") / hi * bins)))
    return (
        counts.join(tops, [group, "signal"])
        .groupBy(group, "signal", slot.cast("long").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
