"""Peer-relative deviation (z-scores) on the merchant grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref


def peer_zscores(
    features: DataFrame,
    cols: list[str],
    peer_col: str = "mcc_group",
    min_peers: int = ref.MIN_PEERS,
    clip: float = ref.Z_CLIP,
    prefix: str = "z_",
) -> DataFrame:
    """Add ``z_<col>``: deviation from the peer group, from all where peers are few.

    Group moments come from one grouped pass over all columns (sample standard
    deviation); the global moments are a single row. A missing or zero spread
    gives 0, and results are clipped.
    """

    def moments(tag: str):
        out = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            out += [
                F.avg(x).alias(f"_{tag}m{i}"),
                F.stddev_samp(x).alias(f"_{tag}s{i}"),
                F.count(x).alias(f"_{tag}n{i}"),
            ]
        return out

    peers = features.groupBy(peer_col).agg(*moments("p"))
    everyone = features.agg(*moments("g"))
    joined = features.join(peers, features[peer_col].eqNullSafe(peers[peer_col]), "left").drop(
        peers[peer_col]
    ).crossJoin(F.broadcast(everyone))
    scores = {}
    for i, c in enumerate(cols):
        enough = (F.col(f"_pn{i}") >= min_peers) & F.col(peer_col).isNotNull()
        mean = F.when(enough, F.col(f"_pm{i}")).otherwise(F.col(f"_gm{i}"))
        sd = F.when(enough, F.col(f"_ps{i}")).otherwise(F.col(f"_gs{i}"))
        # A spread within rounding noise of the mean is no spread.
        spread = (sd > 0) & (sd > F.abs(mean) * 1e-12)
        z = F.when(spread, (F.col(c).cast("double") - mean) / sd)
        # Missing becomes 0 before clipping: least() and greatest() skip NULLs.
        scores[f"{prefix}{c}"] = F.greatest(
            F.lit(-clip), F.least(F.lit(clip), F.coalesce(z, F.lit(0.0)))
        )
    helper = [f"_{t}{k}{i}" for t in "pg" for k in "msn" for i in range(len(cols))]
    return joined.withColumns(scores).drop(*helper)


def population_zscores(
    features: DataFrame, cols: dict[str, str], peer_col: str, dp: int = 3
) -> DataFrame:
    """Live-engine deviation: population spread of the declared category, no fallback.

    ``cols`` maps source column to output column.
    """
    stats = features.groupBy(peer_col).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
    )
    joined = features.join(stats, peer_col, "left")
    z = {
        out: F.coalesce(
            F.round(
                F.when(F.col(f"_s_{c}") > 1e-9, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")),
                dp,
            ),
            F.lit(0.0),
        )
        for c, out in cols.items()
    }
    return joined.withColumns(z).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def clean_baseline_zscores(
    features: DataFrame,
    cols: list[str],
    clean: str,
    peer_col: str = "mcc_group",
    min_peers: int = 8,
    lo: float = -4.0,
    hi: float = 8.0,
) -> DataFrame:
    """Deviation from the *clean* peers of the group, from all clean ones where few.

    ``clean`` is a boolean column. Each z is turned so that a higher value points
    away from the clean merchants: its sign is that of the difference of the two
    global means. A missing value counts as 0, a spread of (almost) 0 as 1.
    """
    is_clean = F.col(clean)

    def value(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def moments(tag):
        out = [F.count_if(is_clean).alias(f"_{tag}n")]
        for i, c in enumerate(cols):
            x = F.when(is_clean, value(c))
            out += [F.avg(x).alias(f"_{tag}m{i}"), F.stddev_pop(x).alias(f"_{tag}s{i}")]
        return out

    others = [F.avg(F.when(~is_clean, value(c))).alias(f"_a{i}") for i, c in enumerate(cols)]
    peers = features.groupBy(peer_col).agg(*moments("p"))
    everyone = features.agg(*moments("g"), *others)
    joined = features.join(peers, peer_col, "left").crossJoin(F.broadcast(everyone))
    enough = F.col("_pn") >= min_peers
    scores = {}
    for i, c in enumerate(cols):
        mean = F.when(enough, F.col(f"_pm{i}")).otherwise(F.col(f"_gm{i}"))
        sd = F.when(enough, F.col(f"_ps{i}")).otherwise(F.col(f"_gs{i}"))
        sign = F.when(F.col(f"_a{i}") < F.col(f"_gm{i}"), F.lit(-1.0)).otherwise(F.lit(1.0))
        z = sign * (value(c) - mean) / F.when(sd > 1e-9, sd).otherwise(F.lit(1.0))
        scores[f"z_{c}"] = F.greatest(F.lit(lo), F.least(F.lit(hi), z))
    helper = [x for x in joined.columns if x not in features.columns]
    return joined.withColumns(scores).drop(*helper)
