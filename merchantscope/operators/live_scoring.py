"""Live ensemble: components, final score, contributions, typologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope import reference as ref
from merchantscope.functions.numeric import clamp, logistic100, round_half_up
from merchantscope.operators.scoring import tier_of


def _cap(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _hit_score(typology: str | None = None) -> Column:
    hits = F.col("rule_hits")
    if typology:
        hits = F.filter(hits, lambda h: h["typology"] == typology)
    return clamp(F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["score"]))


def interchange_signal() -> Column:
    """Keyed or fallback entry under a card-present code whose business is honest."""
    c = F.col
    downgrade = _cap((c("manual_entry_ratio") + c("fallback_ratio")) / 0.4)
    signal = clamp(
        100
        * (
            0.6 * downgrade
            + 0.25 * _cap(c("cross_border_ratio") / 0.3)
            + 0.15 * _cap(c("avg_ticket") / 300)
        )
    )
    applies = (
        c("declared_mcc").isin(live.CARD_PRESENT_BANDS)
        & (c("mcc_divergence") <= 0.28)
        & (downgrade >= 0.5)
    )
    return F.when(applies, signal).otherwise(F.lit(0.0))


def components() -> dict[str, Column]:
    """The seven components before rounding, each 0..100."""
    c = F.col
    supervised = logistic100(
        F.lit(-3.2)
        + 2.6 * c("mcc_divergence")
        + 1.8 * c("cash_equivalent_ratio")
        + 4.2 * c("card_not_present_ratio") * c("night_ratio")
        + 1.2 * c("round_dollar_ratio")
        + 1.1 * c("threshold_proximity_ratio")
        + 0.9 * c("wallet_load_ratio")
        + 7.0 * c("not_recognized_dispute_rate")
    )
    deviation = F.abs("peer_night_z") + F.abs("peer_cnp_z") + F.abs("peer_ticket_z")
    anomaly = clamp(logistic100(deviation - 2.5, 0.9) * 0.7 + c("mcc_divergence") * 40)
    surcharge = clamp(
        100
        * (
            0.5 * _cap(c("not_recognized_dispute_rate") * 15)
            + 0.3 * _cap(c("dispute_rate") * 12)
            + 0.2 * _cap(c("refund_rate") * 6)
        )
    )
    base = F.lit(None).cast("double")
    for severity, value in live.SEVERITY_BASE.items():
        base = F.when(c("mismatch_severity") == severity, F.lit(value)).otherwise(base)
    unclear = F.when(c("mismatch_severity") == "clear", 0.0).otherwise(1.0)
    mismatch = clamp(0.7 * base + 30 * c("mcc_confidence") * unclear + 10 * c("mcc_divergence"))
    return {
        "rule": _hit_score(),
        "supervised": supervised,
        "anomaly": anomaly,
        "graph": c("graph_score").cast("double"),
        "surcharge": surcharge,
        "mcc_mismatch": mismatch,
        "behavioral_change": clamp(c("change_point_score") * 100),
    }


def live_tier(score: Column) -> Column:
    return tier_of(score, ref.LIVE_TIERS, ref.LIVE_TIER_FLOOR)


def ensemble(df: DataFrame, weights: dict[str, float] = live.ENSEMBLE_WEIGHTS) -> DataFrame:
    """Component scores, final score with the interchange override, and the tier."""
    parts = components()
    raw = df.withColumns({f"_{k}": v for k, v in parts.items()} | {"_signal": interchange_signal()})
    base = clamp(sum((F.col(f"_{k}") * w for k, w in weights.items()), F.lit(0.0)))
    final = F.when(
        F.col("_signal") >= live.INTERCHANGE_OVERRIDE_AT, clamp(0.3 * base + 0.7 * F.col("_signal"))
    ).otherwise(base)
    out = raw.withColumn("_final", final).withColumn("risk_tier", live_tier(F.col("_final")))
    out = out.withColumns(
        {f"{k}_score": round_half_up(F.col(f"_{k}"), 1) for k in parts if k != "graph"}
        | {
            "interchange_signal": F.col("_signal"),
            "final_risk_score": round_half_up(F.col("_final"), 1),
        }
    )
    return out.drop(*[f"_{k}" for k in parts], "_signal", "_final")


def contributions(specs=live.CONTRIBUTIONS) -> Column:
    """Signed feature contributions of at least 1, strongest first."""
    rows = []
    for i, (fid, feature, weight, scale, capped, raises) in enumerate(specs):
        v = F.col(feature).cast("double")
        if raises:
            intensity = _cap(v * scale) if capped else v * scale
            signed = intensity * weight
        else:
            signed = v * -weight
        rows.append((i, fid, v, signed))
    entries = F.array(
        *[
            F.struct(
                (-F.abs(round_half_up(s, 2))).alias("neg"), F.lit(i).alias("place"),
                F.lit(fid).alias("id"), v.alias("value"), round_half_up(s, 2).alias("contribution"),
                F.when(F.abs(s) < 1, F.lit("neutral"))
                .when(s > 0, F.lit("raises"))
                .otherwise(F.lit("lowers"))
                .alias("direction"),
            )
            for i, fid, v, s in rows
        ]
    )
    kept = F.sort_array(F.filter(entries, lambda e: e["neg"] <= -1))
    return F.transform(
        kept,
        lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"),
                           e["contribution"].alias("contribution"),
                           e["direction"].alias("direction")),
    )


def typology_scores() -> dict[str, Column]:
    """Score per typology, one decimal."""
    c = F.col
    mismatch = F.when(c("mismatch_severity") == "clear", 0.0).otherwise(50.0)
    raw = {
        "MCC_MISCODING": mismatch * c("mcc_confidence")
        + 40 * c("mcc_divergence")
        + 0.4 * _hit_score("MCC_MISCODING"),
        "MCC_ABUSE": interchange_signal() + 0.4 * _hit_score("MCC_ABUSE"),
        "SPLIT_TICKETING": 100
        * (0.55 * c("threshold_proximity_ratio") + 0.45 * _cap(c("rapid_repeat_ratio") * 4))
        + 0.5 * _hit_score("SPLIT_TICKETING"),
        "FACTORING": 0.5 * c("graph_score")
        + 100
        * (0.3 * _cap(c("descriptor_entropy") / 2.2) + 0.2 * _cap(c("category_diversity") / 2))
        + 0.5 * _hit_score("FACTORING"),
        "CARD_SURCHARGE": 100
        * (0.5 * _cap(c("not_recognized_dispute_rate") * 15) + 0.3 * _cap(c("dispute_rate") * 12))
        + 0.5 * _hit_score("CARD_SURCHARGE"),
        "CASH_DISBURSEMENT": 100
        * (
            0.4 * c("round_dollar_ratio")
            + 0.3 * _cap(c("wallet_load_ratio") * 1.5)
            + 0.3 * _cap(c("refund_after_purchase_ratio") * 1.5)
        )
        + 0.5 * _hit_score("CASH_DISBURSEMENT"),
    }
    return {t: round_half_up(clamp(x), 1) for t, x in raw.items()}


def typologies(df: DataFrame) -> DataFrame:
    """Add ``typology_scores`` (map) and ``primary_typology`` (CLEAN below 28)."""
    scores = typology_scores()
    wide = df.withColumns({f"_t_{t}": s for t, s in scores.items()})
    values = F.array(*[F.col(f"_t_{t}") for t in live.TYPOLOGIES])
    names = F.array(*[F.lit(t) for t in live.TYPOLOGIES])
    best = F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    return (
        wide.withColumn("typology_scores", F.map_from_arrays(names, values))
        .withColumn(
            "primary_typology",
            F.when(F.col("final_risk_score") < live.CLEAN_BELOW, F.lit("CLEAN")).otherwise(best),
        )
        .drop(*[f"_t_{t}" for t in scores])
    )


def exposure() -> Column:
    """At-risk exposure: volume x score x loss factor, whole dollars."""
    return round_half_up(
        F.col("total_volume") * (F.col("final_risk_score") / 100) * live.EXPOSURE_FACTOR, 0
    )
