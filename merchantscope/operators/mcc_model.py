"""Nearest-profile category classifier and archetype similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope.functions.numeric import gaussian_match
from merchantscope.functions.text import space_tokens
from merchantscope.operators.live_features import expected_ticket, profile_array

M = "merchant_id"


# ----------------------------------------------------------------- keywords
def merchant_texts(merchants: DataFrame, tx: DataFrame) -> DataFrame:
    """Distinct lower-case (merchant, text): product signals and descriptor tokens.

    All signals count; which of them a merchant shows first does not matter.
    """
    signals = tx.select(M, F.lower("product_signal").alias("text"))
    alternates = F.coalesce("alternate_descriptors", F.array().cast("array<string>"))
    tokens = F.flatten(
        F.transform(F.concat(F.array("descriptor"), alternates), lambda d: space_tokens(d))
    )
    words = merchants.select(M, F.explode(F.transform(tokens, lambda t: F.lower(t))).alias("text"))
    return signals.unionByName(words).filter(F.col("text").isNotNull()).distinct()


def matched_keywords(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per merchant the keywords contained in any of its texts.

    The vocabulary (profile and archetype keywords) is one small array; the result
    per merchant is bounded by it.
    """
    fixed = sorted({k for _, words, _ in live.ARCHETYPES.values() for k in words})
    vocabulary = profiles.agg(
        F.array_union(
            F.flatten(F.collect_list("expected_keywords")), F.array(*[F.lit(k) for k in fixed])
        ).alias("_vocabulary")
    )
    return (
        texts.crossJoin(F.broadcast(vocabulary))
        .select(
            M,
            F.explode(F.filter("_vocabulary", lambda k: F.col("text").contains(k))).alias("keyword"),
        )
        .groupBy(M)
        .agg(F.sort_array(F.collect_set("keyword")).alias("matched_keywords"))
    )


def _keywords() -> Column:
    return F.coalesce("matched_keywords", F.array().cast("array<string>"))


# --------------------------------------------------------------- classifier
def _raw_match(p: Column) -> Column:
    """Fit of the merchant to one profile, boosted by its keywords."""
    s, w = live.PROFILE_SIGMA, live.PROFILE_WEIGHT
    cnp = F.col("card_not_present_ratio") - (1 - p["typical_card_present_ratio"])
    night = F.col("night_ratio") - p["typical_night_ratio"]
    ticket = F.ln((F.col("avg_ticket") + 1) / (expected_ticket(p["ticket_lo"], p["ticket_hi"]) + 1))
    dispute = F.col("dispute_rate") - p["typical_dispute_rate"]
    cash = F.col("cash_equivalent_ratio")
    cash_fit = F.when(
        p["mcc"].isin(live.CASH_PROFILE_MCCS), 0.5 + 0.5 * F.least(F.lit(1.0), cash * 2)
    ).otherwise(1 - F.least(F.lit(1.0), cash))
    hits = F.size(F.array_intersect(p["expected_keywords"], _keywords()))
    fit = (
        w["cnp"] * gaussian_match(cnp, s["cnp"])
        + w["night"] * gaussian_match(night, s["night"])
        + w["ticket"] * gaussian_match(ticket, s["ticket"])
        + w["dispute"] * gaussian_match(dispute, s["dispute"])
        + w["cash"] * cash_fit
    )
    return fit * (1 + hits * live.PROFILE_KEYWORD_BOOST)


def predict_mcc(features: DataFrame, profiles: DataFrame, top: int = 3) -> DataFrame:
    """Predicted code, confidence, top candidates, severity and hierarchy match.

    Every step is local to the merchant's row: no candidate rows, no shuffle.
    """
    ranked = F.sort_array(
        F.transform(
            "_profiles",
            lambda p: F.struct(
                (-_raw_match(p)).alias("neg_raw"), p["mcc"].alias("mcc"),
                p["category"].alias("category"), p["parent_category"].alias("parent"),
                p["risk_tier"].alias("risk_tier"),
            ),
        )
    )
    best = F.col("_ranked")[0]
    weights = F.transform(
        "_ranked", lambda r: F.exp((best["neg_raw"] - r["neg_raw"]) / live.PROFILE_TEMPERATURE)
    )
    total = F.aggregate("_weights", F.lit(0.0), lambda acc, x: acc + x)
    declared = F.try_element_at(
        F.filter("_profiles", lambda p: p["mcc"] == F.col("declared_mcc")), F.lit(1)
    )
    own_tier = F.coalesce(declared["risk_tier"], F.lit("medium"))
    escalates = own_tier.isin("low", "medium") & F.col("_best.risk_tier").isin(
        "high", "prohibited-adjacent"
    )
    confidence = F.col("mcc_confidence")
    severity = (
        F.when(F.col("declared_mcc") == F.col("predicted_mcc"), F.lit("clear"))
        .when(escalates & (confidence > 0.75), F.lit("critical"))
        .when(escalates, F.lit("high"))
        .when(confidence > 0.7, F.lit("elevated"))
        .otherwise(F.lit("watch"))
    )
    return (
        features.crossJoin(F.broadcast(profile_array(profiles)))
        .withColumn("_ranked", ranked)
        .withColumn("_weights", weights)
        .withColumn("_total", total)
        .withColumn("_best", best)
        .withColumn("predicted_mcc", F.col("_best.mcc"))
        .withColumn("predicted_label", F.col("_best.category"))
        .withColumn("mcc_confidence", 1 / F.col("_total"))
        .withColumn(
            "mcc_candidates",
            F.slice(
                F.zip_with(
                    "_ranked",
                    "_weights",
                    lambda r, x: F.struct(
                        r["mcc"].alias("mcc"), r["category"].alias("category"),
                        (x / F.col("_total")).alias("probability"),
                    ),
                ),
                1,
                top,
            ),
        )
        .withColumn("mismatch_severity", severity)
        .withColumn(
            "hierarchy_match",
            F.coalesce(declared["parent_category"] == F.col("_best.parent"), F.lit(False)),
        )
        .drop("_profiles", "_ranked", "_weights", "_total", "_best")
    )


# --------------------------------------------------------------- archetypes
def archetype_matches(
    features: DataFrame, archetypes: dict = live.ARCHETYPES
) -> DataFrame:
    """Add ``archetype_matches``: similarity to each archetype with axis shares."""
    entries = []
    for name, (anchor, keywords, axes) in archetypes.items():
        scored = []
        for axis, feature, target, sigma, weight in axes:
            v = F.col(feature).cast("double")
            match = F.when(v >= target, F.lit(1.0)).otherwise(gaussian_match(v - target, sigma))
            scored.append((axis, feature, weight, match))
        weighted = sum((m * w for _, _, w, m in scored), F.lit(0.0))
        similarity = weighted / sum(w for _, _, w, _ in scored)
        hits = F.size(
            F.array_intersect(_keywords(), F.array(*[F.lit(k) for k in keywords]))
        )
        nudge = F.least(F.lit(live.ARCHETYPE_KEYWORD_CAP), hits * live.ARCHETYPE_KEYWORD_STEP)
        similarity = similarity + (1 - similarity) * nudge
        shares = F.array(
            *[
                F.struct(
                    (-F.round(F.when(weighted > 0, m * w / weighted).otherwise(0.0), 3)).alias("neg"),
                    F.lit(i).alias("place"),
                    F.lit(axis).alias("id"),
                    F.round(m, 3).alias("match"),
                )
                for i, (axis, _, w, m) in enumerate(scored)
            ]
        )
        attributions = F.transform(
            F.sort_array(shares),
            lambda s: F.struct(s["id"].alias("id"), s["match"].alias("match"),
                               (-s["neg"]).alias("share")),
        )
        entries.append(
            F.struct(
                (-F.round(similarity * 100, 1)).alias("neg"),
                F.lit(name).alias("archetype"),
                F.lit(anchor).alias("anchor_mcc"),
                attributions.alias("attributions"),
            )
        )
    ordered = F.sort_array(F.array(*entries))
    return features.withColumn(
        "archetype_matches",
        F.transform(
            ordered,
            lambda e: F.struct(
                e["archetype"].alias("archetype"), (-e["neg"]).alias("similarity"),
                e["anchor_mcc"].alias("anchor_mcc"), e["attributions"].alias("attributions"),
            ),
        ),
    )
