"""Batch scores, tiers, deterministic rules, flags and families."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions.numeric import finite_or, flag, logistic100, round_half_even
from merchantscope.operators.ordering import average_rank_percent
from merchantscope.operators.peers import peer_zscores
from merchantscope.session import stage_table

Weights = dict[str, float]


@dataclass(frozen=True)
class ScoreBook:
    """The weight tables of one scoring run; replace any of them to re-weight."""

    categories: dict[str, Weights] = field(default_factory=lambda: ref.CATEGORY_WEIGHTS)
    patterns: dict[str, Weights] = field(default_factory=lambda: ref.PATTERN_WEIGHTS)
    composite: Weights = field(default_factory=lambda: ref.COMPOSITE_WEIGHTS)

    def models(self) -> dict[str, Weights]:
        return {**self.categories, **self.patterns}

    def features(self) -> list[str]:
        tables = [*self.models().values(), self.composite]
        return sorted({f for t in tables for f in t})


def weighted_z(weights: Weights) -> Column:
    """Weighted sum of z-scores over the root of the absolute weight sum."""
    total = F.lit(0.0)
    for feature, weight in weights.items():
        total = total + F.col(f"z_{feature}") * F.lit(float(weight))
    return total / F.lit(math.sqrt(sum(abs(w) for w in weights.values())))


def model_scores(z: DataFrame, models: dict[str, Weights]) -> DataFrame:
    """Add ``score_<model>`` (0..100, one decimal) for each weight table."""
    return z.withColumns(
        {
            f"score_{name}": round_half_even(logistic100(weighted_z(w), ref.MODEL_STEEPNESS), 1)
            for name, w in models.items()
        }
    )


def top_model(names: list[str]) -> tuple[Column, Column]:
    """(name, score) of the highest score; the first listed wins a tie."""
    scores = F.array(*[F.col(f"score_{n}") for n in names])
    best = F.array_max(scores)
    labels = F.array(*[F.lit(n) for n in names])
    return F.element_at(labels, F.array_position(scores, best).cast("int")), best


def tier_of(score: Column, ladder, floor: str, strict: bool = False) -> Column:
    """Name of the highest step the score reaches (or exceeds, when strict)."""
    out = None
    for name, cut in ladder:
        reached = score > cut if strict else score >= cut
        out = F.when(reached, F.lit(name)) if out is None else out.when(reached, F.lit(name))
    return out.otherwise(F.lit(floor))


def batch_tier(score: Column) -> Column:
    return tier_of(score, ref.BATCH_TIERS, ref.BATCH_TIER_FLOOR, strict=True)


def composite_scores(z: DataFrame, weights: Weights) -> DataFrame:
    combined = weighted_z(weights)
    return z.withColumns(
        {
            "integrity_composite_z": round_half_even(combined, 3),
            "integrity_risk_score": round_half_even(
                logistic100(combined, ref.COMPOSITE_STEEPNESS), 1
            ),
        }
    )


def exposure_weighted(df: DataFrame) -> DataFrame:
    """Scale the score by the merchant's share of the largest log exposure."""
    exposure = F.log1p(F.greatest(F.col("gross_sales_usd"), F.lit(0.0)))
    top = df.select("gross_sales_usd").agg(F.max(exposure).alias("_top"))
    weight = F.lit(0.7) + F.lit(0.3) * F.try_divide(exposure, F.col("_top"))
    return (
        df.crossJoin(F.broadcast(top))
        .withColumn(
            "exposure_weighted_score", round_half_even(F.col("integrity_risk_score") * weight, 1)
        )
        .drop("_top")
    )


# --------------------------------------------------------------- rule layer
def batch_rules() -> dict[str, Column]:
    """The deterministic rules, in report order."""
    c = F.col
    mcc = c("declared_mcc")
    return {
        "split_ticketing_rule": (c("pct_txn_in_split_burst") > 0.10)
        & (c("pct_near_ceiling") > 0.15),
        "factoring_rule": (c("n_sub_merchant_ids") >= 2) & (c("volume_spike_ratio") > 3),
        "descriptor_churn_rule": (c("descriptor_changes") >= 3)
        & (c("descriptor_name_jaccard") < 0.20),
        "undeclared_quasi_cash_rule": (c("pct_quasi_cash") > 0.25)
        & ~F.coalesce(mcc.isin(ref.CASH_LIKE_MCCS), F.lit(False)),
        "gambling_behaviour_rule": (c("pct_night_txn") > 0.35)
        & (c("pct_round_amount") > 0.30)
        & (c("pct_cross_border") > 0.30),
        "dispute_excursion_rule": (c("chargeback_rate_bps") > 100)
        & (c("refund_rate_count") > 0.05),
        "issuer_prohibition_rule": c("pct_decline_not_permitted") > 0.05,
        "cash_disbursement_rule": (c("pct_round_100") > 0.40)
        & (c("avg_ticket_usd") > 400)
        & (c("pct_ticket_gt_500") > 0.30)
        & ~F.coalesce(mcc.isin(ref.CASH_OUTLET_MCCS), F.lit(False)),
        "interchange_abuse_rule": (
            (c("interchange_advantage_bps") > 50) & (c("declared_band_is_cheap") == 1)
        )
        | ((c("cnp_vs_mcc_expected") > 0.55) & (c("interchange_advantage_bps") > 25)),
    }


def apply_batch_rules(scored: DataFrame, model_cut: float = ref.MODEL_FLAG_SCORE) -> DataFrame:
    """Rule columns, their count and names, and the two routes into the queue."""
    rules = batch_rules()
    out = scored.withColumns({name: flag(cond) for name, cond in rules.items()})
    fired = F.array(*[F.when(F.col(r) == 1, F.lit(r)) for r in rules])
    by_model = F.col("integrity_risk_score") >= model_cut
    by_rule = F.col("rules_triggered") >= 1
    return (
        out.withColumn("rules_triggered", sum((F.col(r) for r in rules), F.lit(0)))
        .withColumn("rule_names", F.array_join(F.array_compact(fired), "|"))
        .withColumn(
            "flag_reason",
            F.when(by_model & by_rule, F.lit("model + rule"))
            .when(by_model, F.lit("model"))
            .when(by_rule, F.lit("rule"))
            .otherwise(F.lit("")),
        )
        .withColumn("flag_for_investigation", flag(F.col("flag_reason") != ""))
    )


def primary_family() -> Column:
    """Exactly one family per merchant; the first matching signal wins."""
    c = F.col
    return (
        F.when(c("interchange_abuse_rule") == 1, F.lit("mcc_abuse"))
        .when(c("split_ticketing_rule") == 1, F.lit("split_ticketing"))
        .when(
            (finite_or(c("pct_txn_with_sub_merchant")) >= 0.30)
            | (finite_or(c("n_sub_merchant_ids")) >= 2),
            F.lit("factoring"),
        )
        .when(
            (finite_or(c("score_mcc_miscoding")) < 45) & (finite_or(c("score_descriptor")) >= 70),
            F.lit("descriptor"),
        )
        .when(
            (finite_or(c("pct_quasi_cash")) >= 0.45) | (c("cash_disbursement_rule") == 1),
            F.lit("cash"),
        )
        .otherwise(F.lit("mcc_miscoding"))
    )


def label_of(key: Column, labels: dict[str, str], default: str = "") -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def with_family(scored: DataFrame) -> DataFrame:
    """Family, its label and the concealed category of flagged merchants."""
    flagged = F.col("flag_for_investigation") == 1
    return (
        scored.withColumn("family", F.when(flagged, primary_family()).otherwise(F.lit("")))
        .withColumn("family_label", label_of(F.col("family"), ref.FAMILY_LABELS))
        .withColumn(
            "subtype",
            F.when(
                F.col("family") == "mcc_miscoding",
                label_of(F.col("top_category"), ref.CATEGORY_LABELS),
            ).otherwise(F.lit("")),
        )
    )


def coarse_label(labels: DataFrame) -> DataFrame:
    """Evaluation label per merchant: abuse before violation before clean."""
    return labels.select(
        "merchant_id",
        F.when(F.col("is_interchange_abuse"), F.lit("interchange_abuse"))
        .when(F.col("is_integrity_violation"), F.lit("integrity_violation"))
        .otherwise(F.lit("clean"))
        .alias("label"),
    )


# ------------------------------------------------------------------ assembly
def score_merchants(
    features: DataFrame,
    book: ScoreBook | None = None,
    min_peers: int = ref.MIN_PEERS,
    keep_z: bool = False,
) -> DataFrame:
    """Features -> z-scores -> model and composite scores -> tier, rules, family.

    Hand in a stored feature table: peer moments and ranks read it more than once.
    The model scores are staged in between for the same reason.
    """
    book = book or ScoreBook()
    needed = book.features()
    absent = [c for c in needed if c not in features.columns]
    complete = features.withColumns({c: F.lit(0.0) for c in absent}) if absent else features
    z = peer_zscores(complete, needed, min_peers=min_peers)
    scored = composite_scores(model_scores(z, book.models()), book.composite)
    if not keep_z:
        scored = scored.drop(*[f"z_{c}" for c in needed])
    scored = stage_table(scored, "model_scores")

    category, category_score = top_model(list(book.categories))
    pattern, pattern_score = top_model(list(book.patterns))
    ranked = average_rank_percent(scored, "integrity_risk_score", "_pct")
    tiered = ranked.withColumns(
        {
            "top_category": category,
            "top_category_score": category_score,
            "top_pattern": pattern,
            "top_pattern_score": pattern_score,
            "integrity_percentile": round_half_even(F.col("_pct") * 100, 1),
            "risk_tier": batch_tier(F.col("integrity_risk_score")),
        }
    ).drop("_pct")
    return with_family(apply_batch_rules(exposure_weighted(tiered)))
