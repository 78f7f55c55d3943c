"""Model registry: many models measured in one pass over the scored merchants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.operators.evaluation import binary_metrics, rank_auc


@dataclass(frozen=True)
class Model:
    """A model under evaluation: its decision, the truth, and optionally its score."""

    name: str
    predicted: Column
    actual: Column
    score: Column | None = None


def evaluate(df: DataFrame, models: list[Model]) -> DataFrame:
    """Precision, recall, F1, counts and AUC per model.

    Each merchant is laid out once per model (a narrow step); one grouped pass
    gives all confusion counts and one keyed rank pass all AUCs.
    """
    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    none = F.lit(None).cast("double")
    rows = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("model"),
                flag(m.predicted).alias("predicted"),
                flag(m.actual).alias("actual"),
                (m.score.cast("double") if m.score is not None else none).alias("score"),
            )
            for m in models
        ]
    )
    long = df.select(F.inline(rows))
    metrics = long.groupBy("model").agg(*binary_metrics(F.col("predicted"), F.col("actual")))
    scored = [m.name for m in models if m.score is not None]
    auc = rank_auc(
        long.filter(F.col("model").isin(scored)), "score", "actual", ["model"]
    ).select("model", "auc")
    return metrics.join(auc, "model", "left")


def detector_metrics(df: DataFrame, models: list[Model], exposure: str) -> DataFrame:
    """One row per detector: alerts, precision and the exposure of its confirmed alerts."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("detector"),
                F.coalesce(m.predicted, F.lit(False)).alias("predicted"),
                F.coalesce(m.actual, F.lit(False)).alias("actual"),
                F.col(exposure).alias("exposure"),
            )
            for m in models
        ]
    )
    hit = F.col("predicted") & F.col("actual")
    return df.select(F.inline(rows)).groupBy("detector").agg(
        F.count_if("predicted").alias("alerts"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.sum(F.when(hit, F.col("exposure"))), F.lit(0.0)).alias("captured_exposure"),
    )


def standard_models(families_from_labels: Column | None = None) -> list[Model]:
    """Family detectors, the composite, the content classifiers and priority tiers.

    Expects the scored merchants joined with labels: ``true_family``,
    ``integrity_category``, ``integrity_tier``, ``descriptor_churn``,
    ``is_content_miscoded`` and the two violation flags.
    """
    c = F.col
    flagged = c("flag_for_investigation") == 1
    true_family = families_from_labels if families_from_labels is not None else c("true_family")
    out = [
        Model("descriptor", c("score_descriptor") >= 70, c("descriptor_churn"), c("score_descriptor")),
        Model("mcc_miscoding", c("score_mcc_miscoding") >= 70, c("is_content_miscoded"),
              c("score_mcc_miscoding")),
    ]
    score_of = {"split_ticketing": "split_ticketing", "factoring": "factoring",
                "mcc_abuse": "mcc_abuse", "cash": "cash_disbursement"}
    for family, score in score_of.items():
        out.append(
            Model(family, c("family") == family, true_family == family, c(f"score_{score}"))
        )
    target = F.coalesce(c("is_integrity_violation"), F.lit(False)) | F.coalesce(
        c("is_interchange_abuse"), F.lit(False)
    )
    out.append(Model("composite", flagged, target, c("integrity_risk_score")))
    for category in ref.CATEGORY_WEIGHTS:
        out.append(
            Model(
                f"category:{category}",
                flagged & (c("top_category") == category),
                c("integrity_category") == category,
            )
        )
    for tier in ("P1", "P2", "P3"):
        members = [k for k, v in ref.CATEGORY_PRIORITY.items() if v == tier]
        out.append(
            Model(
                f"priority:{tier}",
                flagged & c("top_category").isin(members),
                c("integrity_tier") == tier,
            )
        )
    return out
