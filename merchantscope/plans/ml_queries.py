"""Driver queries that train models (checked by rows, ranges and unit tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantscope.operators import ml, peers
from merchantscope.operators.evaluation import precision_curve
from merchantscope.operators.ordering import average_rank_percent, ordinal_rank
from merchantscope import reference as ref
from merchantscope.plans.workbench import Workbench, tidy

M = "merchant_id"


def clean_merchants(b: Workbench) -> DataFrame:
    labels = b.fixture.labels().select(
        M, (~(F.col("is_integrity_violation") | F.col("is_interchange_abuse"))).alias("is_clean")
    )
    return b.scores.join(labels, M)


def offline(b: Workbench) -> DataFrame:
    """Offline features with a behaviour class per supplier role and the abuse label."""
    return ml.offline_features(b.live_tx).join(
        b.fixture.labels().select(
            M, F.col("is_integrity_violation").alias("abuse"),
            F.concat(F.lit("700"), (F.col(M) % 8).cast("string")).alias("behavior_mcc"),
            F.concat(F.lit("700"), (F.col(M) % 5).cast("string")).alias("declared_mcc"),
        ),
        M,
    )


def offline_features(b):
    return tidy(ml.offline_features(b.live_tx))


def baseline_z(b):
    z = peers.clean_baseline_zscores(clean_merchants(b), ref.INTEGRITY_FEATURES, "is_clean")
    return tidy(z.select(M, *[f"z_{f}" for f in ref.INTEGRITY_FEATURES]))


def percentile_rank(b):
    ranked = average_rank_percent(b.features.select(M, "gross_sales_usd"), "gross_sales_usd", "pct")
    return tidy(ordinal_rank(ranked, "pct", M, "position").drop("gross_sales_usd"))


def integrity_logistic(b):
    model, z = ml.fit_integrity_model(clean_merchants(b))
    out = ml.rescore(model, z)
    return tidy(out.select(M, "family", "model_score", "model_percentile", "model_tier",
                           "model_exposure_score", "model_flag",
                           F.coalesce(F.size("drivers"), F.lit(0)).alias("drivers")))


#: Weights of the re-scoring check, one per integrity feature in order.
GIVEN_WEIGHTS = [round(0.9 - 0.15 * i, 2) for i in range(len(ref.INTEGRITY_FEATURES))]
GIVEN_INTERCEPT = -0.4


def given_rescore(b) -> DataFrame:
    z = peers.clean_baseline_zscores(clean_merchants(b), ref.INTEGRITY_FEATURES, "is_clean")
    return ml.rescore_with(GIVEN_WEIGHTS, GIVEN_INTERCEPT, z)


def rescored(b):
    return tidy(given_rescore(b).select(M, "model_score", "model_percentile", "model_tier",
                                        "model_exposure_score", "model_flag"))


def rescored_drivers(b):
    return tidy(given_rescore(b).select(M, F.inline("drivers")), 4)


def optimality(b):
    """How far the fitted weights are from the optimum of the loss: nowhere."""
    return tidy(ml.optimality(*ml.fit_integrity_model(clean_merchants(b))), 3)


def split(b):
    return tidy(ml.stratified_split(offline(b).select(M, "behavior_mcc"), M, "behavior_mcc", 0.75, 20260724))


def exact_metrics(b):
    """Precision, recall, F1, ROC-AUC and average precision of a given score column."""
    records = b.fixture.records().select(
        "score", F.col("actual").cast("double").alias("label"), (F.col("record_id") % 3 == 0).alias("is_train"))
    return tidy(ml.head_metrics(records))


def mcc_logistic(b):
    _, labels, scored = ml.fit_mcc_model(offline(b))
    return tidy(ml.mcc_metrics(scored, labels, "declared_mcc", "abuse"))


def gbt_head(b):
    """The sweep over held-out rows."""
    _, scored = ml.fit_gbt_head(offline(b), "abuse")
    held = scored.filter(~F.col("is_train")).withColumn("exposure", F.lit(1.0))
    return tidy(precision_curve(held, "score", "abuse", "exposure"))


QUERIES = {
    "offline_features": offline_features,
    "clean_baseline_z": baseline_z,
    "percentile_rank": percentile_rank,
    "integrity_logistic": integrity_logistic,
    "integrity_rescored": rescored,
    "integrity_drivers": rescored_drivers,
    "integrity_optimality": optimality,
    "stratified_split": split,
    "head_metrics": exact_metrics,
    "mcc_logistic": mcc_logistic,
    "gbt_head": gbt_head,
}
