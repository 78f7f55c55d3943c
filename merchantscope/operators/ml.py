"""Model training on the merchant grain with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantscope import reference as ref
from merchantscope.functions.numeric import round_half_even
from merchantscope.operators.evaluation import average_precision, binary_metrics, rank_auc
from merchantscope.operators.ordering import ordinal_rank
from merchantscope.operators.peers import clean_baseline_zscores
from merchantscope.operators.scoring import tier_of
from merchantscope.session import stage_table

M = "merchant_id"


# ---------------------------------------------------------------- features
def offline_features(tx: DataFrame, threshold: float = 500.0) -> DataFrame:
    """Training features per merchant: amounts, cash, card-present, refunds, proximity."""
    near = (F.col("amount") >= threshold * 0.9) & (F.col("amount") < threshold)

    def share(cond: Column) -> Column:
        return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))

    return tx.groupBy(M).agg(
        F.count("*").alias("txn_count"),
        F.avg("amount").alias("avg_ticket"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_ticket"),
        share(F.col("cash_equivalent")).alias("cash_share"),
        share(~F.col("ecommerce")).alias("card_present_share"),
        share(F.col("refund")).alias("refund_rate"),
        share(near).alias("threshold_proximity"),
    )


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns centred and scaled by the population spread, as ``s_<col>``."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    joined = df.crossJoin(F.broadcast(stats))
    scaled = {
        f"s_{c}": (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        for c in cols
    }
    return joined.withColumns(scaled).drop(*stats.columns)


def stratified_split(df: DataFrame, id_col: str, target: str, share: float, seed: int) -> DataFrame:
    """Rows with ``is_train``: in each class the share of rows that comes first in hash order.

    Every class of two rows or more has rows on both sides. Hash buckets are counted
    per class first, so that no class is ordered in one task.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", code).withColumn("_b", F.conv(F.substring(code, 1, 3), 16, 10).cast("int"))
    totals = keyed.groupBy(target, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(target)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(whole)
    wanted = F.floor(n * F.lit(share) + 0.5)
    wanted = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, wanted))).otherwise(n)
    offsets = totals.select(
        F.col(target).alias("_t"), "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_o"), wanted.alias("_w")
    )
    joined = keyed.join(offsets.withColumnRenamed("_b", "_c"), (F.col("_b") == F.col("_c")) & F.col(target).eqNullSafe(F.col("_t")))
    place = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", id_col)) - 1
    return joined.withColumn("is_train", F.col("_o") + place < F.col("_w")).drop("_h", "_b", "_c", "_t", "_o", "_w")


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


# ------------------------------------------------- integrity logistic model
def fit_integrity_model(
    merchants: DataFrame, clean: str = "is_clean", c: float = ref.INTEGRITY_C
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Class-balanced L2 logistic model on oriented clean-baseline z-scores.

    Returns the model and the merchants with their z columns. With balanced weights
    the weights add up to the row count n, so a penalty of 1/(c*n) on the mean loss
    equals inverse regularisation c on the summed loss.
    """
    cols = ref.INTEGRITY_FEATURES
    z = stage_table(clean_baseline_zscores(merchants, cols, clean), "integrity_z")
    counts = z.agg(F.count("*").alias("n"), F.count_if(F.col(clean)).alias("clean")).first()
    n, n_clean = counts["n"], counts["clean"]
    weight = F.when(F.col(clean), n / (2.0 * max(n_clean, 1))).otherwise(
        n / (2.0 * max(n - n_clean, 1))
    )
    train = _assembled(
        z.withColumn("label", (~F.col(clean)).cast("double")).withColumn("weight", weight),
        [f"z_{f}" for f in cols],
    )
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=2000, tol=1e-8,
    ).fit(train)
    return model, z


def optimality(model: LogisticRegressionModel, z: DataFrame, clean: str = "is_clean", c: float = ref.INTEGRITY_C) -> DataFrame:
    """Gradient of the penalised, balanced loss at the fitted weights: 0 for each term at the optimum."""
    bad = (~F.col(clean)).cast("double")
    counts = z.agg(F.count("*").alias("_n"), F.sum(bad).alias("_bad"))
    margin = F.lit(float(model.intercept))
    for f, w in zip(ref.INTEGRITY_FEATURES, model.coefficients):
        margin = margin + F.col(f"z_{f}") * F.lit(float(w))
    weight = F.col("_n") / (2.0 * F.when(bad > 0, F.col("_bad")).otherwise(F.col("_n") - F.col("_bad")))
    off = weight * (1.0 / (1.0 + F.exp(-margin)) - bad)
    rows = z.crossJoin(F.broadcast(counts)).withColumn("_off", off)
    terms = {"intercept": F.lit(1.0), **{f: F.col(f"z_{f}") for f in ref.INTEGRITY_FEATURES}}
    penalty = {"intercept": 0.0, **{f: float(w) / c for f, w in zip(ref.INTEGRITY_FEATURES, model.coefficients)}}
    sums = rows.agg(
        F.array(*[
            F.struct(F.lit(t).alias("term"), ((F.sum(F.col("_off") * x) + F.lit(penalty[t])) / F.max("_n")).alias("gradient"))
            for t, x in terms.items()
        ]).alias("t")
    )
    return sums.select(F.inline("t"))


def integrity_drivers(coefficients: list[float], k: int = 6, floor: float = 0.02) -> Column:
    """Top contributions pushing the score up: coef*z, with the share of all upward push."""
    parts = F.array(
        *[
            F.struct(
                (F.col(f"z_{f}") * F.lit(float(w))).alias("contribution"),
                F.lit(f).alias("feature"),
                F.col(f"z_{f}").alias("z"),
                F.lit(float(w)).alias("coef"),
            )
            for f, w in zip(ref.INTEGRITY_FEATURES, coefficients)
        ]
    )
    upward = F.aggregate(
        F.filter(parts, lambda p: p["contribution"] > 0), F.lit(0.0),
        lambda acc, p: acc + p["contribution"],
    )
    top = F.slice(
        F.sort_array(F.filter(parts, lambda p: p["contribution"] > floor), asc=False), 1, k
    )
    return F.transform(
        top,
        lambda p: F.struct(
            p["feature"].alias("feature"), p["z"].alias("z"), p["coef"].alias("coef"),
            p["contribution"].alias("contribution"),
            (p["contribution"] / upward).alias("share"),
        ),
    )


def rescore(model: LogisticRegressionModel, z: DataFrame) -> DataFrame:
    return rescore_with([float(x) for x in model.coefficients], float(model.intercept), z)


def rescore_with(coefficients: list[float], intercept: float, z: DataFrame) -> DataFrame:
    """Model score for model-routed families, the rule score kept for the others.

    Re-tiers, re-ranks and re-flags on the blended score and adds the drivers.
    """
    margin = F.lit(intercept)
    for f, w in zip(ref.INTEGRITY_FEATURES, coefficients):
        margin = margin + F.col(f"z_{f}") * F.lit(w)
    own = round_half_even(100.0 / (1.0 + F.exp(-margin)), 1)
    routed = F.col("family").isin(ref.MODEL_ROUTED_FAMILIES)
    blended = z.withColumn(
        "model_score", F.when(routed, own).otherwise(F.col("integrity_risk_score"))
    ).withColumn("drivers", F.when(routed, integrity_drivers(coefficients)))
    ranked = ordinal_rank(blended, "model_score", M, "_rank")
    exposure = F.col("model_score") * F.log10(F.greatest(F.col("gross_sales_usd"), F.lit(10.0)))
    return (
        ranked.withColumn(
            "model_percentile",
            round_half_even(
                F.coalesce(F.try_divide(F.col("_rank") * 100.0, F.col("_rank_total") - 1), F.lit(0.0)),
                1,
            ),
        )
        .withColumn("model_tier", tier_of(F.col("model_score"), ref.MODEL_TIERS, "Low"))
        .withColumn("model_exposure_score", round_half_even(exposure, 1))
        .withColumn("model_flag", (F.col("model_score") >= ref.MODEL_QUEUE_SCORE).cast("int"))
        .drop("_rank", "_rank_total")
    )


# ------------------------------------------------- category classifier
def fit_mcc_model(
    features: DataFrame, target: str = "behavior_mcc", c: float = 1.0, seed: int = 20260724
):
    """Multinomial logistic classifier on standardised features, 75/25 split of each class.

    Returns (model, class labels, all rows with probabilities and ``is_train``).
    """
    known = standardised(features.filter(F.col(target).isNotNull()), ref.MCC_FEATURES)
    indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(known)
    rows = _assembled(indexer.transform(known), [f"s_{f}" for f in ref.MCC_FEATURES])
    rows = stage_table(
        stratified_split(rows.drop("features"), M, target, 0.75, seed), "mcc_training"
    )
    rows = _assembled(rows, [f"s_{f}" for f in ref.MCC_FEATURES])
    train = rows.filter("is_train")
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * max(train.count(), 1)), standardization=False,
        maxIter=2000,
    ).fit(train)
    return model, list(indexer.labels), model.transform(rows)


def mcc_metrics(scored: DataFrame, labels: list[str], declared: str, abuse: str) -> DataFrame:
    """Top-1 and top-3 accuracy on held-out rows; mismatch rate, recall and FPR on all."""
    probs = vector_to_array("probability")
    own = F.element_at(probs, (F.col("label") + 1).cast("int"))
    better = F.size(F.filter(probs, lambda p: p > own))
    names = F.array(*[F.lit(x) for x in labels])
    predicted = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    held = ~F.col("is_train")
    mismatch = (predicted != F.col(declared)).cast("double")
    return scored.agg(
        F.avg(F.when(held, (better < 1).cast("double"))).alias("top1_accuracy"),
        F.avg(F.when(held, (better < 3).cast("double"))).alias("top3_accuracy"),
        F.avg(mismatch).alias("mismatch_rate"),
        F.coalesce(F.avg(F.when(F.col(abuse), mismatch)), F.lit(0.0)).alias("mismatch_recall"),
        F.coalesce(F.avg(F.when(~F.col(abuse), mismatch)), F.lit(0.0)).alias("mismatch_fpr"),
    )


# ------------------------------------------------------ boosted binary head
def fit_gbt_head(
    features: DataFrame, target: str, trees: int = 100, depth: int = 3, rate: float = 0.1,
    seed: int = 20260724,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Gradient-boosted trees with a 70/30 split of each class; returns model and scored rows."""
    filled = features.na.fill(0, ref.HEAD_FEATURES).withColumn("label", F.col(target).cast("double"))
    rows = stage_table(
        stratified_split(filled, M, "label", 0.7, seed), "head_training"
    )
    rows = _assembled(rows, ref.HEAD_FEATURES)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(
        rows.filter("is_train")
    )
    scored = model.transform(rows).withColumn(
        "score", F.element_at(vector_to_array("probability"), 2) * 100
    )
    return model, scored


def head_metrics(scored: DataFrame, threshold: float = 62.0) -> DataFrame:
    """Held-out precision, recall, F1 at the threshold, exact ROC-AUC and average precision."""
    test = stage_table(scored.filter(~F.col("is_train")).select("score", (F.col("label") == 1.0).alias("label")), "held_out")
    point = test.agg(*binary_metrics(F.col("score") >= threshold, F.col("label")))
    auc = rank_auc(test, "score", "label").select(F.col("auc").alias("roc_auc"))
    area = average_precision(test, "score", "label").select(F.col("average_precision").alias("pr_auc"))
    return point.crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(area))


def tree_importance(model: GBTClassificationModel, spark) -> DataFrame:
    """Share of the impurity gain per feature of the boosted head."""
    rows = [(f, float(model.featureImportances[i])) for i, f in enumerate(ref.HEAD_FEATURES)]
    return spark.createDataFrame(rows, "feature string, importance double")
