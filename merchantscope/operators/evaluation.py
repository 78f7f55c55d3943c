"""Detection quality against labels. The only module that may read labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantscope.operators.ordering import prefix_counts


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _ratio(num: Column, den: Column) -> Column:
    return num / F.greatest(F.lit(1), den)


def binary_metrics(pred: Column, actual: Column) -> list[Column]:
    """Aggregates: tp, fp, fn, precision, recall, f1, support."""
    p, a = _is(pred), _is(actual)
    tp, fp, fn = F.count_if(p & a), F.count_if(p & ~a), F.count_if(~p & a)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)
    return [
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.count_if(a).alias("support"),
    ]


def confusion(df: DataFrame, score: str, actual: str, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn and precision of ``score >= threshold``."""
    p, a = F.col(score) >= threshold, _is(F.col(actual))
    tp, fp = F.count_if(p & a), F.count_if(p & ~a)
    return df.agg(
        F.lit(float(threshold)).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        F.count_if(~p & ~a).alias("tn"),
        F.count_if(~p & a).alias("fn"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
    )


def average_precision(df: DataFrame, score: str, actual: str) -> DataFrame:
    """Average precision over all distinct scores (ties together); NULL without positives.

    Sums over larger scores come from bucketed prefix counts, as for ``rank_auc``.
    """
    rows = df.select(
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"), _is(F.col(actual)).cast("long").alias("_p")
    )
    counts = rows.groupBy("_s").agg(F.count("*").alias("_n"), F.sum("_p").alias("_p"))
    ranked = prefix_counts(counts, [], "_s", ["_n", "_p"])
    found = F.col("_p_total") - F.col("_p_before")
    alerts = F.col("_n_total") - F.col("_n_before")
    return ranked.agg(F.try_divide(F.sum(F.col("_p") * found / alerts), F.max("_p_total")).alias("average_precision"))


def rank_auc(df: DataFrame, score: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks, per key; NULL where a class is empty.

    Ranks come from bucketed prefix counts over distinct scores: exact, without
    sorting all rows in one task.
    """
    keys = keys or []
    rows = df.select(
        *keys,
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"),
        _is(F.col(actual)).cast("long").alias("_a"),
    )
    counts = rows.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.sum("_a").alias("_p"))
    ranked = prefix_counts(counts, keys, "_s", ["_n"])
    mean_rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    pos = F.sum("_p").cast("double")
    neg = F.sum(F.col("_n") - F.col("_p")).cast("double")
    auc = (F.sum(mean_rank * F.col("_p")) - pos * (pos + 1) / 2.0) / (pos * neg)
    return ranked.groupBy(*keys).agg(
        F.when((pos > 0) & (neg > 0), auc).alias("auc"),
        F.sum("_p").alias("positives"),
        F.sum("_n").alias("records"),
    )


def threshold_curve(
    df: DataFrame, score: str, step: int, measures: dict[str, Column], top: int = 100
) -> DataFrame:
    """Sums of ``measures`` over rows with score >= t, for t = 0, step, ..., top.

    Each row adds to the one interval its score falls in; the curve is the suffix
    sum over the few intervals. No row is ever joined to all thresholds.
    """
    spark = df.sparkSession
    slot = F.least(F.floor(F.col(score) / step), F.lit(top // step)).cast("long")
    per_slot = (
        df.filter(F.col(score) >= 0)
        .groupBy(slot.alias("slot"))
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    )
    spine = spark.range(0, top // step + 1).withColumnRenamed("id", "slot")
    down = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.join(F.broadcast(per_slot), "slot", "left")
        .na.fill(0)
        .select(
            (F.col("slot") * step).alias("threshold"),
            *[F.sum(name).over(down).alias(name) for name in measures],
        )
    )


def precision_curve(
    df: DataFrame, score: str, actual: str, exposure: str, step: int = 2
) -> DataFrame:
    """Precision, recall, F1, alerts and captured exposure by threshold."""
    a = _is(F.col(actual))
    curve = threshold_curve(
        df,
        score,
        step,
        {
            "alerts": F.lit(1).cast("long"),
            "tp": a.cast("long"),
            "captured_exposure": F.when(a, F.col(exposure)).otherwise(F.lit(0.0)),
        },
    )
    positives = df.agg(F.count_if(a).alias("_pos"))
    precision = F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(F.lit(0.0))
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("_pos"))
    return (
        curve.crossJoin(F.broadcast(positives))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            2 * F.col("precision") * F.col("recall")
            / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")),
        )
        .drop("_pos")
    )


def impact_sweep(df: DataFrame, score: str, exposure: str, step: int = 4) -> DataFrame:
    """Share of exposure captured and of records worked, by threshold."""
    curve = threshold_curve(
        df, score, step, {"alerts": F.lit(1).cast("long"), "captured": F.col(exposure)}
    )
    totals = df.agg(F.count("*").alias("_n"), F.sum(exposure).alias("_total"))
    return curve.crossJoin(F.broadcast(totals)).select(
        "threshold",
        F.coalesce(F.try_divide("captured", "_total"), F.lit(0.0)).alias("captured_pct"),
        "alerts",
        F.coalesce(F.try_divide("alerts", "_n"), F.lit(0.0)).alias("workload_pct"),
    )


def impact_at(
    df: DataFrame, score: str, actual: str, exposure: str, threshold: float
) -> DataFrame:
    """Alerts, captured exposure and exposure of missed positives at one threshold."""
    hit = F.col(score) >= threshold
    missed = ~hit & _is(F.col(actual))
    zero = F.lit(0.0)
    return df.agg(
        F.count_if(hit).alias("alerts"),
        F.sum(F.when(hit, F.col(exposure)).otherwise(zero)).alias("captured_exposure"),
        F.sum(F.when(missed, F.col(exposure)).otherwise(zero)).alias("missed_exposure"),
    )


def class_precision(
    df: DataFrame, score: str, predicted: str, actual: str, threshold: float
) -> DataFrame:
    """Per predicted class: alerts and the share whose actual class is the same."""
    alerts = df.filter(F.col(score) >= threshold)
    return alerts.groupBy(F.col(predicted).alias("class")).agg(
        F.count("*").alias("alerts"),
        F.avg(_is(F.col(predicted) == F.col(actual)).cast("double")).alias("precision"),
    )


def false_positives(
    df: DataFrame, score: str, actual: str, threshold: float, id_col: str, k: int = 12
) -> DataFrame:
    """The k highest-scored alerts without a label."""
    wrong = df.filter((F.col(score) >= threshold) & ~_is(F.col(actual)))
    return wrong.orderBy(F.desc(score), id_col).limit(k).select(id_col, score)


def mean_contribution(
    df: DataFrame, contributions: str, score: str, threshold: float, k: int = 12
) -> DataFrame:
    """Mean absolute contribution per feature over flagged rows, top k."""
    parts = df.filter(F.col(score) >= threshold).select(F.inline(contributions))
    return (
        parts.groupBy("id")
        .agg(F.avg(F.abs("contribution")).alias("importance"), F.count("*").alias("n"))
        .orderBy(F.desc("importance"), "id")
        .limit(k)
    )


def weight_importance(spark, models: dict[str, dict[str, float]]) -> DataFrame:
    """Share of each feature in a model's absolute weight."""
    rows = [
        (model, feature, float(w), abs(w) / sum(abs(x) for x in weights.values()) * 100)
        for model, weights in models.items()
        for feature, w in weights.items()
    ]
    return spark.createDataFrame(rows, "model string, feature string, weight double, importance double")


def detector_rollup(metrics: DataFrame) -> DataFrame:
    """Mean precision, alerts and captured exposure over measured detectors."""
    return metrics.agg(
        F.avg("precision").alias("mean_precision"),
        F.sum("alerts").alias("alert_volume"),
        F.sum("captured_exposure").alias("captured_exposure"),
    )
