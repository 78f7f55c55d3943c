"""Training run: three models fitted, written as artifacts, read back and applied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope import live_reference as live
from merchantscope import reference as ref
from merchantscope.operators import artifacts as art, ml
from merchantscope.operators.evaluation import binary_metrics

Z_FEATURES = [f"z_{f}" for f in ref.INTEGRITY_FEATURES]


@dataclass(frozen=True)
class ModelStore:
    """The artifacts below one folder, read when used."""

    spark: SparkSession
    folder: str

    def linear(self, name: str) -> DataFrame:
        return art.read_artifact(self.spark, f"{self.folder}/{name}", art.LINEAR)

    def trees(self, name: str) -> DataFrame:
        return art.read_artifact(self.spark, f"{self.folder}/{name}", art.TREES)

    def bundle(self) -> DataFrame:
        return art.read_artifact(self.spark, f"{self.folder}/bundle", art.BUNDLE)

    def score_integrity(self, z: DataFrame) -> DataFrame:
        """Blended scores, ranks, tiers and drivers from the stored weights."""
        row = self.linear("integrity").first()
        return ml.rescore_with(list(row.coef[0]), row.intercept[0], z)

    def score_category(self, offline: DataFrame) -> DataFrame:
        """Most probable category and its probability."""
        rows = art.apply_logistic(offline, self.linear("category"), ref.MCC_FEATURES, "_p")
        classes = self.linear("category").first().classes
        best = F.array_max("_p")
        names = F.array(*[F.lit(c) for c in classes])
        return rows.withColumn("category_probability", best).withColumn(
            "category", F.element_at(names, F.array_position("_p", best).cast("int"))
        ).drop("_p")

    def score_head(self, offline: DataFrame) -> DataFrame:
        """Score 0 to 100 of the boosted head."""
        rows = art.apply_trees(offline, self.trees("head"), ref.HEAD_FEATURES, "_p")
        return rows.withColumn("head_score", F.col("_p") * 100).drop("_p")


def export_integrity(merchants: DataFrame, folder: str, clean: str = "is_clean") -> DataFrame:
    """Fit and store the integrity model; returns the merchants with its z columns."""
    model, z = ml.fit_integrity_model(merchants, clean)
    flagged = ml.rescore(model, z).agg(*binary_metrics(F.col("model_flag") == 1, ~F.col(clean))).first()
    metrics = {k: v for k, v in flagged.asDict().items() if v is not None}
    artifact = art.logistic_artifact(z.sparkSession, model, Z_FEATURES, ["clean", "violation"], metrics)
    art.write_artifact(artifact, f"{folder}/integrity")
    return z


def export_models(
    merchants: DataFrame, offline: DataFrame, folder: str, target: str = "behavior_mcc", declared: str = "declared_mcc",
    abuse: str = "abuse", clean: str = "is_clean", trees: int = 100,
) -> tuple[ModelStore, DataFrame]:
    """Fit all three models and store their artifacts and the bundle; the store and the z columns."""
    spark = offline.sparkSession
    z = export_integrity(merchants, folder, clean)
    model, labels, scored = ml.fit_mcc_model(offline, target)
    centre, scale = art.standardising(offline.filter(F.col(target).isNotNull()), ref.MCC_FEATURES)
    metrics = ml.mcc_metrics(scored, labels, declared, abuse).first().asDict()
    known = {k: v for k, v in metrics.items() if v is not None}
    art.write_artifact(art.logistic_artifact(spark, model, ref.MCC_FEATURES, labels, known, centre, scale), f"{folder}/category")
    head, _ = ml.fit_gbt_head(offline, abuse, trees)
    art.write_artifact(art.tree_artifact(spark, head, ref.HEAD_FEATURES), f"{folder}/head")
    names = {n: n for n in ("integrity", "category", "head")}
    art.write_artifact(art.model_bundle(spark, names, live.ENSEMBLE_WEIGHTS, ref.MODEL_TIERS), f"{folder}/bundle")
    return ModelStore(spark, folder), z
