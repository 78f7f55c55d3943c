"""Fitted models as one-row tables: written as JSON, read back, applied without the model class.

A linear model is its centre, scale, coefficients and intercepts; an ensemble of trees is
a node table, one array per tree. Applying either is column expressions over the row of
the artifact, which is joined once (one row, however many are scored).
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantscope.session import run_folder

LINEAR = ("features array<string>, classes array<string>, centre array<double>, scale array<double>, "
          "coef array<array<double>>, intercept array<double>, metrics map<string,double>")
TREES = ("features array<string>, depth int, trees array<struct<weight:double,"
         "nodes:array<struct<feature:int,threshold:double,left:int,right:int,value:double>>>>")
BUNDLE = "schema string, artifacts map<string,string>, ensemble_weights map<string,double>, tier_cuts map<string,double>"


def logistic_artifact(
    spark: SparkSession, model: LogisticRegressionModel, features: list[str], classes: list[str], metrics: dict,
    centre: list[float] | None = None, scale: list[float] | None = None,
) -> DataFrame:
    """One row with everything needed to apply the model to ``features`` as they stand."""
    matrix = [[float(x) for x in row] for row in model.coefficientMatrix.toArray()]
    intercepts = [float(x) for x in model.interceptVector.toArray()]
    row = (features, classes, centre or [0.0] * len(features), scale or [1.0] * len(features), matrix, intercepts,
           {k: float(v) for k, v in metrics.items()})
    return spark.createDataFrame([row], LINEAR)


def standardising(df: DataFrame, cols: list[str]) -> tuple[list[float], list[float]]:
    """Centre and scale that ``ml.standardised`` applies to the columns."""
    row = df.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    return list(row[: len(cols)]), [s if s and s > 0 else 1.0 for s in row[len(cols) :]]


def tree_artifact(spark: SparkSession, model: GBTClassificationModel, features: list[str]) -> DataFrame:
    """One row with the node table of a boosted ensemble; children that are no nodes are -1."""
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}/ensemble"
    model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.struct(
            node["id"].alias("id"),
            node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["prediction"].alias("value"),
        ).alias("node"),
        node["split"]["numCategories"].alias("categories"),
    )
    if nodes.filter("categories >= 0").limit(1).count():
        raise ValueError("splits on categories have no threshold")
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    each = nodes.groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    trees = each.agg(F.array_sort(F.collect_list(F.struct("tree", "nodes"))).alias("trees"))
    return trees.select(
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(max(t.depth for t in model.trees)).alias("depth"),
        F.transform("trees", lambda t: F.struct(
            F.get(weights, t["tree"]).alias("weight"),
            F.transform(t["nodes"], lambda n: n.dropFields("id")).alias("nodes"),
        )).cast("array<struct<weight:double,nodes:array<struct<feature:int,threshold:double,left:int,right:int,value:double>>>>").alias("trees"),
    )


def model_bundle(spark: SparkSession, artifacts: dict[str, str], weights: dict[str, float], tiers) -> DataFrame:
    """One row naming the model artifacts with ensemble weights and tier cuts."""
    row = ("merchantscope.models/v1", artifacts, dict(weights), {n: float(c) for n, c in tiers})
    return spark.createDataFrame([row], BUNDLE)


def write_artifact(artifact: DataFrame, path: str) -> None:
    """As one JSON line; doubles keep all their digits."""
    artifact.coalesce(1).write.mode("overwrite").json(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _with_artifact(df: DataFrame, artifact: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(artifact.select(F.struct("*").alias("_model"))))


def _inputs(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])


def apply_logistic(df: DataFrame, artifact: DataFrame, features: list[str], out: str = "probability") -> DataFrame:
    """Add the probability of each class; one row of coefficients stands for two classes."""
    scaled = F.zip_with(
        F.zip_with(_inputs(features), F.col("_model.centre"), lambda x, m: x - m), F.col("_model.scale"), lambda x, s: x / s
    )

    def dot(weights: Column) -> Column:
        return F.aggregate(F.zip_with(F.col("_x"), weights, lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)

    margins = F.zip_with(F.transform("_model.coef", dot), F.col("_model.intercept"), lambda m, b: m + b)
    with_margins = _with_artifact(df, artifact).withColumn("_x", scaled).withColumn("_margins", margins)
    both = F.when(F.size("_margins") == 1, F.array(-F.col("_margins")[0], F.lit(0.0))).otherwise(F.col("_margins"))
    powers = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
    total = F.aggregate("_powers", F.lit(0.0), lambda a, v: a + v)
    return (
        with_margins.withColumn("_margins", both).withColumn("_powers", powers)
        .withColumn(out, F.transform("_powers", lambda p: p / total))
        .drop("_model", "_x", "_margins", "_powers")
    )


def apply_trees(df: DataFrame, artifact: DataFrame, features: list[str], out: str = "probability") -> DataFrame:
    """Add the probability of the positive class: each tree is walked from its root, a node a step."""

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree["nodes"], at)
            low = F.get(F.col("_x"), node["feature"]) <= node["threshold"]
            return F.when(node["left"] < 0, at).when(low, node["left"]).otherwise(node["right"])

        return F.aggregate(F.col("_steps"), F.lit(0), step)

    margin = F.aggregate("_model.trees", F.lit(0.0), lambda a, t: a + t["weight"] * F.get(t["nodes"], leaf(t))["value"])
    steps = F.when(F.col("_model.depth") > 0, F.sequence(F.lit(1), F.col("_model.depth"))).otherwise(F.array().cast("array<int>"))
    return (
        _with_artifact(df, artifact).withColumn("_x", _inputs(features)).withColumn("_steps", steps)
        .withColumn(out, 1.0 / (1.0 + F.exp(-2.0 * margin))).drop("_model", "_x", "_steps")
    )
