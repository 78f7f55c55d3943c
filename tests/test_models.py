"""Trained models against brute force: splits, held-out metrics, importance, artifacts."""

import numpy as np
import pytest

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler

from merchantscope.operators import artifacts as art, ml
from merchantscope.plans import ml_queries as mq, models
from starbook.benches import workbench

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def offline(spark):
    return mq.offline(workbench(spark, FOLDER))


def test_split_takes_the_share_of_every_class(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(200)] + [(500, "c"), (501, "d"), (502, "d")]
    df = spark.createDataFrame(rows, "merchant_id long, cls string")
    got = ml.stratified_split(df, "merchant_id", "cls", 0.75, 1).toPandas()
    share = got.groupby("cls").is_train.agg(["sum", "size"])
    assert share.loc["a"].tolist() == [135, 180] and share.loc["b"].tolist() == [15, 20]
    assert share.loc["c"].tolist() == [1, 1] and share.loc["d"].tolist() == [1, 2]


def test_boosted_head_metrics(spark, offline):
    model, scored = ml.fit_gbt_head(offline, "abuse", trees=5)
    got = ml.head_metrics(scored, 50.0).first()
    held = scored.filter("NOT is_train").select("score", "label").toPandas()
    s, y = held.score.to_numpy(), held.label.to_numpy() == 1
    tp, fp, fn = (s[y] >= 50).sum(), (s[~y] >= 50).sum(), (s[y] < 50).sum()
    assert (got.tp, got.fp, got.fn) == (tp, fp, fn)
    wins = (s[y][:, None] > s[~y]) + 0.5 * (s[y][:, None] == s[~y])
    assert got.roc_auc == pytest.approx(wins.mean())
    levels = np.unique(s)[::-1]
    recall = [0.0, *[(s[y] >= t).sum() / y.sum() for t in levels]]
    precision = [(y & (s >= t)).sum() / (s >= t).sum() for t in levels]
    assert got.pr_auc == pytest.approx(sum((b - a) * p for a, b, p in zip(recall, recall[1:], precision)))
    shares = ml.tree_importance(model, spark).toPandas()
    assert shares.importance.sum() == pytest.approx(1) and (shares.importance >= 0).all()


def test_category_metrics(offline):
    model, labels, scored = ml.fit_mcc_model(offline)
    got = ml.mcc_metrics(scored, labels, "declared_mcc", "abuse").first()
    rows = scored.select("probability", "label", "prediction", "is_train", "declared_mcc", "abuse").collect()
    held = [r for r in rows if not r.is_train]
    assert {r.label for r in held} == {r.label for r in rows}  # every class is held out as well
    better = [sum(p > r.probability[int(r.label)] for p in r.probability) for r in held]
    assert got.top1_accuracy == pytest.approx(np.mean([b < 1 for b in better]))
    assert got.top3_accuracy == pytest.approx(np.mean([b < 3 for b in better]))
    wrong = [(labels[int(r.prediction)] != r.declared_mcc, r.abuse) for r in rows]
    assert got.mismatch_recall == pytest.approx(np.mean([w for w, a in wrong if a]))


def test_stored_artifacts_score_as_the_models_do(spark, offline, tmp_path):
    """All three models are fitted, written, read back and applied to every row."""
    bench = workbench(spark, FOLDER)
    store, z = models.export_models(mq.clean_merchants(bench), offline, str(tmp_path), trees=5)
    head, scored = ml.fit_gbt_head(offline, "abuse", trees=5)
    want = {r.merchant_id: r.score for r in scored.select("merchant_id", "score").collect()}
    got = {r.merchant_id: r.head_score for r in store.score_head(offline).collect()}
    assert got.keys() == want.keys() and max(abs(got[m] - want[m]) for m in want) < 1e-9
    assert len({round(x, 6) for x in got.values()}) > 10 and len(store.trees("head").first().trees) == 5
    model, labels, scored = ml.fit_mcc_model(offline)
    best = {r.merchant_id: (labels[int(r.prediction)], max(r.probability)) for r in scored.collect()}
    for r in store.score_category(offline).collect():
        assert abs(r.category_probability - best[r.merchant_id][1]) < 1e-9
        assert r.category == best[r.merchant_id][0]
    fitted, _ = ml.fit_integrity_model(mq.clean_merchants(bench))
    same = ["merchant_id", "model_score", "model_percentile", "model_tier", "model_flag"]
    assert sorted(store.score_integrity(z).select(*same).collect()) == sorted(ml.rescore(fitted, z).select(*same).collect())
    bundle = store.bundle().first()
    assert set(bundle.artifacts) == {"integrity", "category", "head"} and bundle.tier_cuts["High"] == 80.0


def test_two_class_and_single_leaf_models_apply(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), float(i > 9)) for i in range(20)], "a double, b double, label double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    linear = LogisticRegression(regParam=0.1).fit(ready)
    path = str(tmp_path / "linear")
    art.write_artifact(art.logistic_artifact(spark, linear, ["a", "b"], ["no", "yes"], {}), path)
    got = art.apply_logistic(rows, art.read_artifact(spark, path, art.LINEAR), ["a", "b"], "p").select("a", "p").collect()
    want = {r.a: r.probability for r in linear.transform(ready).collect()}
    assert all(abs(r.p[k] - want[r.a][k]) < 1e-12 for r in got for k in (0, 1))
    stump = GBTClassifier(maxIter=2, maxDepth=0).fit(ready)
    path = str(tmp_path / "stump")
    art.write_artifact(art.tree_artifact(spark, stump, ["a", "b"]), path)
    got = art.apply_trees(rows, art.read_artifact(spark, path, art.TREES), ["a", "b"], "p").select("a", "p").collect()
    want = {r.a: r.probability[1] for r in stump.transform(ready).collect()}
    assert all(abs(r.p - want[r.a]) < 1e-12 for r in got)
