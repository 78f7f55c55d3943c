import math
import re
import zlib
from collections import Counter

import numpy as np

from merchantscope.llm import quality
from merchantscope.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out(spark):
    rows = {r.doc_id: r for r in queries()["op2_quadratic_quality"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    ids = [d for d in labels if d in rows and rows[d].held_out]
    score, label = np.array([rows[d].score for d in ids]), np.array([labels[d] for d in ids])
    print("held-out auc", auc(score, label), "accuracy", np.mean((score >= 0.5) == label), len(ids))
    assert auc(score, label) > 0.97 and np.mean((score >= 0.5) == label) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels.quality) * (~quality.learnable("doc_id")).cast("int") + labels.quality * quality.learnable("doc_id").cast("int"))
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert a == b


def test_density_by_hand():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(c, 1 + c, (500, len(quality.STATISTICS))) for c in (0, 1)}
    moments = {c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}
    model = quality.Discriminant(moments, pooled=0.0, identity=0.0)
    point = rng.normal(0, 1, (5, len(quality.STATISTICS)))
    log = []
    for c in (0, 1):
        cov = np.cov(x[c].T)
        d = point - x[c].mean(0)
        log.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1), (2, None), (77, 1)], "doc_id long, quality int")
    docs = docs_of(odd_rows)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, labels.filter("doc_id > 5"))
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)  # one class: all alike
    assert quality.quality_scores(docs_of([]), labels).count() == 0


def plain_statistics(text):
    """The statistics of one text, byte by byte."""
    raw = (text or "").encode()
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 or b >= 128 for b in raw)
    digits, plain, marks = (sum(b in group for b in raw) for group in (b"0123456789", b".,;:'\"()-", b"!?"))
    solid = max(1, sum(b > 32 and b != 127 for b in raw))
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    n, some = len(w), max(1, len(w))

    def share(a, b):
        return math.asin(math.sqrt(a / b))

    signs = sum(33 <= b < 127 for b in raw) - sum(65 <= b < 91 or 97 <= b < 123 for b in raw) - digits - plain - marks
    out = [
        math.log1p(n), math.log1p(len(raw)), math.log1p(sum(map(len, w)) / some), share(upper, max(1, upper + lower)),
        share(digits, solid), share(plain, solid), share(marks, solid), share(signs, solid), share(len(set(w)), some),
        share(sum(a == b for a, b in zip(w, w[1:])), some), share(max(Counter(w).values(), default=0), some),
        share(sum(len(x) <= 3 for x in w), some), math.log1p(n / (raw.count(b"\n") + 1)),
        share(sum(x[-1] in b".!?:" for x in w), some), share(sum(97 <= x[-1] < 123 or x[-1] >= 128 for x in w), some),
    ]
    return np.round(np.array(out) * 1024) / 1024


def plain_scores(rows, labels):
    """Score of each (id, text): densities with inverses and determinants instead of factors."""
    given = {}
    for i, y in labels:
        if y is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            given.setdefault(i, []).append(y)
    x = np.array([plain_statistics(t) for _, t in rows])
    y = np.array([-1 if i not in given else int(np.mean(given[i]) >= 0.5) for i, _ in rows])
    part = {c: x[y == c] for c in (0, 1)}
    scatter = {c: (v - v.mean(0)).T @ (v - v.mean(0)) for c, v in part.items()}
    common = (scatter[0] + scatter[1]) / (len(part[0]) + len(part[1]) - 2)
    scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
    density = {}
    for c, v in part.items():
        cov = (0.8 * scatter[c] / (len(v) - 1) + 0.2 * common) / np.outer(scale, scale)
        cov = 0.98 * cov + 0.02 * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = (x - v.mean(0)) / scale
        density[c] = math.log(len(v) / (len(part[0]) + len(part[1]))) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def test_whole_table_against_brute_force(spark):
    """The query on the whole smallest table, and the stage that keeps what it predicts as good."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip((i for i, _ in rows), plain_scores(rows, [(r.doc_id, r.quality) for r in labels.collect()])))
    got = queries()["op2_quadratic_quality"](spark, folder).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, s in want.items() if s >= 0.5}


def test_statistics_of_odd_texts(odd_rows):
    texts = [t for _, t, *_ in odd_rows] + ["É!? A-b (c)\tx\x7f\x0by", "ZZ zz zz", "a\n\nb"]
    got = quality.statistics([(t or "").encode() for t in texts])
    assert np.array_equal(got, np.array([plain_statistics(t) for t in texts]))
