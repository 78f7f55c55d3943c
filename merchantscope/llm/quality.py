"""Document quality by a regularised quadratic discriminant.

Statistics of a text (lengths, shares of character and word classes, repetition) are
brought to a scale on which they spread evenly (logarithm for counts, arc sine root for
shares). Each class gets a mean and a covariance that is shrunk towards the pooled one
and then towards a multiple of the identity; the score is the logistic of the log-density
difference, from Mahalanobis distances by the classes' Cholesky factors, which are
computed once and travel with the model.

The fit takes sums and cross products over all labelled rows in one aggregation, so it
needs no sample. Statistics are rounded to 1/1024, which makes those sums exact and
reruns equal.

Edge cases: null and empty texts have statistics 0 and a score like any other; several
labels of an id are averaged (0.5 counts as good); ids without label only get scores;
with labels of one class, or none, the score is the smoothed share of class 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, stage_table, table
from .words import Words

#: Weights of the pooled covariance and of the identity.
POOLED, IDENTITY = 0.2, 0.02

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True  # capitals
_CLASSES[1, 97:123] = _CLASSES[1, 128:] = True  # small letters and beyond ASCII
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [ord(c) for c in ".,;:'\"()-"]] = True  # plain punctuation
_CLASSES[4, [ord(c) for c in "!?"]] = True
_CLASSES[5, 33:127] = ~(_CLASSES[:5, 33:127].any(0))  # other signs

STATISTICS = [
    "log_words", "log_bytes", "word_length", "capitals", "digits", "punctuation", "marks", "signs", "distinct",
    "same_as_last", "top_share", "short_words", "words_a_line", "sentence_words", "signless_words",
]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.stack([np.add.reduceat(_CLASSES[i][raw].astype(np.int32), edges[:-1]) for i in range(6)]).astype(float)
    lines = np.add.reduceat((raw == 10).astype(np.int32), edges[:-1]).astype(float)
    upper, lower, digits, plain, marks, signs = counts
    solid = np.maximum(counts.sum(0), 1)
    w = Words(texts)
    n = w.counts().astype(float)
    some = np.maximum(n, 1)
    length = (w.end - w.start).astype(float)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, values, len(texts))

    last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    repeat = np.zeros(len(w.hash))
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    # words of a text: sort by text, then hash; runs of equal pairs are the distinct words
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, int)
    run = np.diff(np.append(new, len(h)))
    distinct = np.bincount(d[new], minlength=len(texts)).astype(float)
    top = np.zeros(len(texts))
    np.maximum.at(top, d[new], run)

    def share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip(part / of, 0, 1)))

    ends_sentence = np.isin(last, [46, 33, 63, 58])
    letter_end = ((last >= 97) & (last <= 122)) | (last >= 128)
    out = np.stack(
        [
            np.log1p(n), np.log1p(np.diff(edges) - 1.0), np.log1p(per_doc(length) / some), share(upper, np.maximum(upper + lower, 1)),
            share(digits, solid), share(plain, solid), share(marks, solid), share(signs, solid), share(distinct, some),
            share(per_doc(repeat), some), share(top, some), share(per_doc(length <= 3), some), np.log1p(n / lines),
            share(per_doc(ends_sentence), some), share(per_doc(letter_end), some),
        ],
        1,
    )
    return np.round(out * 1024) / 1024


def document_statistics(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Stored (id, x) of every row."""
    kind = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = annotate(docs, text, lambda texts: [{"x": x} for x in statistics(texts).tolist()], kind, [id_])
    return stage_table(found.select(F.col(f"row.{id_}").alias("id"), F.col("res.x").alias("x")), "statistics")


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum and cross products, summed over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(y), -1)
            for label in np.unique(y):
                z = np.column_stack([np.ones((y == label).sum()), x[y == label]])
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([(z.T @ z).ravel().tolist()])], names=["label", "m"])

    parts = labelled.select(F.col("label").cast("int"), "x").mapInArrow(run, "label int, m array<double>")
    summed = parts.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    out = {}
    for label in {r["label"] for r in summed}:
        values = np.array([r["v"] for r in sorted((r for r in summed if r["label"] == label), key=lambda r: r["pos"])])
        full = values.reshape(len(STATISTICS) + 1, -1)
        out[label] = (full[0, 0], full[0, 1:], full[1:, 1:])
    return out


class Discriminant:
    """Class means, Cholesky factors and log priors; ``score`` gives the share of class 1."""

    def __init__(self, moments: dict, pooled: float = POOLED, identity: float = IDENTITY):
        self.n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        self.constant = None
        if min(self.n.values()) < 2:
            self.constant = (self.n[1] + 1) / (sum(self.n.values()) + 2)
            return
        means = {c: s / n for c, (n, s, _) in moments.items()}
        scatter = {c: ss - np.outer(s, s) / n for c, (n, s, ss) in moments.items()}
        total = sum(self.n.values())
        common = sum(scatter.values()) / (total - 2)
        scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
        self.parts = {}
        for c in (0, 1):
            own = (1 - pooled) * scatter[c] / (self.n[c] - 1) + pooled * common
            own = own / np.outer(scale, scale)
            own = (1 - identity) * own + identity * np.trace(own) / len(own) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.parts[c] = (means[c] / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(self.n[c] / total))
        self.scale = scale

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = {}
        for c, (mean, whiten, log_det, prior) in self.parts.items():
            z = (x / self.scale - mean) @ whiten.T
            density[c] = prior - log_det - 0.5 * (z * z).sum(1)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(found: DataFrame, labels: DataFrame, id_: str = "doc_id", label: str = "quality") -> Discriminant:
    """Fit on all of ``labels`` (rows without label are ignored)."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    return Discriminant(_moments(found.join(known, "id")))


def _scored(found: DataFrame, model: Discriminant) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shared.value.score(x))], names=["row", "score"])

    kind = found.schema["row"].dataType.simpleString()
    return found.mapInArrow(run, f"row {kind}, score double")


def learnable(id_: str) -> Column:
    """Ids whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def quality_scores(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are never read."""
    found = document_statistics(docs, id_, text)
    model = fit(found, labels.filter(learnable(id_)), id_)
    scored = _scored(found.select(F.struct("id").alias("row"), "x"), model)
    return scored.select(
        F.col("row.id").alias("doc_id"),
        (~learnable("row.id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that the classifier accepts, columns unchanged."""
    known = labels.filter(learnable(id_))
    named = known.filter(F.col("quality").isNotNull()).select(F.col(id_).alias("_label"))
    labelled = docs.select(id_, text).join(named, F.col(id_) == F.col("_label"), "left_semi")
    model = fit(document_statistics(labelled, id_, text), known, id_)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[bytes]) -> list[dict]:
        return [{"score": s} for s in shared.value.score(statistics(texts)).tolist()]

    kind = T.StructType([T.StructField("score", T.DoubleType())])
    return annotate(docs, text, judge, kind).filter("res.score >= 0.5").select("row.*")


def op2_quadratic_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
