import hashlib
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from merchantscope.llm import suffix
from merchantscope.llm.common import free_shuffles
from merchantscope.llm.queries import queries


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each row, window by window."""
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < doc:
                    gone[i] += 1
                    gone[i + length :][:1] -= 1
        mask = np.cumsum(gone)[: len(raw)] > 0
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        out.append((doc, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    found = suffix.removed_spans(docs, apply=suffix.kept_digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_odd_rows(docs_of, odd_rows):
    assert run(docs_of(odd_rows)) == brute(odd_rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op1_suffix_array_dedup"](spark, folder).collect()), key=str)
    assert got == brute(rows)


def test_heavy_keys_change_nothing(docs_of, odd_rows, monkeypatch):
    # every key that two stretches share counts as heavy: their windows travel alone
    docs = docs_of(odd_rows)
    named = docs.selectExpr("doc_id AS doc", "cast(text AS binary) AS text").filter("doc IS NOT NULL AND text IS NOT NULL")
    monkeypatch.setattr(suffix, "HEAVY_SHARE", 1)
    monkeypatch.setattr(suffix, "HEAVY_LEAST", 1)
    monkeypatch.setattr(suffix, "partitions_of", lambda spark: 10**9)
    heavy = suffix.heavy_keys(named, 50)
    assert len(heavy)
    monkeypatch.undo()
    monkeypatch.setattr(suffix, "heavy_keys", lambda docs, length: heavy)
    assert run(docs) == brute(odd_rows)


def test_stretches_cover_every_window():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 400, 3000)] + [b"q" * 700]
    found = suffix.Stretches(texts, 50, np.zeros(0, np.uint64))
    seen = defaultdict(list)
    for d, s, e in zip(found.doc, found.start, found.end):
        seen[d] += list(range(s, e - 49))
    assert all(sorted(seen[i]) == list(range(len(t) - 49)) for i, t in enumerate(texts) if len(t) >= 50)


def test_suffix_order_sorts_windows_and_lets_lone_ones_go(monkeypatch):
    """Sorting starts with one row a window; those whose first 8 bytes are theirs alone are not sorted again."""
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 123, 60, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, 64, dtype=np.uint8)) for _ in range(300)] + [b"head" + shared, shared + b"tail!"]
    ids = [*range(300), 400, 350]
    columns = [pa.array(ids), pa.array([i % 3 for i in range(300)] + [7, 7]), pa.array(range(302)), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc", "key", "hash", "bytes"])
    rows, once = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: rows.append(len(keys[0])) or once(keys))
    got = [r for b in suffix._suffix_order(iter([batch]), 50) for r in b.to_pylist()]
    assert [(r["doc"], r["kind"], r["a"], r["b"]) for r in got] == [(400, suffix.PART, 4, 64)]
    windows = sum(len(t) - 49 for t in texts)
    assert max(rows) <= windows and sum(rows[1:]) < windows


def test_empty(docs_of):
    assert run(docs_of([])) == []


def test_shuffles_that_fetched_stretches_go_before_the_texts_are_exchanged_again(spark, docs_of):
    """whether they stood beside the last exchange was left to the JVM's next collection."""
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    same = "the same passage of more than fifty bytes, word for word, in every text. "
    docs = docs_of([(i, f"{same}and {i} words of its own, {i * i} times over, {same}", "s") for i in range(40)]).repartition(3)
    free_shuffles(spark)
    time.sleep(1)
    before = known.size()
    lazy = suffix.removed_spans(docs)
    until = time.time() + 20
    while known.size() > before and time.time() < until:
        time.sleep(0.2)
    assert known.size() <= before
    assert lazy.count() == 40
