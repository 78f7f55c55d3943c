"""Deleted interpolation against a version that counts in dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from merchantscope.llm import ngrams
from merchantscope.llm.queries import queries


def brute(rows, order=3, rounds=12, tolerance=1e-3):
    texts = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        crc = zlib.crc32(("null" if i is None else str(i)).encode())
        texts.append((i, -1 if crc % 5 == 1 else crc // 5 % 2, re.findall(r"[^\x20\x09-\x0D]+", low) + [None]))

    def gram(tokens, i, k):
        return tuple(tokens[j] if j >= 0 else 0 for j in range(i - k + 1, i + 1))

    counts = [[Counter() for _ in range(order + 1)] for _ in range(3)]
    for _, role, tokens in texts:
        for half in (role, 2) if role >= 0 else ():
            counts[half][0][()] += len(tokens)
            for k in range(1, order + 1):
                counts[half][k].update(gram(tokens, i, k) for i in range(len(tokens)))
                if k < order:
                    counts[half][k][(0,) * k] += 1

    def facts(half, tokens, i):
        seen = [counts[half][k - 1][gram(tokens, i - 1, k - 1)] for k in range(1, order + 1)]
        p = [1 / (cache[half] + 1)] + [counts[half][k][gram(tokens, i, k)] / seen[k - 1] if seen[k - 1] else 0 for k in range(1, order + 1)]
        return tuple(min(s.bit_length(), ngrams.LAST) for s in seen[1:]), p

    cache = [sum(g != (0,) and n > 0 for g, n in c[1].items()) for c in counts]
    trained = counts[2][0][()] > 0

    def usable(bucket):
        return [True, trained] + [b > 0 for b in bucket]

    weights = defaultdict(lambda: None)

    def weight(bucket):
        if weights[bucket] is None:
            use = usable(bucket)
            weights[bucket] = [u / sum(use) for u in use]
        return weights[bucket]

    events = [facts(1 - role, tokens, i) for _, role, tokens in texts if role >= 0 for i in range(len(tokens))]
    events = [(b, [p[0]] + [2 ** (-round(-ngrams.STEPS * math.log2(x)) / ngrams.STEPS) if x > 0 else 0 for x in p[1:]]) for b, p in events]
    for _ in range(rounds if events else 0):
        total = defaultdict(lambda: [0.0] * (order + 1))
        for b, p in events:
            share = [w * x for w, x in zip(weight(b), p)]
            for j in range(order + 1):
                total[b][j] += share[j] / sum(share)
        moved = 0
        for b in total:
            plus = [t + u for t, u in zip(total[b], usable(b))]
            new = [x / sum(plus) for x in plus]
            moved = max([moved, *(abs(x - y) for x, y in zip(new, weight(b)))])
            weights[b] = new
        if moved <= tolerance:
            break
    out = []
    n, v = counts[2][0][()], cache[2]
    for i, role, tokens in texts:
        base, score, known = 0.0, 0.0, 0
        for at in range(len(tokens)):
            c = counts[2][1][gram(tokens, at, 1)]
            known += c > 0
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            b, p = facts(2, tokens, at)
            score += math.log10(sum(w * x for w, x in zip(weight(b), p)))
        out.append((i, role < 0, len(tokens), known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted((tuple(r)[:5] + (round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_as_by_dictionaries(docs_of, odd_rows, monkeypatch, order):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(ngrams, "PART_TOKENS", 500)
    texts = [t for _, t, *_ in odd_rows if t and len(t) < 5000]
    rows = [(i, t[:2000] if t and len(t) > 5000 else t) for i, t, *_ in odd_rows]
    rows += [(100 + i, " ".join(texts[(i + j) % len(texts)][:300] for j in range(2))) for i in range(60)]
    assert rounded(ngrams.language_model_scores(docs_of(rows), order)) == brute(rows, order)


def test_probabilities_sum_to_one(docs_of, spark):
    """Over all known words and one unknown word, after a seen and an unseen context."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"], 12))) for i in range(80)]
    for context in ("a b", "a zz"):
        held = [(1000 + k, f"{context} {w}".strip()) for k, w in enumerate(["a", "b", "c", "d", "unknown"])] + [(2000, context)]
        marks = ngrams.F.when(ngrams.F.col("doc_id") >= 1000, ngrams.HELD).otherwise(ngrams.F.col("doc_id") % 2).cast("int")
        encoded = ngrams.encode(docs_of(rows + held), "doc_id", "text", marks)
        counts = ngrams.gram_counts(encoded, 2)
        model = ngrams.fit(counts)
        assert np.allclose(model.weights.sum(1), 1)
        # without the end: the end's own estimate is the rest
        scores = {r.doc_id: r for r in ngrams.score(counts, model).collect()}
        assert all(r.score < 0 for r in scores.values())
        assert ngrams.weight_table(spark, model).count() == ngrams.buckets(2)


def test_long_text_empty_table_and_nothing_to_learn(docs_of):
    long = [(i, "ab cd " * 200_000) for i in range(3)]
    got = ngrams.language_model_scores(docs_of(long)).collect()
    assert [r.n_tokens for r in got] == [400_001] * 3 and all(math.isfinite(r.score) for r in got)
    assert ngrams.language_model_scores(docs_of([])).count() == 0
    marks = ngrams.F.lit(ngrams.HELD)
    got = ngrams.language_model_scores(docs_of([(1, "a b"), (2, None)]), role=marks).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in got} == {(0.0, 0.0, 0, 0)}


def test_held_out_documents_gain_from_longer_contexts(spark):
    got = queries()["op12_deleted_interpolation_scores"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out & (got.n_tokens > 20)]
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert held.score.sum() > held.base_score.sum() and got.score.notna().all() and (got.score <= 0).all()


def test_table_as_by_dictionaries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rounded(queries()["op12_deleted_interpolation_scores"](spark, folder)) == brute(rows)
