"""The mix against plain Python, on sources full of unnamed and repeated rows."""

import hashlib
import math

import pytest
from pyspark.sql import Row

from merchantscope.llm import mixing


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n)) if n else None


def expected(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    """Words taken per source and size of the targets, and per row of the shuffled streams."""
    sizes = [(i, s, len((t or "").split())) for i, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s))
    total = {s: sum(n for _, x, n in sizes if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    want, target, open_ = share * sum(total.values()), {}, set(names)
    while open_:
        level = (want - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if epochs * total[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(epochs * total[s]) for s in over}
        open_ -= over
    block = min(4096, max(1, int(sum(target.values())) >> 20))
    low, ends = 0, []
    for s in names:
        width = math.floor(target[s] * float(mixing.POINTS) / want)
        ends.append((low, low + width, s))
        low += width
    slots = dict.fromkeys(names, 0)
    for k in range(math.ceil(sum(target.values()) / block)):
        u = ((k % mixing.POINTS) * mixing.GOLDEN % mixing.POINTS) * low // mixing.POINTS
        slots[next(s for a, b, s in ends if a <= u < b)] += 1
    out = []
    for s in names:
        key = [(int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16), i is not None, i or 0, n, i) for i, x, n in sizes if x == s]
        at, upto = 0, slots[s] * block
        for *_, n, i in sorted(key):
            out.append((str(i), n, total[s], max(0, min(n, upto - at)) + max(0, min(n, upto - at - total[s]))))
            at += n
    return target, sorted(out)


@pytest.mark.parametrize("dealt", [65536, 7])
def test_against_python(docs_of, monkeypatch, dealt):
    """A hot source, a third of its rows unnamed, one row 300 times; runs and pieces of the smallest size."""
    monkeypatch.setattr(mixing, "PIECE", 4)
    monkeypatch.setattr(mixing, "RUN", 3)
    monkeypatch.setattr(mixing, "DEALT", dealt)
    rows = [(i, words(1 + i % 17), "hot") for i in range(300)] + [(None, words(i % 5), "hot") for i in range(300)]
    rows += [(9999, words(6), "hot")] * 300 + [(2000 + i, words(3 + i % 7), f"s{i % 4}") for i in range(80)] + [(1, words(4), None), (3000, "", "none")]
    target, want = expected(rows)
    per_epoch = mixing.mixed(docs_of(rows)).collect()
    taken = {}
    for r in per_epoch:
        key = (r.source_size, r.row, str(r.doc_id), r["size"])
        taken[key] = taken.get(key, 0) + r.taken
    assert sorted((i, n, total, t) for (total, _, i, n), t in taken.items()) == want
    assert {round(r.target, 6) for r in per_epoch} == {round(t, 6) for t in target.values()}


def test_rows_of_a_source_have_places_of_their_own(docs_of):
    docs = docs_of([(None, words(3), "a")] * 50 + [(5, words(3), "a")] * 50 + [(6, None, "a")] * 5)
    sizes = mixing.stage_table(mixing.word_sizes(docs), "sizes")
    streams = mixing.source_streams(sizes, mixing.source_targets(sizes)).collect()
    assert sorted(r.row for r in streams) == list(range(1, 106))
    assert sorted(r.at for r in streams if r["size"]) == list(range(0, 300, 3))
    assert isinstance(streams[0], Row)


def test_documents_of_the_mix_against_their_shares(docs_of):
    """A document stays once for each pass that takes half of its words or more; one without words stays once."""
    rows = [(i, words(2 + i % 9), f"s{i % 3}") for i in range(200)] + [(500, None, "s0")]
    docs = docs_of(rows)
    per_epoch = mixing.mixed(docs).collect()
    uses = {}
    for r in per_epoch:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + (r.taken * 2 >= r["size"] if r["size"] else r.epoch == 0)
    got = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in uses.items() if n}
    assert mixing.mix_documents(docs_of([])).count() == 0
