"""Fill-in-the-middle against a brute-force version; its SQL runs in test_corpus_sql."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from merchantscope.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    x = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((x[0] % (len(units) + 1), x[1] % (len(units) + 1)))
    if not text or any(m in text for m in infill.MARKERS) or x[2] % 100 >= 50:
        return doc_id, len(units), "plain", text, None, None, None
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if x[3] % 100 < 80 else "psm"
    return doc_id, len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", p, m, s


def test_every_row_as_by_hand(docs_of, odd_rows):
    odd = ["a $1 \\ b", " lead", "tail \t", "\n\r\v\f x y z", "<P", "< P><M", "x<M>y", "😀 é\x00ß $2", "<", "a<P b>S>", "\\E \\Q"]
    rows = [*odd_rows, *[(1000 + 50 * i + k, t, None) for i, t in enumerate(odd) for k in range(8)]]
    got = infill.fill_in_middle(docs_of(rows))
    back = got.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert sorted((tuple(r)[:7] for r in back), key=key) == want
    assert {r.form for r in back} == {"plain", "spm", "psm"}
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    assert all(r.back in texts[r.doc_id] for r in back)


def test_very_long_texts_match_in_one_pass(docs_of):
    long = [(i, "w " * 300_000 + " " * 200_000 + "end" + "\n" * 100_000) for i in range(4)]
    got = infill.fill_in_middle(docs_of(long), rewritten=100).collect()
    for r in got:
        assert r.n == 300_002 and r.prefix + r.middle + r.suffix == long[r.doc_id][1] and r.form != "plain"


def test_empty_table(docs_of):
    assert infill.fill_in_middle(docs_of([])).count() == 0


def test_other_markers_and_units(docs_of):
    got = infill.fill_in_middle(docs_of([(i, "ab$c" * i) for i in range(20)]), rewritten=100, markers=("$0", "\\1|", "[.]"), unit="(?s:.)")
    for r in got.collect():
        assert r.n == 4 * r.doc_id and (r.form == "plain") == (r.n == 0)
        assert r.n == 0 or r.prefix + r.middle + r.suffix == "ab$c" * r.doc_id


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("<P>", "<P>>", "z"), ("", "a", "b")])
def test_markers_that_run_together_are_refused(docs_of, markers):
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs_of([]), markers=markers)
