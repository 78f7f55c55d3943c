import re
import time

from merchantscope.llm import pii
from merchantscope.llm.queries import queries

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                twice = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


TEXTS = [
    "a.b@c.de x@y, x@@y.z a@b.c@d.e é.x@mail7.example.com. @q.w -@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 9999999.1.2.3.4 10.0.0.255.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000000000000000000 12345678901234567890123",
    "+1 (017) 555-7713 +12 +1234567 ++49 30 1234567-8) +1..2 +999999999999999999",
    "",
]


def test_base_spans():
    for text in TEXTS:
        assert pii.base_spans(text) == brute(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        pii.spans_of(text)


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries()["op8_weak_supervision_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute(texts[r.doc_id])]
        got = r.spans.split(",") if r.spans else []
        assert [x for x in got if x.split(":")[0] in pii.BASE_KINDS] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in pii.BASE_KINDS]


def test_method_adds_and_rejects(docs_of):
    good = "Please call (555) 234-5678 today. My ssn is 123-45-6789. Write to joe [at] mail [dot] com. iban DE89 3704 0044 0532 0130 00"
    bad = "Version order (055) 234-5678, serial 000-12-0000 figure. Lorem Ipsum dolor"
    rows = [(i, good) for i in range(40)] + [(100 + i, bad) for i in range(40)]
    found = {r.doc_id: {pii.KINDS[s.kind] for s in r.spans} for r in pii.personal_spans(docs_of(rows)).collect()}
    assert {"local_phone", "national_id", "written_email", "iban"} <= found[0]
    assert not found[100] & {"national_id", "person"}


def test_odd_rows(docs_of, odd_rows):
    assert pii.personal_spans(docs_of(odd_rows)).count() == len(odd_rows)
    assert pii.personal_spans(docs_of([])).count() == 0


def test_names_after_a_salutation(docs_of):
    texts = ["Dear John Smith we wrote", "please ask Contact Mary Jones today", "so Mr Peter Miller called", "Dear Mr Paul Anna Karen Black"]
    rows = [(4 * i + j, t) for i in range(30) for j, t in enumerate(texts)]
    found = {r.doc_id: [texts[r.doc_id % 4][s.start : s.end] for s in r.spans] for r in pii.personal_spans(docs_of(rows)).collect()}
    assert [found[i] for i in range(3)] == [["John Smith"], ["Mary Jones"], ["Peter Miller"]]
    places = [m.start() for x in found[3] for m in re.finditer(x, texts[3])]
    assert found[3] and all(b - a > len(x) for a, b, x in zip(places, places[1:], found[3]))


def test_neighbours_of_base_spans():
    text = "Ann Lee a@b.cd (555) 234-5678 +1 (555) 234-5678 Joe [at] mail [dot] com 1.2.3.4 " * 40
    base, wider = pii.spans_of(text)
    every = [(pii.KINDS.index(k), *m.span(p.groups)) for k, p in pii._WIDER.items() for m in p.finditer(text)]
    assert [x[:3] for x in wider] == [x for x in every if not any(x[1] < b[2] and b[1] < x[2] for b in base)]
    assert len(wider) < len(every)


def test_many_addresses_in_one_text():
    def took(n):
        start = time.process_time()
        base, wider = pii.spans_of("Ann Lee ann@mail.com " * n)
        assert len(base) == len(wider) == n
        return time.process_time() - start

    took(100)
    assert took(40_000) < 25 * took(4_000)  # ten times in proportion, a hundred times by comparing all
