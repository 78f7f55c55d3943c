"""Personal data by weak supervision.

Fixed patterns give base spans. Wider patterns give candidates of further kinds, and
labelers vote on every candidate and base span (+1, -1 or nothing): how strict its form
is, a check digit or value range, gazetteers, and words around it. Expectation
maximisation estimates each labeler's reliability from the counts of vote patterns over
the whole corpus (their number is bounded by the labelers, not by the data); the
posteriors then train a logistic span classifier on votes and form, which decides what
candidates join the base spans. Every pair of neighbouring capitalised words is a
candidate for a name; of accepted ones that share a word the better score stays.

Edge cases: a null text is an empty one; repeated rows get a result each; empty tables
give empty results; without candidates nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, arrow_type, stage_table, table

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["written_email", "local_phone", "national_id", "iban", "ipv6", "person"]
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDER = {
    "written_email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,64})+"),
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "person": re.compile(r"(?<!\w)(?=([A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20})(?!\w))"),
}
_GIVEN_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica "
    "thomas sarah charles karen anna peter maria jose hans pierre marie juan carlos sofia laura paul daniel emma lucas".split()
)
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl".split())
_CONTEXT = {
    "email": "mail email contact write", "written_email": "mail email contact write", "ip": "ip address host server",
    "ipv6": "ip address host server", "card": "card visa credit payment mastercard", "phone": "call phone tel mobile fax",
    "local_phone": "call phone tel mobile fax", "national_id": "ssn social security id", "iban": "iban account bank transfer",
    "person": "mr mrs ms dr name contact dear",
}
_AGAINST = frozenset("version order invoice isbn part model serial chapter figure table".split())
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _mod97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, by kind, then start."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def votes(kind: str, found: str, before: str, after: str) -> list[int]:
    """Form, validity, gazetteer and context labelers: 1, -1 or 0."""
    digits = re.sub(r"[^0-9]", "", found)
    form = {"email": 1, "phone": 1 if re.search(r"[ ()-]", found) else 0, "local_phone": 1 if found[0] == "(" else 0,
            "national_id": 1, "iban": 1 if " " not in found or len(found.split()[0]) == 4 else -1,
            "person": -1 if found.split()[0].lower() in _CONTEXT["person"].split() else 0, "written_email": 1}.get(kind, 1)
    valid = 0
    if kind == "card":
        valid = 1 if luhn(digits) else -1
    elif kind == "iban":
        valid = 1 if _mod97(found) else -1
    elif kind == "national_id":
        valid = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "local_phone":
        valid = 1 if digits[0] not in "01" else -1
    elif kind == "ip":
        valid = -1 if found.split(".")[0] in ("0", "127", "255") else 1
    known = 0
    if kind in ("email", "written_email"):
        known = 1 if re.findall(r"[a-z]+", found.lower())[-1:][0] in _TOP_DOMAINS else -1
    elif kind == "person":
        known = 1 if found.split()[0].lower() in _GIVEN_NAMES else -1
    elif kind == "iban":
        known = 1 if found[:2] in _COUNTRIES else -1
    near = set(re.findall(r"[a-z]+", (before + " " + after).lower()))
    context = 1 if near & set(_CONTEXT[kind].split()) else -1 if near & _AGAINST else 0
    return [form, valid, known, context]


def pattern_of(kind: int, vote: list[int], length: int) -> int:
    """One number for kind, votes and length class."""
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return code * 3 + (length > 12) + (length > 20)


def unpack(code: int) -> tuple[int, list[int], int]:
    size, vote = code % 3, []
    code //= 3
    for _ in range(4):
        vote.append(code % 3 - 1)
        code //= 3
    return code, vote[::-1], size


def spans_of(text: str) -> tuple[list, list]:
    """Base spans, and candidates outside them: (kind, start, end, vote pattern)."""
    base = base_spans(text)
    wider = [(KINDS.index(k), *m.span(p.groups)) for k, p in _WIDER.items() for m in p.finditer(text)]
    # of the base spans that start before a candidate ends, the one that reaches farthest tells
    by_start = sorted((b[1], b[2]) for b in base)
    starts, reach = [s for s, _ in by_start], [0, *accumulate((e for _, e in by_start), max)]
    wider = [x for x in wider if reach[bisect_left(starts, x[2])] <= x[1]]

    def judged(x: tuple[int, int, int]) -> tuple[int, int, int, int]:
        kind, start, end = x
        vote = votes(KINDS[kind], text[start:end], text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS])
        return (*x, pattern_of(kind, vote, end - start))

    return [judged(x) for x in base], [judged(x) for x in wider]


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "pattern")])
_FOUND = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("wider", T.ArrayType(_SPAN))])


def find_spans(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored doc_id, base, wider of every row."""

    def fn(texts: list[bytes]) -> list[dict]:
        names = ("kind", "start", "end", "pattern")
        out = []
        for t in texts:
            base, wider = spans_of(t.decode("utf-8", "replace"))
            out.append({"base": [dict(zip(names, x)) for x in base], "wider": [dict(zip(names, x)) for x in wider]})
        return out

    found = annotate(docs, text, fn, _FOUND, [id_])
    return stage_table(found.select(F.col(f"row.{id_}").alias("doc_id"), "res.base", "res.wider"), "pii_spans")


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and (labeler, class, vote) probabilities."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kinds, vote = (np.array(x) for x in zip(*[unpack(c)[:2] for c in codes]))
    post = 1 / (1 + np.exp(-1.5 * vote.sum(1)))
    for _ in range(rounds):
        rate = np.zeros((4, 2, 3))
        for labeler in range(4):
            for v in range(3):
                hit = vote[:, labeler] == v - 1
                rate[labeler, :, v] = (n[hit] * (1 - post[hit])).sum() + 1, (n[hit] * post[hit]).sum() + 1
            # a labeler is taken to be no worse than chance: its votes point the way they say
            share = rate[labeler] / rate[labeler].sum(1, keepdims=True)
            share[1, 2], share[0, 2] = max(share[:, 2]), min(share[:, 2])
            share[1, 0], share[0, 0] = min(share[:, 0]), max(share[:, 0])
            rate[labeler] = share / share.sum(1, keepdims=True)
        logit = np.zeros(len(codes))
        for kind in np.unique(kinds):
            own = kinds == kind
            prior = ((n * post)[own].sum() + 1) / (n[own].sum() + 2)
            logit[own] = np.log(prior / (1 - prior))
        for labeler in range(4):
            logit += np.log(rate[labeler, 1, vote[:, labeler] + 1] / rate[labeler, 0, vote[:, labeler] + 1])
        post = 1 / (1 + np.exp(-logit))
    return dict(zip(codes, post.tolist())), rate


def _features(code: int) -> np.ndarray:
    kind, vote, size = unpack(code)
    x = np.zeros(len(KINDS) + 12 + 3)
    x[kind] = 1
    for i, v in enumerate(vote):
        x[len(KINDS) + 3 * i + v + 1] = 1
    x[len(KINDS) + 12 + size] = 1
    return x


def span_classifier(counts: dict[int, int], posterior: dict[int, float], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights trained on the posteriors as soft labels (Newton steps)."""
    codes = sorted(counts)
    x = np.stack([_features(c) for c in codes])
    n, y = (np.array([d[c] for c in codes], float) for d in (counts, posterior))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        hessian = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, gradient)
    return w


def accepted_patterns(found: DataFrame, threshold: float = 0.5) -> dict[int, float]:
    """Patterns whose candidates the trained classifier accepts, with their scores."""
    rows = found.select(F.explode(F.concat("base", "wider")).alias("s")).groupBy("s.pattern").agg(F.count("*").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}  # bounded by kinds x 3^4 votes x 3 lengths
    if not counts:
        return {}
    w = span_classifier(counts, reliabilities(counts)[0])
    scores = {c: float(1 / (1 + np.exp(-(_features(c) @ w)))) for c in counts}
    return {c: p for c, p in scores.items() if p >= threshold}


def settled(spans: list[dict], scores: dict[int, float]) -> list[dict]:
    """Accepted candidates of a text without overlaps inside a kind: the better score stays, then the earlier start.

    Only neighbours by start can overlap: a name shares a word with the next pair at most, other kinds have no overlaps.
    """
    spans = sorted((s for s in spans if s["pattern"] in scores), key=lambda s: (s["kind"], s["start"]))
    kept = [False] * len(spans)

    def clash(i: int, j: int) -> bool:
        return 0 <= j < len(spans) and kept[j] and spans[i]["kind"] == spans[j]["kind"] and spans[i]["start"] < spans[j]["end"] and spans[j]["start"] < spans[i]["end"]

    for i in sorted(range(len(spans)), key=lambda i: (-scores[spans[i]["pattern"]], i)):
        kept[i] = not (clash(i, i - 1) or clash(i, i + 1))
    return [s for s, k in zip(spans, kept) if k]


def personal_spans(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and all spans as arrays of (kind, start, end), by kind, then start."""
    found = find_spans(docs, id_, text)
    shared = docs.sparkSession.sparkContext.broadcast(accepted_patterns(found))
    span = T.StructType(_SPAN.fields[:3])
    kind = T.ArrayType(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end")

        def plain(spans: list[dict]) -> list[dict]:
            return [{n: s[n] for n in names} for s in spans]

        for batch in batches:
            base, wider = batch.column("base").to_pylist(), batch.column("wider").to_pylist()
            every = [
                sorted(plain(b) + plain(settled(w, shared.value)), key=lambda s: (s["kind"], s["start"], s["end"]))
                for b, w in zip(base, wider)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([plain(b) for b in base], arrow_type(kind)), pa.array(every, arrow_type(kind))],
                names=["doc_id", "base", "spans"],
            )

    schema = T.StructType([T.StructField("doc_id", found.schema["doc_id"].dataType), T.StructField("base", kind), T.StructField("spans", kind)])
    return found.mapInArrow(run, schema)


def _is(kind: int):
    return lambda x: x["kind"] == kind


def op8_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
