"""Repeated byte strings by groups of equal windows in suffix buckets (no longest-previous-factor array is built).

A string of ``length`` bytes that also starts in a document with a smaller id is removed
where it occurs again. Suffixes meet in buckets before they are ordered: every window of
``length`` bytes is keyed by its smallest 16-byte gram hash, so equal windows, wherever
they are, share a bucket, and consecutive windows with one key form a *stretch* that
moves as a unit (about one per 18 bytes).

1. Each task reduces its stretches to the smallest id per (key, stretch hash) and settles
   the rest, so a passage that a third of all rows share leaves each task once.
2. Buckets are exchanged once. Equal stretches are one interval of the suffix order with
   a common prefix over their whole length: all but the smallest id are previous factors.
3. Stretches that differ but share a key (the borders of matches) fetch their bytes, and
   each bucket gets a suffix order of its windows, 8 bytes at a time; windows that are
   alone in their interval leave. Inside an interval of common prefix >= ``length`` a
   previous smaller position exists for all but the smallest id: their longest previous
   factor reaches ``length``.

A key that very many different stretches share (seen on a fixed share of the documents;
this only routes) has its stretches cut into single windows keyed by their own hash.

Edge cases: null and short texts lose nothing; rows without id neither remove nor lose
bytes; rows with one id never remove each other's bytes and get a result each; matches
never cross rows; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_shuffles, partitions_of, stage_table, table
from .words import U, mix

GRAM = 16
#: Windows of a stretch at most (longer ones are periodic text, cut from their start).
STRETCH = 64
#: Stretches that a task reduces at a time.
BLOCK = 1_500_000
#: Bytes of text per set of arrays: they stay in the processor's caches.
CHUNK = 1 << 17
#: One in so many ids shows which keys are heavy; a key is heavy beyond so many stretches.
HEAVY_SHARE, HEAVY_LEAST = 64, 10_000

_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(U(1), np.full(n, base)))


#: Powers for chunks of the usual size; a longer text gets its own.
_TABLES = (_powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK))


class Stretches:
    """Stretches of a chunk: ``doc`` (index), ``key``, ``hash``, ``start`` and ``end`` (bytes of the text)."""

    def __init__(self, texts: list[bytes], length: int, heavy: np.ndarray):
        raw = b"".join(texts)
        self.edges = np.cumsum([0] + [len(t) for t in texts])
        empty = np.zeros(0, np.int64)
        self.doc, self.key, self.hash, self.start, self.end = empty, empty, empty, empty, empty
        if len(raw) < length:
            return
        buf = np.frombuffer(raw, np.uint8)
        eight = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw, strides=(1,))
        gram = eight[:-8] * _BASE
        gram ^= gram >> U(29)
        gram += eight[8:]
        gram *= U(0xBF58476D1CE4E5B9)
        gram ^= gram >> U(32)
        gram *= U(0x94D049BB133111EB)
        least = _sliding_min(gram, length - GRAM + 1)
        n = len(least)
        # runs of one key; they start anew with each text and where no window fits any more
        new = np.ones(n + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:n])
        valid = np.ones(n, bool)
        for low, high in zip(self.edges[:-1], self.edges[1:]):
            stop = max(low, high - length + 1)
            valid[stop:high] = False
            new[min(low, n)] = new[min(stop, n)] = True
        single = np.isin(least, heavy) if len(heavy) else np.zeros(0, bool)
        if single.any():
            new[:n] |= single
        cut = np.flatnonzero(new)
        sizes = np.diff(cut)
        if len(sizes) and sizes.max() > STRETCH:
            new[:n] |= (np.arange(n) - np.repeat(cut[:-1], sizes)) % STRETCH == 0
            cut = np.flatnonzero(new)
        begin, last = cut[:-1], cut[1:] - 1
        fits = valid[begin]
        begin, last = begin[fits], last[fits]
        power, back = _TABLES if len(raw) < len(_TABLES[0]) else (_powers(_BASE, len(raw)), _powers(_INVERSE, len(raw)))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTES[buf] * power[: len(raw)], out=total[1:])
        start, end = begin, last + length
        digest = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        key = least[begin]
        if single.any():
            key = np.where(single[begin], mix(digest ^ U(0xA5A5A5A5A5A5A5A5)), key)
        self.doc = np.searchsorted(self.edges, begin, side="right") - 1
        self.key, self.hash = key.view(np.int64), digest.view(np.int64)
        self.start, self.end = start - self.edges[self.doc], end - self.edges[self.doc]


def _runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open ranges (touching ones join)."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.append(at[1:], len(ends)) - 1].tolist()))


_FIND = "doc long, key long, hash long, kind int, a int, b int"
_NAMES = ["doc", "key", "hash", "kind", "a", "b"]
#: Kinds of findings: stretch to compare, span of a text (key: its digest), whole stretch, request for bytes, part of a stretch.
OPEN, SPAN, WHOLE, WANTED, PART = range(5)


def _finding(doc, key, hash_, kind: int, a=None, b=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int32)
    columns = [doc, key, hash_, np.full(n, kind, np.int32), zero if a is None else np.asarray(a, np.int32), zero if b is None else np.asarray(b, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)


def _pair(key: np.ndarray, hash_: np.ndarray, doc: np.ndarray | int = 0) -> np.ndarray:
    """One 64-bit number for a stretch (of a text), to sort and look up by."""
    return (key.view(np.uint64) * _BASE) ^ hash_.view(np.uint64) ^ (np.asarray(doc).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def heavy_keys(docs: DataFrame, length: int) -> np.ndarray:
    """Keys of which the sampled ids have so many stretches that one task should not get them all."""
    spark = docs.sparkSession
    some = docs.filter(F.pmod(F.xxhash64("doc", F.lit("heavy")), F.lit(HEAVY_SHARE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks((x.as_py() for x in batch.column("text")), CHUNK):
                found = Stretches(part, length, np.zeros(0, np.uint64))
                distinct = np.unique(np.stack([found.key, found.hash]), axis=1) if len(found.key) else np.zeros((2, 0), np.int64)
                key, n = np.unique(distinct[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counts = stage_table(some.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HEAVY_LEAST, total * HEAVY_SHARE // (4 * partitions_of(spark))) / HEAVY_SHARE
    # at most 4 x partitions keys can pass the limit
    return np.array([r["key"] for r in counts.filter(F.col("n") > limit).collect()], np.int64).view(np.uint64)


def _reduced(docs: DataFrame, length: int, heavy) -> DataFrame:
    """OPEN stretches (smallest id per task) and SPANs that the task could settle."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, key, hash_, text, start, end = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(_pair(key, hash_))
        k, h, d = key[order], hash_[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(d, first)
        lowest = least[np.cumsum(new) - 1]
        yield _finding(least, k[first], h[first], OPEN)
        gone = order[d > lowest]
        if len(gone):
            gone = gone[np.lexsort((start[gone], text[gone], doc[gone]))]
            d, t, a, b = doc[gone], text[gone], start[gone], end[gone]
            # stretches overlap or touch their neighbours in the text: join them
            cut = np.ones(len(gone), bool)
            cut[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] > b[:-1])
            at = np.flatnonzero(cut)
            yield _finding(d[at], t[at], np.zeros(len(at), np.int64), SPAN, a[at], b[np.append(at[1:], len(cut)) - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, digests = (batch.column(c).to_numpy() for c in ("doc", "digest"))
            at = 0
            for part in chunks((x.as_py() for x in batch.column("text")), CHUNK):
                found = Stretches(part, length, heavy.value)
                row = at + found.doc
                held.append((ids[row], found.key, found.hash, digests[row], found.start, found.end))
                at += len(part)
                size += len(row)
                if size >= BLOCK:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return docs.select("doc", "digest", "text").mapInArrow(run, _FIND)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: WHOLE stretches that an earlier id has too, and WANTED bytes of the unlike ones."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    kind = whole.column("kind").to_numpy()
    for b in whole.filter(pa.array(kind == SPAN)).to_batches():
        yield b
    at = np.flatnonzero(kind == OPEN)
    doc, key, hash_ = (whole.column(c).to_numpy()[at] for c in ("doc", "key", "hash"))
    del whole, held
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    order = order[same[:-1] | same[1:]]
    doc, key, hash_ = doc[order], key[np.flatnonzero(same[:-1] | same[1:])], hash_[order]
    if not len(doc):
        return
    order = np.lexsort((doc, hash_, key))
    doc, key, hash_ = doc[order], key[order], hash_[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= hash_[1:] != hash_[:-1]
    first = np.flatnonzero(new)
    later = doc > doc[first][np.cumsum(new) - 1]
    yield _finding(doc[later], key[later], hash_[later], WHOLE)
    classes = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    mixed = new & (classes[np.cumsum(new_key) - 1] > 1)
    yield _finding(doc[mixed], key[mixed], hash_[mixed], WANTED)


def _suffix_order(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """PARTs of stretches whose windows have a previous factor of full length in their bucket."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    doc, key, hash_ = (whole.column(c).to_numpy() for c in ("doc", "key", "hash"))
    texts = whole.column("bytes").to_pylist()
    raw = b"".join(texts)
    edges = np.cumsum([0] + [len(t) for t in texts])
    windows = np.diff(edges) - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + edges[owner]
    # equal windows share a key: intervals of one key are refined by 8 bytes at a time, the last
    # of them overlapping; a window that is alone in its interval has no previous factor
    eight = np.ndarray(max(0, len(raw) - 7), np.dtype(">u8"), raw, strides=(1,))
    order = np.argsort(np.repeat(key, windows), kind="stable")
    interval = key[owner[order]]
    for step in [*range(0, length - 8, 8), length - 8]:
        word = eight[at[order] + step].astype(np.uint64)
        within = np.lexsort((word, interval))
        order, interval, word = order[within], interval[within], word[within]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (interval[1:] != interval[:-1]) | (word[1:] != word[:-1])
        several = ~(new[:-1] & new[1:])
        order, interval = order[several], np.cumsum(new[:-1])[several]
    earlier = np.zeros(len(owner), bool)
    if len(order):
        ids = doc[owner[order]]
        first = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
        least = np.minimum.reduceat(ids, first)
        earlier[order] = ids > np.repeat(least, np.diff(np.append(first, len(order))))
    hit = np.flatnonzero(earlier)
    if not len(hit):
        return
    cut = np.ones(len(hit), bool)
    cut[1:] = (owner[hit][1:] != owner[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(hit)) - 1
    who = owner[hit[begin]]
    yield _finding(doc[who], key[who], hash_[who], PART, at[hit[begin]] - edges[who], at[hit[last]] - edges[who] + length)


class _Listed:
    """A column of lists of structs as flat arrays."""

    def __init__(self, column: pa.ListArray):
        self.offsets = np.concatenate(([0], np.cumsum([0 if n is None else n for n in pc.list_value_length(column).to_pylist()])))
        flat = column.flatten()
        self.columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}

    def rows(self, low: int, high: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Row (from ``low``) of each entry, and the entries' columns."""
        part = slice(self.offsets[low], self.offsets[high])
        row = np.repeat(np.arange(high - low), np.diff(self.offsets[low : high + 1]))
        return row, {name: values[part] for name, values in self.columns.items()}


def removed_spans(docs: DataFrame, length: int = 50, id_: str = "doc_id", text: str = "text", apply=None, schema: str = "spans array<struct<a:long,b:long>>") -> DataFrame:
    """Per row: doc_id and what ``apply(text, runs)`` returns (a tuple per ``schema``).

    ``runs`` are the maximal removed byte ranges; without ``apply`` they are the result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    spark = docs.sparkSession
    n = partitions_of(spark)
    plain = docs.select(F.col(id_).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    named = plain.filter("doc IS NOT NULL AND text IS NOT NULL").withColumn("digest", F.xxhash64("text"))
    heavy = spark.sparkContext.broadcast(heavy_keys(named, length))
    found = stage_table(_reduced(named, length, heavy).repartition(n, "key").mapInArrow(_settled, _FIND), "findings")
    free_shuffles(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed = batch.column("doc").to_numpy(), _Listed(batch.column("wanted"))
            at = 0
            for part in chunks((x.as_py() for x in batch.column("text")), CHUNK):
                got = Stretches(part, length, heavy.value)
                row, asked = listed.rows(at, at + len(part))
                name, first = np.unique(_pair(got.key, got.hash, got.doc), return_index=True)
                first = np.sort(first[np.isin(name, _pair(asked["key"], asked["hash"], row))])
                doc = got.doc[first]
                content = [part[d][s:e] for d, s, e in zip(doc.tolist(), got.start[first].tolist(), got.end[first].tolist())]
                if content:
                    columns = [ids[at + doc], got.key[first], got.hash[first], pa.array(content, pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "key", "hash", "bytes"])
                at += len(part)

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc").agg(F.collect_list(F.struct("key", "hash", "kind", "a", "b")).alias(name))

    texts = named.select("doc", "text", "digest")
    asked = texts.join(gathered(found.filter(F.col("kind") == WANTED), "wanted"), "doc").mapInArrow(
        fetch, "doc long, key long, hash long, bytes binary"
    )
    parts = asked.repartition(2 * n, "key").mapInArrow(lambda batches: _suffix_order(batches, length), _FIND)
    result = stage_table(found.filter(F.col("kind") != WANTED).union(parts), "removed")
    # The texts are exchanged once more below: not beside those that fetched the stretches.
    free_shuffles(spark)
    apply = apply or (lambda _, runs: ([{"a": a, "b": b} for a, b in runs],))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, digests = _Listed(batch.column("told")), batch.column("digest").fill_null(0).to_numpy()
            at = 0
            for part in chunks((x.as_py() for x in batch.column("text")), CHUNK):
                row, told = listed.rows(at, at + len(part))
                span = told["kind"] == SPAN
                own = span & (told["key"] == digests[at + row])
                found = [(row[own], told["a"][own], told["b"][own])]
                rest = np.flatnonzero(~span)
                if len(rest):
                    has = np.zeros(len(part), bool)
                    has[row[rest]] = True
                    got = Stretches([t if h else b"" for t, h in zip(part, has)], length, heavy.value)
                    name = _pair(got.key, got.hash, got.doc)
                    order = np.argsort(name)
                    name = name[order]
                    wanted = _pair(told["key"][rest], told["hash"][rest], row[rest])
                    low, high = (np.searchsorted(name, wanted, side=side) for side in ("left", "right"))
                    times = high - low
                    which = np.repeat(rest, times)
                    place = order[np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(which))]
                    whole = told["kind"][which] == WHOLE
                    start = got.start[place] + told["a"][which]
                    found.append((got.doc[place], start, np.where(whole, got.end[place], got.start[place] + told["b"][which])))
                doc, start, end = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(doc, kind="stable")
                doc, start, end = doc[order], start[order], end[order]
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = [apply(t, _runs(start[i:j], end[i:j])) for t, i, j in zip(part, edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), *[pa.array(x) for x in zip(*rows)]], names=["doc_id", *columns]
                )
                at += len(part)

    columns = [c.split()[0] for c in schema.replace("struct<a:long,b:long>", "x").split(",")]
    every = docs.select(F.col(id_).alias("id"), F.col(id_).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    every = every.withColumn("digest", F.xxhash64("text"))
    joined = every.join(gathered(result, "told"), "doc", "left").select("id", "text", "digest", "told")
    kind = every.schema["id"].dataType.simpleString()
    return joined.mapInArrow(finish, f"doc_id {kind}, {schema}")


def kept_digest(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, at = hashlib.sha256(), 0
    for a, b in runs:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_spans(
        table(spark, sf_dir, "documents"), apply=kept_digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
