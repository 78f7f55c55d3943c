"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

Lines (trimmed, blank ones left out) become ids; a document is a sequence of ids. Round k
orders all suffixes by their first 2^k lines: the distinct pairs (rank of the first half,
rank of the second) are counted, put into order over ranges, numbered, and joined back.
Suffixes that no other shares leave early. Two overlapping ranks compare runs of any
length, so an interval of suffixes with a common prefix of a run's lines tells all its
copies; the first in (id, position) stays and the others are deleted.

A run counts if it has ``min_words`` words. Every such repeated run is the union of its
smallest windows of that many words, forwards from each line and backwards from each
line, so those are the prefixes that are looked up, and ranks of log2(min_words) rounds
suffice.

Edge cases: null and blank texts have no lines; rows without id lose nothing and stand
for no copy; equal rows (id and text) are one document and all get its result; a run may
repeat inside its own document; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stage_table, table

BLANK = b" \t\n\r\x0b\x0c"


def _line_id(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def kept_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(index among all lines, trimmed line) of the lines that are not blank."""
    return [(i, x) for i, x in ((i, line.strip(BLANK)) for i, line in enumerate(text.split(b"\n"))) if x]


def windows_of(words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, lines) of the smallest windows of ``least`` words from and to each line."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + least, side="left")
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    found = {(i, int(e) - i) for i, e in enumerate(ends) if e <= n}
    return sorted(found | {(int(s), e + 1 - int(s)) for e, s in enumerate(starts) if s >= 0})


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """Stored doc, digest, pos, line (id) and sizes (lines of the windows that start there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "digest", "text"))):
                lines = [x for _, x in kept_lines(text)]
                sizes: list[list[int]] = [[] for _ in lines]
                for start, n in windows_of([len(x.split()) for x in lines], min_words):
                    sizes[start].append(n)
                out += [(doc, digest, i, _line_id(x), s) for i, (x, s) in enumerate(zip(lines, sizes))]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc", "digest", "pos", "line", "sizes"])

    return stage_table(docs.mapInArrow(run, "doc long, digest long, pos int, line long, sizes array<int>"), "lines")


def _ranked(suffixes: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Stored suffixes that share ``keys`` with another one, with the rank of the keys."""
    shared = suffixes.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    ranks = numbered(shared, [F.col(k) for k in keys], out)
    return stage_table(suffixes.join(ranks, keys), out)


def suffix_ranks(lines: DataFrame, rounds: int) -> DataFrame:
    """doc, digest, pos, sizes and r0 to r<rounds>: ranks by the first 2^k lines (null: nobody shares them).

    Equal documents are one; only lines that occur again are in the result.
    """
    base = lines.dropDuplicates(["doc", "digest", "pos"])
    current = _ranked(base, ["line"], "r0").drop("line")
    place = Window.partitionBy("doc", "digest").orderBy("pos")
    for k in range(1, rounds + 1):
        half = 1 << (k - 1)
        ahead = F.first(f"r{k - 1}").over(place.rangeBetween(half, half))
        paired = stage_table(current.withColumn("_ahead", ahead), "pairs")
        both = paired.filter(F.col(f"r{k - 1}").isNotNull() & F.col("_ahead").isNotNull())
        ranked = _ranked(both, [f"r{k - 1}", "_ahead"], f"r{k}").select("doc", "digest", "pos", f"r{k}")
        current = paired.drop("_ahead").join(ranked, ["doc", "digest", "pos"], "left")
    return stage_table(current, "suffix_ranks")


def later_copies(ranks: DataFrame, rounds: int) -> DataFrame:
    """(doc, digest, start, stop): line positions of windows that occur at an earlier place."""
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r")) for k in range(rounds + 1)])).alias("x")
    prefix = stage_table(ranks.select("doc", "digest", "pos", known).select("doc", "digest", "pos", "x.*").filter("r IS NOT NULL"), "prefixes")
    # a window of n lines, 2^k <= n < 2^(k+1), is two overlapping prefixes of 2^k lines
    sized = ranks.select("doc", "digest", "pos", F.explode("sizes").alias("n")).withColumn("k", F.length(F.bin("n")) - 1)
    head = sized.join(prefix.withColumnRenamed("r", "ra"), ["doc", "digest", "pos", "k"])
    tail = prefix.select("doc", "digest", F.col("pos").alias("_at"), "k", F.col("r").alias("rb"))
    both = head.withColumn("_at", F.expr("int(pos + n - (1 << k))")).join(tail, ["doc", "digest", "_at", "k"])
    windows = stage_table(both.select("doc", "digest", "pos", "n", "ra", "rb"), "windows")
    first = windows.groupBy("n", "ra", "rb").agg(F.min(F.struct("doc", "digest", "pos")).alias("first"))
    later = windows.join(first, ["n", "ra", "rb"]).filter(F.struct("doc", "digest", "pos") > F.col("first"))
    return later.select("doc", "digest", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("stop"))


def line_dedup(docs: DataFrame, min_words: int = 20, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, kept (text without deleted lines), n_lines, n_removed, n_runs."""
    named = docs.select(F.col(id_).alias("id"), F.col(id_).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).withColumn("digest", F.xxhash64("text"))
    rounds = max(0, min_words.bit_length() - 1)
    lines = line_table(named.filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", "digest", "text"), min_words)
    gone = later_copies(suffix_ranks(lines, rounds), rounds)
    told = gone.groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("told"))
    kind = named.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "told"))):
                lines_ = kept_lines(text_ or b"")
                drop = np.zeros(len(lines_) + 1, np.int64)
                for s in spans or ():
                    drop[s["start"]] += 1
                    drop[s["stop"]] -= 1
                dropped = np.cumsum(drop)[:-1] > 0
                away = {i for (i, _), d in zip(lines_, dropped) if d}
                kept = b"\n".join(x for i, x in enumerate((text_ or b"").split(b"\n")) if i not in away)
                runs = int((np.diff(dropped.astype(int), prepend=0) == 1).sum())
                out.append((kept.decode("utf-8", "replace"), len(lines_), int(dropped.sum()), runs))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=["doc_id", "kept", "n_lines", "n_removed", "n_runs"])

    joined = named.join(told, ["doc", "digest"], "left").select("id", "text", "told")
    return joined.mapInArrow(run, f"doc_id {kind}, kept string, n_lines long, n_removed long, n_runs long")


def op4_line_run_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (
  SELECT doc_id, i, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, l[i] AS raw
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
k AS (
  SELECT doc_id, i, md5(t) AS h, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE t <> ''),
seq AS (SELECT doc_id, list(h ORDER BY p) AS hs, list(w ORDER BY p) AS ws FROM k GROUP BY doc_id),
win AS (
  SELECT doc_id, s, n, md5(array_to_string(hs[s : s + n - 1], ' ')) AS g
  FROM (SELECT doc_id, hs, ws, s, unnest(range(1, len(hs) - s + 2)) AS n FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS s FROM seq))
  WHERE list_sum(ws[s : s + n - 1]) >= 20),
seen AS (SELECT *, min(doc_id * 1000000 + s) OVER (PARTITION BY g) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM seen WHERE doc_id * 1000000 + s > first),
mark AS (
  SELECT l.doc_id, l.i, l.raw, k.p, gone.p IS NOT NULL AS g FROM l LEFT JOIN k ON k.doc_id = l.doc_id AND k.i = l.i
  LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.p = k.p),
edge AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id, p IS NULL ORDER BY p), false) AS starts FROM mark)
SELECT doc_id, count(p) AS n_lines, count(*) FILTER (g) AS n_removed, count(*) FILTER (starts) AS n_runs,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT g), '')) AS kept_sha256
FROM edge GROUP BY doc_id
"""
