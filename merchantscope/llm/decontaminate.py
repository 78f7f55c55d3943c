"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows (``window`` consecutive words; a shorter item is one window) are
sets that a document must contain whole and in place. For containment 1 the prefix
filter needs one element per window: its rarest shingle, by counts over the whole
corpus. Documents probe that shingle; the position it has in the window gives the
only possible start (positional bound), the text's end the length bound, and the
words themselves decide.

Edge cases: a null or wordless text has no words and no hits; items without words have no
window; items without id have windows that count as hits, but are not listed or counted
as items; repeated rows and repeated items each count as
themselves (an item id counts once per document); empty tables give no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, batch_of, chunks, stage_table
from .words import ALNUM, Words

#: Distinct windows of one pass; a larger benchmark takes several passes over the documents.
BLOCK_WINDOWS = 200_000
SHINGLE = 3

#: A set of items by fingerprint; windows with the same items share one.
ITEM_SET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("sets", T.ArrayType(ITEM_SET)),
    ]
)


def item_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per window: item (string), ``words`` (joined by spaces) and their number ``n``."""
    kind = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Words([value or b""], ALNUM)
                total = len(found.start)
                size = min(window, total)
                if size:
                    words = [found.bytes_of(i, i + size) for i in range(total - size + 1)]
                    yield batch_of(kind, item=[name] * len(words), words=words, n=[size] * len(words))

    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    return named.mapInArrow(run, "item string, words binary, n int")


def window_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored distinct windows with the fingerprint of their items, and the items of each fingerprint.

    The fingerprint (128 bits, null for a window of unnamed items only) comes from a
    map-side combined aggregation: a passage in very many items is one row, whose items
    stay on the executors.
    """
    places = stage_table(windows.distinct(), "places")
    marks = [F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(seed))) for seed in (1, 2)]
    distinct = places.groupBy("words", "n").agg(F.bit_xor(marks[0]).alias("a"), F.bit_xor(marks[1]).alias("b"))
    distinct = stage_table(distinct, "windows")
    shown = distinct.filter("a IS NOT NULL").groupBy("a", "b").agg(F.min("words").alias("words"))
    members = shown.join(places.filter("item IS NOT NULL"), "words").select("a", "b", "item")
    return distinct, members


def shingle_counts(docs: DataFrame, wanted: list[tuple[int, np.ndarray]], text: str) -> dict[int, int]:
    """How often each wanted shingle (width, sorted hashes) occurs in the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(known), np.int64) for _, known in shared.value]
        for batch in batches:
            for part in chunks(x.as_py() for x in batch.column(0)):
                found = Words(part, ALNUM)
                for total, (width, known) in zip(totals, shared.value):
                    hashes = found.grams(width)[1].view(np.int64)
                    at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
                    total += np.bincount(at[known[at] == hashes], minlength=len(known))
        for total, (_, known) in zip(totals, shared.value):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(total[some])], names=["shingle", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "shingle long, n long")
    return {r["shingle"]: r["n"] for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}  # wanted ones only


def _shingles(rows: list) -> list[tuple[int, np.ndarray]]:
    """Shingle width and hashes of each window."""
    out: list = [None] * len(rows)
    width = np.array([min(SHINGLE, r["n"]) for r in rows])
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        found = Words([bytes(rows[i]["words"]) for i in which], ALNUM)
        at, hashes = found.grams(w)
        cuts = np.searchsorted(found.doc[at], np.arange(len(which) + 1))
        for i, low, high in zip(which.tolist(), cuts[:-1], cuts[1:]):
            out[i] = (w, hashes[low:high].view(np.int64))
    return out


def _prefix_index(rows: list, shingles: list[tuple[int, np.ndarray]], counts: dict[int, int]) -> list[tuple[int, np.ndarray, list]]:
    """Per shingle width: sorted prefix shingles and the windows that wait for each."""
    by_width: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r, (width, hashes) in zip(rows, shingles):
        values = hashes.tolist()
        rarest = min(range(len(values)), key=lambda i: (counts.get(values[i], 0), values[i], i))
        if counts.get(values[rarest], 0):  # else no document has it
            items = None if r["a"] is None else (r["a"], r["b"])
            by_width[width][values[rarest]].append((rarest, r["n"], bytes(r["words"]), items))
    return [
        (width, np.array(sorted(known), np.int64), [known[h] for h in sorted(known)])
        for width, known in sorted(by_width.items())
    ]


def _probe(index: list[tuple[int, np.ndarray, list]], texts: list[bytes]) -> tuple[np.ndarray, list[list], list[set]]:
    """Word counts, covered word ranges and sets of items, per text."""
    found = Words(texts, ALNUM)
    spans: list[list] = [[] for _ in texts]
    sets: list[set] = [set() for _ in texts]
    for width, known, waiting in index:
        at, hashes = found.grams(width)
        hashes = hashes.view(np.int64)
        slot = np.searchsorted(known, hashes).clip(max=len(known) - 1)
        for k in np.flatnonzero(known[slot] == hashes):
            doc = found.doc[at[k]]
            low, high = found.first[doc], found.first[doc + 1]
            for offset, n, words, items in waiting[slot[k]]:
                begin = at[k] - offset
                if begin >= low and begin + n <= high and found.bytes_of(begin, begin + n) == words:
                    spans[doc].append((int(begin - low), int(begin - low + n)))
                    if items is not None:
                        sets[doc].add(items)
    return found.counts(), spans, sets


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _hits(docs: DataFrame, distinct: DataFrame, text: str, names: list[str], block_windows: int) -> DataFrame:
    """Rows (struct ``row``) with HITS (struct ``res``), over blocks of the distinct windows."""
    blocks = max(1, -(-distinct.count() // block_windows))
    out = None
    for block in range(blocks):
        part = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        rows = part.collect()  # each window once: about block_windows rows
        shingles = _shingles(rows)
        wanted: dict[int, list] = defaultdict(list)
        for width, hashes in shingles:
            wanted[width].append(hashes)
        counts = shingle_counts(docs, [(w, np.unique(np.concatenate(h))) for w, h in sorted(wanted.items())], text) if rows else {}
        index = docs.sparkSession.sparkContext.broadcast(_prefix_index(rows, shingles, counts))

        def first(texts: list[bytes], index=index) -> list[dict]:
            total, spans, sets = _probe(index.value, texts)
            runs = [_merged(s) for s in spans]
            return [
                {"n_words": int(n), "starts": [a for a, _ in r], "ends": [b for _, b in r], "sets": [{"a": a, "b": b} for a, b in sorted(i)]}
                for n, r, i in zip(total, runs, sets)
            ]

        found = annotate(docs, text, first, HITS, [*names] if blocks == 1 else [*dict.fromkeys([*names, text])])
        out = found if out is None else _joined(out, text, first)
    if blocks > 1:
        out = out.select(F.struct(*[F.col(f"row.`{c}`") for c in names]).alias("row"), "res")
    return out


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    keep: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document (struct ``row``) its hits (struct ``res``: n_words, starts, ends, items).

    Starts and ends are word positions of maximal covered runs. The distinct windows are
    handled in blocks of about ``block_windows``, each of which is collected and broadcast;
    documents never move. Items are joined to the rows with hits alone.
    """
    distinct, members = window_sets(item_windows(benchmark, window))
    names = keep if keep is not None else docs.columns
    found = _hits(docs, distinct, text, names, block_windows)
    found = stage_table(found.withColumn("at", F.monotonically_increasing_id()), "hits")
    sets = found.select("at", F.inline("res.sets"))
    items = sets.join(members, ["a", "b"]).groupBy("at").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def result(rows: DataFrame, items: Column) -> DataFrame:
        return rows.select("row", F.struct("res.n_words", "res.starts", "res.ends", items.alias("items")).alias("res"))

    listed = F.size("res.sets") > 0
    return result(found.filter(listed).join(items, "at"), F.col("items")).unionByName(
        result(found.filter(~listed), F.expr("cast(array() as array<string>)"))
    )


def _joined(before: DataFrame, text: str, fn) -> DataFrame:
    """One more block on rows that already carry hits: runs and sets are united."""
    flat = before.select("row", "res", F.col(f"row.`{text}`").alias("text"))
    both = annotate(flat, "text", fn, HITS, ["row", "res"])

    def pairs(x: str):
        return F.arrays_zip(F.col(f"{x}.starts").alias("s"), F.col(f"{x}.ends").alias("e"))

    ordered = F.array_sort(F.concat(pairs("row.res"), pairs("res")))
    runs = F.aggregate(
        ordered,
        F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    return both.select(
        F.col("row.row").alias("row"),
        F.struct(
            F.col("res.n_words").alias("n_words"),
            F.transform(runs, lambda x: x["s"]).alias("starts"),
            F.transform(runs, lambda x: x["e"]).alias("ends"),
            F.array_union("row.res.sets", "res.sets").alias("sets"),
        ).alias("res"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """Documents without a hit, columns unchanged."""
    distinct, _ = window_sets(item_windows(benchmark, window))
    found = _hits(docs, distinct, text, docs.columns, BLOCK_WINDOWS)
    return found.filter(F.size("res.starts") == 0).select("row.*")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate(F.zip_with("res.starts", "res.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("res.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("res.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "res.items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
