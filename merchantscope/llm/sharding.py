"""Byte-balanced shards by histogram sort.

Rows are ordered by a key whose high bits come from the text (equal texts are
neighbours) and whose low bits come from the id. Rows alike in both have one key and are
told apart by their number inside it, so that even one huge group of copies without ids
can be split. Rounds of exact counting - rows and bytes below each candidate
boundary, summed over all partitions - refine the key range around every wanted
splitter until it is pinned down; then rows are exchanged once, by fine key ranges. A
range with many rows (which has a single key by then) is numbered in pieces.

A splitter is a key and a number of rows inside it. It goes to the nearest border between
groups of equal texts if that costs at most ``tolerance`` of a shard, else to the nearest
border between rows. What the driver sees is bounded by the number of cells.

Edge cases: a null text has no bytes (size 1, like an empty one); null ids hash as
"null"; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, table

#: Key layout: KEY_BITS in all, the low LOW_BITS of them from the id.
KEY_BITS, LOW_BITS = 62, 22
CELLS = 1024
FANOUT = 64
#: A cell of one key is numbered in so many pieces.
PIECES = 256


def shard_keys(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k, row): all that the sort needs of a row; ``row`` tells equal ones apart once stored."""
    raw = F.coalesce(F.col(text), F.lit(""))
    ident = F.coalesce(F.col(id_).cast("string"), F.lit("null"))

    def digits(value, n: int):
        return F.conv(F.substring(F.md5(value), 1, n), 16, 10).cast("long")

    high = digits(raw.cast("binary"), 10)
    low = F.shiftright(digits(ident.cast("binary"), 6), 24 - LOW_BITS)
    return docs.select(
        F.col(id_).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        (high * F.lit(1 << LOW_BITS) + low).alias("k"),
        F.monotonically_increasing_id().alias("row"),
    )


def _histogram(keyed: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, bytes, smallest and largest key per cell [bounds[i], bounds[i + 1])."""
    shared = keyed.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for batch in batches:
            k, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(k)
            k, size = k[order], size[order]
            cell = np.searchsorted(edges, k, side="right") - 1
            some, first = np.unique(cell, return_index=True)
            last = np.append(first[1:], len(cell)) - 1
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (some, last - first + 1, np.add.reduceat(size, first), k[first], k[last])],
                    names=["cell", "n", "bytes", "low", "high"],
                )

    partial = keyed.select("k", "size").mapInArrow(run, "cell long, n long, bytes long, low long, high long")
    summed = partial.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    n, size, low, high = np.zeros((4, len(bounds)), np.int64)
    for r in summed.collect():  # a row per cell
        n[r.cell], size[r.cell], low[r.cell], high[r.cell] = r.n, r.bytes, r.low, r.high
    return n, size, low, high


def _refined(low: int, high: int) -> np.ndarray:
    """Boundaries that cut [low, high] in at most FANOUT cells, all keys of it covered."""
    step = max(1, -(-(high + 1 - low) // FANOUT))
    return np.append(np.arange(low, high + 1, step, dtype=np.int64), high + 1)


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first row of each shard but the first in the order of keys; cell bounds, rows per cell, one-key cells to number in pieces."""
    bounds = np.linspace(0, 1 << KEY_BITS, CELLS + 1).astype(np.int64)[:-1]
    while True:
        n, size, low, high = _histogram(keyed, bounds)
        after = np.cumsum(size)
        total = int(after[-1])
        crowded = n > max(64, 2 * int(n.sum()) // CELLS)
        heavy = crowded.copy()
        for s in range(1, shards):
            cell = int(np.searchsorted(after * shards, s * total, side="left"))
            if total and after[cell] * shards != s * total:
                heavy[cell] = True
        heavy &= high > low
        if not heavy.any():
            break
        new = [_refined(int(low[c]), int(high[c])) for c in np.flatnonzero(heavy)]
        bounds = np.unique(np.concatenate([bounds, *new]))
    picked, groups = [], set()
    for s in range(1, shards):
        cell = int(np.searchsorted(after * shards, s * total, side="left")) if total else 0
        group = int(low[cell]) >> LOW_BITS
        groups |= {group << LOW_BITS, (group + 1) << LOW_BITS}
        picked.append((s, int(low[cell]), int(after[cell] - size[cell]), int(size[cell]), int(n[cell]), group))
    alone = low[(high == low) & crowded]
    bounds = np.unique(np.concatenate([bounds, np.array(sorted(groups), np.int64), alone]))
    n, size, _, _ = _histogram(keyed, bounds)
    bytes_before = dict(zip(bounds.tolist(), (np.cumsum(size) - size).tolist()))
    rows_before = dict(zip(bounds.tolist(), (np.cumsum(n) - n).tolist()))
    places = []
    for s, key, start, held, rows, group in picked:
        aim = s * total

        def near(*borders: tuple[int, int], aim: int = aim) -> tuple[int, int]:
            return min(borders, key=lambda b: abs(b[1] * shards - aim))

        # rows of one key are as good as equal in size; the border before or after the row that holds the aim
        first = rows_before[int(bounds[np.searchsorted(bounds, key, side="right") - 1])]
        inside = min(max(0, (aim - start * shards) * rows // max(1, held * shards)), max(0, rows - 1))
        by_row = near(*[(first + r, start + held * r // max(1, rows)) for r in (inside, min(inside + 1, rows))])
        by_group = near(*[(rows_before[g], bytes_before[g]) for g in (group << LOW_BITS, (group + 1) << LOW_BITS)])
        cheap = abs(by_group[1] * shards - aim) <= max(tolerance * total, abs(by_row[1] * shards - aim))
        places.append((by_group if cheap else by_row)[0])
    return np.array(places, np.int64), bounds, n, np.isin(bounds, alone)


def _pieces_before(keyed: DataFrame, bounds: np.ndarray, one_key: np.ndarray) -> dict[tuple[int, int], int]:
    """Rows of a one-key cell before each of its pieces; a row per such cell and piece reaches the driver."""
    keys = bounds[one_key].tolist()
    if not keys:
        return {}
    each = keyed.filter(F.col("k").isin(keys)).groupBy("k", F.pmod(F.xxhash64("row"), F.lit(PIECES)).alias("piece")).agg(F.count("*").alias("n"))
    cell_of, before, out = {k: c for c, k in enumerate(bounds.tolist())}, dict.fromkeys(keys, 0), {}
    for r in sorted(each.collect(), key=lambda r: (r.k, r.piece)):
        out[cell_of[r.k], r.piece] = before[r.k]
        before[r.k] += r.n
    return out


def histogram_shards(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.01, id_: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 per shard), grown_shard."""
    keyed = stage_table(shard_keys(docs, id_, text), "shard_keys")
    places, bounds, rows, one_key = find_splitters(keyed, shards, tolerance)
    first = np.cumsum(rows) - rows
    before = _pieces_before(keyed, bounds, one_key)
    offsets = np.zeros((len(bounds), PIECES if before else 1), np.int64) + first[:, None]
    for (cell, piece), n in before.items():
        offsets[cell, piece] += n
    shared = docs.sparkSession.sparkContext.broadcast((bounds, one_key, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, split, starts = shared.value
        for batch in batches:
            cell = np.searchsorted(edges, batch.column("k").to_numpy(zero_copy_only=False), side="right") - 1
            piece = np.where(split[cell], batch.column("piece").to_numpy(zero_copy_only=False), 0)
            added = [pa.array(cell), pa.array(piece), pa.array(starts[cell, piece])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "cell", "piece", "start"])

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    dealt = keyed.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(PIECES)))
    placed = dealt.mapInArrow(place, f"doc_id {id_type}, size long, text_crc32 long, k long, row long, cell long, piece long, start long")
    inside = Window.partitionBy("cell", "piece").orderBy("k", "doc_id", "size", "text_crc32", "row")
    cuts = F.array(*[F.lit(int(p)) for p in places]) if len(places) else F.array().cast("array<int>")
    starts = F.array(F.lit(0).cast("long"), *[F.lit(int(p)).cast("long") for p in places])
    ordered = placed.withColumn("at", F.col("start") + F.row_number().over(inside) - 1)
    owned = ordered.withColumn("shard", F.size(F.filter(cuts, lambda p: p <= F.col("at"))))
    return owned.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.get(starts, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_histogram_sort_sharding(spark, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32; the first three tables compute it byte by byte.
OP9_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
raw AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
sums AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(text), 2),
    lambda i: cast('0x' || substr(hex(encode(text)), i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]))) AS text_crc32 FROM raw, crc),
t AS (
  SELECT doc_id, text_crc32, cast(strlen(coalesce(d.text, '')) + 1 AS BIGINT) AS size, md5(coalesce(d.text, '')) AS h,
    md5(coalesce(cast(doc_id AS VARCHAR), 'null')) AS m
  FROM documents d JOIN sums ON coalesce(d.text, '') = sums.text),
keyed AS (
  SELECT row_number() OVER () AS row, doc_id, text_crc32, size, cast('0x' || left(h, 10) AS BIGINT) AS g,
    cast('0x' || left(h, 10) AS BIGINT) * 4194304 + cast('0x' || left(m, 6) AS BIGINT) // 4 AS k FROM t),
run AS (
  SELECT *, sum(size) OVER w AS after_, sum(size) OVER w - size AS before_, row_number() OVER w AS place,
    sum(size) OVER (ORDER BY g) AS g_after, sum(size) OVER (ORDER BY g) - sum(size) OVER (PARTITION BY g) AS g_before,
    count(*) OVER (ORDER BY g) AS gn_after, count(*) OVER (ORDER BY g) - count(*) OVER (PARTITION BY g) AS gn_before,
    sum(size) OVER () AS total FROM keyed WINDOW w AS (ORDER BY k, doc_id, size, text_crc32, row ROWS UNBOUNDED PRECEDING)),
hit AS (
  SELECT s, min(place) AS p, min_by(before_, place) AS b, min_by(after_, place) AS a, min_by(g_before, place) AS gb, min_by(g_after, place) AS ga,
    min_by(gn_before, place) AS pb, min_by(gn_after, place) AS pa, any_value(total) AS total
  FROM run, range(1, 8) r(s) WHERE after_ * 8 >= s * total GROUP BY s),
near AS (
  SELECT s, total,
    CASE WHEN abs(b * 8 - s * total) <= abs(a * 8 - s * total) THEN p - 1 ELSE p END AS row_place,
    least(abs(b * 8 - s * total), abs(a * 8 - s * total)) AS row_off,
    CASE WHEN abs(gb * 8 - s * total) <= abs(ga * 8 - s * total) THEN pb ELSE pa END AS group_place,
    least(abs(gb * 8 - s * total), abs(ga * 8 - s * total)) AS group_off
  FROM hit),
cut AS (SELECT CASE WHEN group_off <= greatest(0.01 * total, row_off) THEN group_place ELSE row_place END AS p FROM near),
placed AS (SELECT doc_id, text_crc32, size, place, (SELECT count(*) FROM cut WHERE cut.p < place) AS shard FROM run)
SELECT doc_id, size, cast(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, cast(shard AS INTEGER) AS shard,
  cast(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM placed
"""
