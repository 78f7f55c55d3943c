"""Mixing sources to target weights by a low-discrepancy schedule.

The k-th slot of the mix is the k-th golden-ratio point; the cumulative targets map it
to a source, so every stretch of the schedule holds the sources in their shares. Slots
are ranked per source, and slot number r of a source takes block r of that source's
shuffled word stream (equal blocks of words; the stream runs through the source at
most ``epochs`` times). Everything is DataFrame work: ranks and prefix sums go over
(source, piece) totals first, and over totals of runs of pieces before that, so no source
is ever ordered in one task. Rows alike in id and size are one counted row until their
places are dealt, so a share of unnamed or repeated rows, however large, fills no piece.

Edge cases: a null text has no words; the null source is a source, in last place;
rows without words are taken 0 times; repeated rows are rows of their own; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stage_table, table

WORD = r"[^\x20\x09-\x0D]+"
#: Golden ratio times 2^31; slot k stands at k * GOLDEN mod 2^31.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Cells of [0, 2^31) by which slots find their source; rows per piece of a stream.
CELLS, PIECE, SLOT_PIECE = 4096, 256, 8192
#: Pieces whose totals are summed together before a source's are; counted rows dealt at a time.
RUN, DEALT = 4096, 65536


def word_sizes(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and a shuffling key of each row."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10)
    return docs.select(F.col(id_).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), key.cast("long").alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source: ix, source_size, target and its integer interval [low, high) of the points.

    Targets share ``share`` times all words by weight; none passes ``epochs`` times its
    source: the level is raised over the sources below their cap until no source is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, [F.col("source").isNull(), F.col("source")], "ix")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    known = stage_table(ranked.select("ix", "source", "source_size", weight.alias("w"), (F.col("source_size") * epochs).alias("cap")), "sources")
    words = known.agg(F.sum("source_size")).first()[0] or 0
    want, level = share * words, None
    while words:
        below = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("w")
        capped, open_ = known.agg(
            F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~below, F.col("w"))), F.lit(0))
        ).first()
        raised = (want - capped) / open_ if open_ else level
        if raised == level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(float(level or 0)) * F.col("w"))
    width = F.floor(target * F.lit(float(POINTS)) / F.lit(want)) if words else F.lit(0)
    shares = known.select("ix", "source", "source_size", target.alias("target"), width.cast("long").alias("width"))
    ends = numbered(shares, [F.col("ix")], "_n", {"low": "width"}).drop("_n")
    return stage_table(ends.withColumn("high", F.col("low") + F.col("width")).drop("width"), "targets")


def before_piece(totals: DataFrame, sums: dict[str, str]) -> DataFrame:
    """ix, piece and, under new names, the sums over the source's earlier pieces.

    Totals of runs of pieces are summed up per source, single pieces only inside their run.
    """
    runs = totals.withColumn("run", F.expr(f"piece div {RUN}"))
    whole = runs.groupBy("ix", "run").agg(*[F.sum(c).alias(f"_{o}") for o, c in sums.items()])
    earlier = Window.unboundedPreceding, -1
    over = Window.partitionBy("ix").orderBy("run").rowsBetween(*earlier)
    inside = Window.partitionBy("ix", "run").orderBy("piece").rowsBetween(*earlier)
    offsets = whole.select("ix", "run", *[F.coalesce(F.sum(f"_{o}").over(over), F.lit(0)).alias(f"_{o}") for o in sums])
    return runs.join(offsets, ["ix", "run"]).select(
        "ix", "piece", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{o}")).alias(o) for o, c in sums.items()]
    )


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, ix, block: which block of which source stands at each place of the mix."""
    spark = targets.sparkSession
    want, points = targets.agg(F.sum("target"), F.max("high")).first()
    slots = int(-(-(want or 0) // block_words))
    point = F.expr(f"((slot % {POINTS}) * {GOLDEN} % {POINTS}) * {points or 0} div {POINTS}")
    step = max(1, POINTS // CELLS)
    cells = targets.filter("high > low").select(
        "ix", "low", "high", F.explode(F.expr(f"sequence(low div {step}, (high - 1) div {step})")).alias("cell")
    )
    placed = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.expr(f"u div {step}"))
    owned = placed.join(cells, "cell").filter("u >= low AND u < high").select("slot", "ix", F.expr(f"slot div {SLOT_PIECE}").alias("piece"))
    counts = owned.groupBy("ix", "piece").agg(F.count("*").alias("n"))
    offsets = before_piece(counts, {"first": "n"})
    rank = F.row_number().over(Window.partitionBy("ix", "piece").orderBy("slot")) - 1
    return owned.join(offsets, ["ix", "piece"]).select("slot", "ix", (F.col("first") + rank).alias("block"))


def source_streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row's place in its source's shuffled stream: ix, at (words before it), and ``row``."""
    rows = sizes.count()
    bits = max(0, (rows // PIECE).bit_length())
    shift = 60 - bits
    keyed = sizes.join(targets.select("ix", "source", "source_size", "target"), sizes["source"].eqNullSafe(targets["source"])).select(
        "ix", "doc_id", "size", "h", "source_size", "target", F.shiftright("h", shift).alias("piece")
    )
    # rows alike in key, id and size are interchangeable: they are counted first and dealt their places last
    alike = keyed.groupBy("ix", "piece", "h", "doc_id", "size", "source_size", "target").agg(F.count("*").alias("n"))
    totals = keyed.groupBy("ix", "piece").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    offsets = before_piece(totals, {"first": "words", "row0": "rows"})
    inside = Window.partitionBy("ix", "piece").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.join(offsets, ["ix", "piece"]).select(
        "ix", "doc_id", "size", "source_size", "target", "n",
        (F.col("first") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).alias("at"),
        (F.col("row0") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).alias("row"),
    )
    return dealt(placed)


def dealt(placed: DataFrame) -> DataFrame:
    """A row for each of the ``n`` rows that a row counts, each with its own ``at`` and ``row``.

    Counts above DEALT are cut and exchanged before they are written out.
    """
    first = F.explode(F.expr("sequence(0L, n - 1)"))
    many = placed.filter(F.col("n") > DEALT).select("*", F.explode(F.expr(f"sequence(0L, n - 1, {DEALT}L)")).alias("_low"))
    many = many.repartition("ix", "row", "_low").select("*", F.explode(F.expr(f"sequence(_low, least(_low + {DEALT}, n) - 1)")).alias("_k"))
    every = placed.filter(F.col("n") <= DEALT).select("*", first.alias("_k")).unionByName(many.drop("_low"))
    return every.select(
        "ix", "doc_id", "size", "source_size", "target", (F.col("at") + F.col("_k") * F.col("size")).alias("at"), (F.col("row") + F.col("_k")).alias("row")
    )


def stream_blocks(streams: DataFrame, block_words: int, epochs: int = 2) -> DataFrame:
    """Parts of rows by block: ix, row, epoch, block, words (rows without words: block null)."""
    spread = streams.select("*", F.explode(F.expr(f"sequence(0, {epochs - 1})")).alias("epoch")).withColumn(
        "start", F.col("at") + F.col("epoch") * F.col("source_size")
    )
    blocks = F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block_words}, (start + size - 1) div {block_words}) END")
    cut = spread.select("*", F.explode_outer(blocks).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    return cut.withColumn("words", words)


def block_size(targets: DataFrame) -> int:
    """About a million blocks for the mix, of 1 to 4,096 words."""
    words = targets.agg(F.sum("target")).first()[0] or 0
    return int(min(4096, max(1, words // (1 << 20))))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
    block_words: int | None = None, id_: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Per row and epoch: doc_id, size, source_size, target, epoch, taken (words the mix takes)."""
    sizes = stage_table(word_sizes(docs, id_, text, source), "sizes")
    targets = source_targets(sizes, weights, share, epochs)
    block = block_words or block_size(targets)
    parts = stream_blocks(source_streams(sizes, targets), block, epochs)
    taken = parts.join(schedule(targets, block), ["ix", "block"], "left")
    return taken.groupBy("ix", "row", "epoch", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, id_: str = "doc_id", **options) -> DataFrame:
    """Rows once for each epoch that takes at least half of their words, columns unchanged.

    Rows without words stay once. Rows that share an id share the decision.
    """
    per_epoch = mixed(docs, id_=id_, **options)
    uses = per_epoch.groupBy(F.col("doc_id").alias("_id"), "row", "ix").agg(
        F.sum(((F.col("taken") * 2 >= F.col("size")) & ((F.col("size") > 0) | (F.col("epoch") == 0))).cast("int")).alias("uses")
    )
    uses = uses.groupBy("_id").agg(F.max("uses").alias("_uses")).filter("_uses > 0")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_).alias("_key"))
    joined = packed.join(uses, F.col("_key").eqNullSafe(F.col("_id")))
    return joined.select("_doc", F.explode(F.expr("sequence(1, _uses)"))).select("_doc.*")


def op7_low_discrepancy_mixing(spark, sf_dir: str) -> DataFrame:
    per_epoch = mixed(table(spark, sf_dir, "documents"))
    return per_epoch.groupBy("ix", "row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("ix", "row")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    cast('0x' || left(md5(coalesce(cast(doc_id AS VARCHAR), 'null')), 15) AS BIGINT) AS h FROM documents),
src AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM sizes GROUP BY source),
w AS (SELECT *, [5, 2, 1][ix % 3 + 1] AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS want FROM src),
-- sources in the order in which a rising level caps them; the first level that caps no further source is the one
lv AS (
  SELECT a.ix, cast(a.cap AS DOUBLE) / a.w AS r, (any_value(a.want) - coalesce(sum(b.cap) FILTER (b.cap * a.w < a.cap * b.w), 0))
    / cast(sum(b.w) FILTER (b.cap * a.w >= a.cap * b.w) AS DOUBLE) AS level FROM w a, w b GROUP BY a.ix, a.cap, a.w),
lam AS (SELECT min_by(level, r) AS level FROM lv WHERE level <= r),
tgt AS (SELECT w.*, least(cast(cap AS DOUBLE), level * w) AS target FROM w, lam),
wid AS (SELECT *, cast(floor(target * 2147483648.0 / want) AS BIGINT) AS width FROM tgt),
ivl AS (SELECT *, cast(sum(width) OVER (ORDER BY ix) - width AS BIGINT) AS low, cast(sum(width) OVER (ORDER BY ix) AS BIGINT) AS high FROM wid),
par AS (SELECT cast(least(4096, greatest(1, floor(sum(target) / 1048576))) AS BIGINT) AS b, sum(target) AS want, max(high) AS points FROM ivl),
slots AS (
  SELECT k, ((k % 2147483648) * 1327217885 % 2147483648) * points // 2147483648 AS u
  FROM (SELECT unnest(range(cast(ceil(want / b) AS BIGINT))) AS k, points FROM par)),
n AS (SELECT ix, count(*) AS n FROM slots JOIN ivl ON u >= low AND u < high GROUP BY ix),
st AS (
  SELECT doc_id, size, source_size, target, ix, coalesce(n.n, 0) * b AS upto,
    coalesce(sum(size) OVER (PARTITION BY ix ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sizes JOIN ivl ON sizes.source IS NOT DISTINCT FROM ivl.source LEFT JOIN n USING (ix), par)
SELECT doc_id, size, source_size, target,
  cast(greatest(0, least(size, upto - pos)) + greatest(0, least(size, upto - pos - source_size)) AS BIGINT) AS taken
FROM st
"""
