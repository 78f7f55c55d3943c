"""Language-model scores by deleted interpolation of n-grams.

The probability of a word mixes maximum-likelihood estimates of all orders up to
``order`` and a uniform one over the vocabulary and one unknown word. The weights depend
on how often the contexts were seen (powers of two) and are learned by expectation
maximisation on held-out counts: the training documents fall into two halves, and each
half is predicted from the counts of the other one. The scores then use the counts of both.

Work flow: texts become chunks of word numbers, a row each. A chunk asks, per range of
gram hashes, for the counts of its distinct grams (sorted, as differences, compressed);
a range's task adds up all chunks and answers each in the order of its question, so that
answers are lists of counts without grams. Chunks are joined with their answers once; then one
pass bins the held-out events (probabilities to 1/8 octave) for the expectation maximisation,
another one scores. A gram that is everywhere has one entry per chunk, so there is no hot key;
ranges and chunks grow in number, not in size.

Words are told apart by 64-bit hashes, longer grams by as many bits as give each gram a chance
of 2^-MARGIN, at most, to share its counts with another one. Tokens are words plus one end per text.

Edge cases: a null text counts as empty (one token); null ids hash as the text "null";
rows keep repeated ids, and equal rows get equal scores; without training texts all
weight is on the uniform estimate; buckets of contexts without held-out events weigh their
estimates equally; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, chunks, free_shuffles, partitions_of, stage_table, table
from .words import U, Words, gram_hash, mix

ORDER = 3
#: Tokens of a chunk (more if one text has more) and, about, of a range of grams.
CHUNK_TOKENS, RANGE_TOKENS = 1 << 20, 1 << 20
#: Tokens that are scored at a time (more if one text has more).
PART_TOKENS = 1 << 17
#: Bits of a gram's hash beyond those that number all tokens.
MARGIN = 24
#: Far from the hashes of short words, which start from small numbers.
START, END = mix(np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64))
#: Contexts seen 0 times, once, 2-3 times, 4-7 times, ... and LAST for all above.
LAST = 16
#: Steps to an octave, and bits, of a binned probability (0: none).
STEPS, BITS = 8, 11
HELD = -1


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, in the smallest type that holds them."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=size * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"u{size}").ravel()


def roles(id_: Column, folds: int = 5, held: int = 1) -> Column:
    """HELD for the fold that nothing is learned from, else the half (0 or 1) of a training document."""
    crc = F.crc32(F.coalesce(id_.cast("string"), F.lit("null")).cast("binary"))
    half = F.floor(crc / folds) % 2
    return F.when(crc % folds == held, HELD).otherwise(half).cast("int")


def encode(docs: DataFrame, id_: str, text: str, role: Column) -> DataFrame:
    """Stored chunks: their rows' ids, roles and sizes in tokens; word hashes; the tokens as places among these."""

    def chunk(number: int, ids: list, role: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        words, places = np.unique(np.concatenate(tokens), return_inverse=True)
        sizes = [len(t) for t in tokens]
        columns = [[number], [ids], [role], [sizes], [pack(np.diff(words, prepend=U(0)))], [pack(places)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    picked = docs.select(F.col(id_).alias("id"), F.col(text).cast("binary").alias("text"), role.alias("role"))
    names = ["chunk", "ids", "roles", "sizes", "words", "tokens"]
    types = [pa.int64(), None, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, ([], [], [])
        for batch in batches:
            types[1] = pa.list_(batch.schema.field("id").type)
            at = 0
            for part in chunks(x.as_py() for x in batch.column("text")):
                found = Words(part)
                rows = slice(at, at + len(part))
                at += len(part)
                held[0].extend(batch.column("id")[rows].to_pylist())
                held[1].extend(batch.column("role")[rows].to_pylist())
                held[2].extend(np.append(found.hash[a:b], END) for a, b in zip(found.first[:-1], found.first[1:]))
                if sum(map(len, held[2])) >= CHUNK_TOKENS:
                    yield chunk(number, *held)
                    number, held = number + 1, ([], [], [])
        if held[0]:
            yield chunk(number, *held)

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"chunk long, ids array<{kind}>, roles array<int>, sizes array<int>, words binary, tokens binary"
    return stage_table(picked.mapInArrow(run, schema), "encoded")


class _Chunk:
    """Tokens of a chunk, the role of each, and its grams order by order."""

    def __init__(self, row: dict):
        self.words = np.cumsum(unpack(row["words"]), dtype=np.uint64)
        self.places = unpack(row["tokens"]).astype(np.int64)
        self.sizes = np.array(row["sizes"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.role = np.repeat(np.array(row["roles"], np.int8), self.sizes)

    def grams(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of order k + 1, sorted, and the place of each token's gram among them."""
        if k == 0:
            return self.words, self.places
        token = self.words[self.places]
        parts = [token]
        for lag in range(1, k + 1):
            before = np.full(len(token), START)
            before[lag:] = token[:-lag]
            for step in range(min(lag, int(self.sizes.max()))):
                before[self.first[self.sizes > step] + step] = START
            parts.insert(0, before)
        return np.unique(gram_hash(parts) >> U(64 - bits), return_inverse=True)


def _range_of(grams: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Ranges of equal width over the hashes' order."""
    return ((grams >> U(bits - 24)) * U(ranges) >> U(24)).astype(np.int64)


@dataclass(frozen=True)
class GramCounts:
    """Chunks with the counts of their grams, and the numbers of known words (a row per range).

    ``chunks``: ids, roles, sizes and tokens as encoded; ``counts``: per order, in both
    halves, those of each distinct word (first) or of each token's gram (higher orders).
    """

    chunks: DataFrame
    known: DataFrame
    order: int


def gram_counts(encoded: DataFrame, order: int = ORDER) -> GramCounts:
    """Stored counts of all grams up to ``order``, for the chunks that hold them."""
    tokens = encoded.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(partitions_of(encoded.sparkSession), -(-tokens // RANGE_TOKENS))
    bits = (64, *[min(64, MARGIN + tokens.bit_length())] * (order - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["chunk", "roles", "sizes", "words", "tokens"]).to_pylist():
                chunk = _Chunk(row)
                for k in range(order):
                    grams, place = chunk.grams(k, bits[k])
                    counts = [np.bincount(place[chunk.role == half], minlength=len(grams)) for half in (0, 1)]
                    owner = _range_of(grams, bits[k], ranges)
                    start = np.flatnonzero(np.diff(owner, prepend=-1))
                    asked = [(a, b) for a, b in zip(start, np.append(start[1:], len(grams)))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(asked), pa.int32()),
                            pa.array(owner[start]),
                            pa.array([row["chunk"]] * len(asked), pa.int64()),
                            pa.array([pack(np.diff(grams[a:b], prepend=U(0))) for a, b in asked], pa.binary()),
                            pa.array([pack(np.concatenate([c[a:b] for c in counts])) for a, b in asked], pa.binary()),
                        ],
                        names=["level", "range", "chunk", "grams", "counts"],
                    )

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        grams = [np.cumsum(unpack(x), dtype=np.uint64) for x in asked.column("grams").to_pylist()]
        counts = [unpack(x).astype(np.int64).reshape(2, -1) for x in asked.column("counts").to_pylist()]
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = [np.bincount(place, np.concatenate([c[half] for c in counts]), len(distinct)).astype(np.int64) for half in (0, 1)]
        edges = np.cumsum([0, *map(len, grams)])
        answers = [pack(np.concatenate([t[place[a:b]] for t in total])) for a, b in zip(edges[:-1], edges[1:])]
        names = asked.column("chunk").to_pylist()
        if key[0].as_py() == 0:
            answers.append(pack(np.array([(total[0] > 0).sum(), (total[1] > 0).sum(), (total[0] + total[1] > 0).sum()])))
            names.append(None)
        n = len(names)
        return pa.table({"level": pa.array([key[0].as_py()] * n, pa.int32()), "range": [key[1].as_py()] * n, "chunk": pa.array(names, pa.int64()), "counts": answers})

    asked = encoded.mapInArrow(ask, "level int, range long, chunk long, grams binary, counts binary")
    answered = asked.groupBy("level", "range").applyInArrow(answer, "level int, range long, chunk long, counts binary")
    rows = stage_table(answered, "answers")
    free_shuffles(encoded.sparkSession)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["roles", "sizes", "words", "tokens"]).to_pylist()[0]
        chunk, found = _Chunk(row), [[] for _ in bits]
        for r in sorted(right.to_pylist(), key=lambda r: r["range"]):
            found[r["level"]].append(unpack(r["counts"]).reshape(2, -1))
        counts = []
        for k, size in enumerate(bits):
            own = np.concatenate(found[k], axis=1)
            counts.append(pack((own if k == 0 else own[:, chunk.grams(k, size)[1]]).ravel()))
        return left.select(["ids", "roles", "sizes", "tokens"]).append_column("counts", pa.array([counts], pa.list_(pa.binary())))

    kind = encoded.schema["ids"].dataType.simpleString()
    asked_for = rows.filter("chunk IS NOT NULL").groupBy("chunk")
    joined = encoded.groupBy("chunk").cogroup(asked_for).applyInArrow(meet, f"ids {kind}, roles array<int>, sizes array<int>, tokens binary, counts array<binary>")
    met = stage_table(joined, "counted_chunks")
    free_shuffles(encoded.sparkSession)
    return GramCounts(met, rows.filter("chunk IS NULL").select("counts"), order)


@dataclass(frozen=True)
class Interpolation:
    """Documents, tokens and known words of either half (words also of both), and the weights of each bucket.

    ``weights[b]``: of the uniform estimate and of orders 1, 2, ...; see ``bucket_of``.
    """

    order: int
    docs: tuple[int, int]
    tokens: tuple[int, int]
    words: tuple[int, int, int]
    weights: np.ndarray

    def uniform(self, half: int) -> float:
        """Estimate of any word; half 2: both."""
        return 1 / (self.words[half] + 1)


def _seen(contexts: np.ndarray) -> np.ndarray:
    """0 for no sighting, else 1 plus the power of two, LAST at most."""
    return np.where(contexts > 0, np.minimum(np.frexp(contexts.astype(np.float64))[1], LAST), 0)


def bucket_of(contexts: list[np.ndarray]) -> np.ndarray:
    """Bucket of contexts of order 2, 3, ... by how often they were seen."""
    bucket = np.zeros(len(contexts[0]) if contexts else 1, np.int64)
    for k, c in enumerate(contexts):
        bucket += _seen(c) * (LAST + 1) ** k
    return bucket


def buckets(order: int) -> int:
    return (LAST + 1) ** (order - 1)


def _usable(order: int, trained: bool) -> np.ndarray:
    """Which estimates exist in each bucket: contexts never seen have none."""
    out = np.ones((buckets(order), order + 1), bool)
    out[:, 1] = trained
    for k in range(2, order + 1):
        out[:, k] = np.arange(buckets(order)) // (LAST + 1) ** (k - 2) % (LAST + 1) > 0
    return out


@dataclass(frozen=True)
class _Counted:
    """Some rows of a chunk: their sizes, first tokens, tokens' roles and, per order, counts (half, token)."""

    rows: slice
    sizes: np.ndarray
    first: np.ndarray
    role: np.ndarray
    counts: list[np.ndarray]


def _parts(row: dict) -> Iterator[_Counted]:
    """A chunk's rows in parts of PART_TOKENS (more if one text has more)."""
    sizes, counts, places = np.array(row["sizes"]), [unpack(x).reshape(2, -1) for x in row["counts"]], unpack(row["tokens"])
    edges = np.append(0, np.cumsum(sizes))
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + PART_TOKENS, "right")) - 1)
        tokens, own = slice(edges[low], edges[high]), sizes[low:high]
        found = [counts[0][:, places[tokens]], *(c[:, tokens] for c in counts[1:])]
        role = np.repeat(np.array(row["roles"][low:high], np.int8), own)
        yield _Counted(slice(low, high), own, edges[low:high] - edges[low], role, [c.astype(np.int64) for c in found])
        low = high


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _estimates(chunk: _Counted, counts: list[np.ndarray], docs: int, tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates of each order (0 without context), and how often each context was seen."""
    seen = [np.full(len(chunk.role), tokens)]
    for lower in counts[:-1]:
        before = np.concatenate((lower[:1], lower[:-1]))
        before[chunk.first] = docs
        seen.append(before)
    return [c / np.maximum(s, 1) for c, s in zip(counts, seen)], seen[1:]


def held_out_bins(counts: GramCounts, model: Interpolation) -> DataFrame:
    """Stored (bin, n): training tokens by half predicted from, bucket and binned estimates from that half."""
    order = model.order
    if buckets(order) * 2 << BITS * order >= 1 << 63:
        raise ValueError(f"order {order} does not fit a bin number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in (part for row in _rows(batches) for part in _parts(row)):
            for half in (0, 1):
                estimates, contexts = _estimates(chunk, [c[half] for c in chunk.counts], model.docs[half], model.tokens[half])
                key = bucket_of(contexts) * 2 + half + np.zeros(len(chunk.role), np.int64)
                for p in estimates:
                    step = np.round(-STEPS * np.log2(np.where(p > 0, p, 1))).astype(np.int64) + 1
                    key = (key << BITS) + np.where(p > 0, np.minimum(step, (1 << BITS) - 1), 0)
                bins, n = np.unique(key[chunk.role == 1 - half], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    each = counts.chunks.select("roles", "sizes", "tokens", "counts").mapInArrow(run, "bin long, n long")
    bins = stage_table(each.groupBy("bin").agg(F.sum("n").alias("n")), "held_out_bins")
    free_shuffles(counts.chunks.sparkSession)
    return bins


def _expected(bins: DataFrame, model: Interpolation) -> np.ndarray:
    """Expected number of events that each estimate of each bucket explains; a row per cell reaches the driver."""
    order, weights = model.order, model.weights
    uniform = np.array([model.uniform(0), model.uniform(1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape)
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("bin", "n"))
            top = key >> (BITS * order)
            parts = [uniform[top & 1]]
            for k in range(order):
                step = key >> (BITS * (order - 1 - k)) & ((1 << BITS) - 1)
                parts.append(np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0))
            share = weights[top >> 1] * np.stack(parts, 1)
            share *= (n / share.sum(1))[:, None]
            for j in range(order + 1):
                total[:, j] += np.bincount(top >> 1, share[:, j], len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "x"])

    out = np.zeros(weights.size)
    for r in bins.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r["cell"]] = r["x"]
    return out.reshape(weights.shape)


def fit(counts: GramCounts, rounds: int = 12, tolerance: float = 1e-3) -> Interpolation:
    """Weights by expectation maximisation, one event a usable estimate ahead (so none becomes 0).

    Ends when no weight moves by more than ``tolerance``, or after ``rounds``.
    """
    order = counts.order
    each = counts.chunks.select(F.explode(F.arrays_zip("roles", "sizes")).alias("x")).filter(F.col("x.roles") != HELD)
    sums = {r["roles"]: (r["n"], r["tokens"]) for r in each.groupBy(F.col("x.roles").alias("roles")).agg(F.count("*").alias("n"), F.sum("x.sizes").alias("tokens")).collect()}
    docs, tokens = zip(*(sums.get(half, (0, 0)) for half in (0, 1)))
    words = np.zeros(3, np.int64)
    for r in counts.known.coalesce(1).toLocalIterator() if sum(docs) else ():
        words += unpack(r["counts"]).astype(np.int64)
    usable = _usable(order, sum(tokens) > 0)
    weights = usable / usable.sum(1, keepdims=True)
    model = Interpolation(order, docs, tokens, tuple(int(w) for w in words), weights)
    if not sum(docs):
        return model
    bins = held_out_bins(counts, model)
    for _ in range(rounds):
        events = _expected(bins, model) + usable
        weights = events / events.sum(1, keepdims=True)
        moved = abs(weights - model.weights).max()
        model = Interpolation(order, docs, tokens, model.words, weights)
        if moved <= tolerance:
            break
    return model


def weight_table(spark, model: Interpolation) -> DataFrame:
    """The learned weights: bucket, seen (per context order, 0 or a power of two's number), weights."""
    rows = []
    for b, w in enumerate(model.weights):
        seen = [b // (LAST + 1) ** k % (LAST + 1) for k in range(model.order - 1)]
        rows.append((b, seen, [float(x) for x in w]))
    return spark.createDataFrame(rows, "bucket int, seen array<int>, weights array<double>")


def score(counts: GramCounts, model: Interpolation) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    tokens, docs, base = sum(model.tokens), sum(model.docs), 0.5 * (model.words[2] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in ((row, part) for row in _rows(batches) for part in _parts(row)):
            both = [c.sum(0) for c in chunk.counts]
            estimates, contexts = _estimates(chunk, both, docs, tokens)
            bucket = bucket_of(contexts) + np.zeros(len(chunk.role), np.int64)
            p = model.weights[bucket, 0] * model.uniform(2)
            for k, estimate in enumerate(estimates):
                p += model.weights[bucket, k + 1] * estimate
            sums = [np.add.reduceat(x, chunk.first) for x in (both[0] > 0, np.log10((both[0] + 0.5) / (tokens + base)), np.log10(p))]
            columns = [
                row["ids"][chunk.rows], np.array(row["roles"][chunk.rows]) == HELD, chunk.sizes, sums[0].astype(np.int64), np.full(len(chunk.sizes), tokens), sums[1], sums[2],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    id_type = counts.chunks.schema["ids"].dataType.elementType
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [arrow_type(id_type), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counts.chunks.mapInArrow(run, schema)


def language_model_scores(docs: DataFrame, order: int = ORDER, id_: str = "doc_id", text: str = "text", role: Column | None = None) -> DataFrame:
    """Scores of all rows under the model learned from those whose ``role`` is a half."""
    encoded = encode(docs, id_, text, roles(F.col(id_)) if role is None else role)
    counts = gram_counts(encoded, order)
    return score(counts, fit(counts))


def op12_deleted_interpolation_scores(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
