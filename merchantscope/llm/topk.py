"""Exact top-k by inner product with a pivot table.

With d the Euclidean distance, q.v = (|q|^2 + |v|^2 - d(q, v)^2) / 2, and distances to
pivots bound d from below: d(q, v) >= max over pivots |d(q, p) - d(v, p)|. So each
candidate has an upper bound of its score; candidates are scored in the order of that
bound until it falls below the k-th best score found.

Queries and candidates meet in blocks of bounded size; each meeting keeps k rows per
query and the best k of those remain. Candidates alike in id and vector are counted
before they are dealt, and k of them are all that an answer can hold; blocks go by id and
vector, so neither an id nor a vector that many rows share is a hot key.

Edge cases: null vectors, null or non-finite components and null ids take no part;
vectors of different lengths are not compared; ties go to the smaller id; repeated
rows are candidates each (an id's own rows never answer it); query rows that share an id
are answered each, with k rows of their own; empty tables give nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, table

PIVOTS = 16
QUERY_BLOCK, CANDIDATE_BLOCK, QUERY_STEP = 2048, 16384, 128


def integer_vectors(df: DataFrame, id_: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v, dim) with v = floor(scale * x); only whole, finite vectors."""
    x = F.col(vector)
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    v = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")).cast("double"))
    return df.filter(F.col(id_).isNotNull() & x.isNotNull() & fine).select(F.col(id_).cast("long").alias("id"), v.alias("v"), F.size(x).alias("dim"))


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query (its place), id and score of the k best candidates of each query, scored in the order of their bounds.

    A query first scores the candidates with its highest bounds; its k-th best score then
    rules out all candidates with lower bounds, and only the others are scored.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    q_norm, c_norm, p_norm = ((x * x).sum(1) for x in (q, c, pivots))

    def to_pivots(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm[:, None] + p_norm - 2 * (x @ pivots.T), 0)).astype(np.float32)

    from_q, from_c = to_pivots(q, q_norm), np.ascontiguousarray(to_pivots(c, c_norm).T)
    slack = np.float32(1e-5) * (1 + np.sqrt(np.float32(max(q_norm.max(), c_norm.max()))))
    head, out = min(len(c), max(4 * k, 256)), []
    for low in range(0, len(q), QUERY_STEP):
        rows = slice(low, low + QUERY_STEP)
        gap = np.zeros((len(q_ids[rows]), len(c)), np.float32)
        for p in range(len(pivots)):
            np.maximum(gap, np.abs(from_c[p] - from_q[rows, p][:, None]), out=gap)
        # single precision rounds, so bounds get a little room
        gap = np.maximum(gap - slack, 0).astype(np.float64)
        bound = (q_norm[rows, None] + c_norm - gap * gap) / 2 + 1e-6 * (q_norm[rows, None] + c_norm)
        bound[q_ids[rows][:, None] == c_ids] = -np.inf
        first = np.argpartition(-bound, head - 1, axis=1)[:, :head]
        kth = np.full(len(bound), -np.inf)
        if head > k:
            scores = np.einsum("qhd,qd->qh", c[first], q[rows])
            scores[np.take_along_axis(bound, first, 1) == -np.inf] = -np.inf
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        open_ = (bound >= kth[:, None]) & (bound > -np.inf)
        # few open candidates are scored one by one, many as one product
        whole = q[rows] @ c.T if open_.mean() > 0.1 else None
        for i in range(len(bound)):
            some = np.flatnonzero(open_[i])
            score = whole[i, some] if whole is not None else c[some] @ q[low + i]
            if len(some) > k:
                some, score = (x[score >= -np.partition(-score, k - 1)[k - 1]] for x in (some, score))
            best = np.lexsort((c_ids[some], -score))[:k]
            out.append((np.full(len(best), low + i), c_ids[some][best], score[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query.

    Both tables as of ``integer_vectors``. The pivots are ``pivots`` rows of the
    candidates (a bounded number; any choice gives exact results). Queries alike in id
    and vector are answered once and the answer repeated.
    """
    spark = candidates.sparkSession
    alike = queries.groupBy("id", "v", "dim").agg(F.count("*").alias("copies"))
    queries = stage_table(alike.withColumn("query", F.monotonically_increasing_id()), "queries")
    once = candidates.groupBy("id", "v", "dim").agg(F.count("*").alias("n"))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long"))))
    candidates = stage_table(once.select("id", "v", "dim", repeats.alias("n")).drop("n"), "candidates")
    sizes = {r["side"]: r["n"] for r in queries.select(F.lit("q").alias("side")).union(candidates.select(F.lit("c"))).groupBy("side").agg(F.count("*").alias("n")).collect()}
    q_blocks, c_blocks = (max(1, -(-sizes.get(s, 0) // size)) for s, size in (("q", query_block), ("c", candidate_block)))
    chosen = candidates.orderBy(F.xxhash64("id"), "id").limit(4 * pivots).collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({d: np.array(v[:pivots]) for d, v in by_dim.items()})

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("query", "copies", "query_id", "vec_id", "score")}, dtype="int64")
        q, c = np.stack(left["v"].to_list()), np.stack(right["v"].to_list())
        at, ids, scores = _best(left["id"].to_numpy(), q, right["id"].to_numpy(), c, shared.value.get(key[2], c[:1]), k)
        numbers, copies, names = (left[x].to_numpy()[at] for x in ("query", "copies", "id"))
        return pd.DataFrame({"query": numbers, "copies": copies, "query_id": names, "vec_id": ids, "score": scores})

    def blocks(names: list[str], n: int, salt: int):
        return F.pmod(F.xxhash64(*names, F.lit(salt)), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    key = ["qb", "cb", "dim"]
    left = queries.select("id", "v", "dim", "query", "copies", blocks(["query"], q_blocks, 1).alias("qb"), every(c_blocks).alias("cb"))
    right = candidates.select("id", "v", "dim", every(q_blocks).alias("qb"), blocks(["id", "v"], c_blocks, 2).alias("cb"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query long, copies long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op10_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = stage_table(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(vectors.filter(F.col("id") % 20 == 0), vectors)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * cast(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
