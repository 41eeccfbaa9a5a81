"""Exact top-k inner-product search in three phases with a uniform threshold.

Vectors are cut into `LISTS` parts; list l holds part l of every vector, and a
score is the sum of the lists' local scores.

1. Each task of a list gathers the local k best entries of each query.  The
   exact scores of the vectors in the lists' k best give each query a k-th best
   score t that is known to be reached.
2. The cut-off t / LISTS is broadcast.  A vector whose local scores all stay
   under it can't reach t, so the lists send only entries that reach it, and
   sums of those, with the cut-off in place of what wasn't sent, drop more.
3. What remains gets its whole score, and the k best of a query are its result.

Queries are worked off in blocks of a bounded number, as those are broadcast.
Of equal vectors only the k + 1 with the smallest ids can be in a result (one
may be the query's own), so the others leave before phase 1.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part; only vectors of equal length are compared; of rows that
share an id the smallest vector counts; a query with fewer than k others gets
them all; an empty table gives no rows; other columns don't matter.  Vectors of
any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm import tables

#: Parts of a vector, the most queries in a block, and vectors that a task scores at once.
LISTS, BLOCK, ROWS = 2, 4096, 512
_NONE = -(1 << 62)


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * component) of usable vectors."""
    e = F.col("embedding")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(e) > 0) & usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class _Queries:
    """A block of queries by vector length: ids and vectors, and each query's cut-off."""

    def __init__(self, rows: list, reached: dict[int, int] | None = None):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(r["v"]) for r in rows}:
            own = sorted((r for r in rows if len(r["v"]) == size), key=lambda r: r["vec_id"])
            ids = np.array([r["vec_id"] for r in own], np.int64)
            least = np.array([(reached or {}).get(r["vec_id"], _NONE) for r in own], np.int64)
            self.by_size[size] = ids, np.array([r["v"] for r in own], np.int64), least


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if np.abs(q).max(initial=0) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _bounds(size: int, part: int, lists: int) -> tuple[int, int]:
    return part * size // lists, (part + 1) * size // lists


def _local(queries, lists: int, k: int, second: bool):
    """Phase 1 or 2 over rows (part, size, vec_id, v): entries (query_id, part, vec_id, score).

    In phase 2 an entry's score is by how much it helps its vector to reach the
    query's cut-off t: lists * score - t + 1, so that sums over the lists that sent
    one, with t - 1 in place of the others, reach t if these reach `lists`.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = queries.value.by_size
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def rows(p: int, q: np.ndarray, v: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), p, np.int32)), pa.array(v), pa.array(score)], ["query_id", "part", "vec_id", "score"])

        for batch in batches:
            part, size, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "size", "vec_id"))
            v = batch.column("v")
            flat, offset = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            for p, n in sorted({(int(a), int(b)) for a, b in zip(part, size)}):
                if n not in held:
                    continue
                a, b = _bounds(n, p, lists)
                q_ids, q, least = held[n]
                every = np.flatnonzero((part == p) & (size == n))
                for i in range(0, len(every), ROWS):
                    at = every[i : i + ROWS]
                    x = flat[offset[at][:, None] + np.arange(b - a)[None, :]]
                    score = _products(q[:, a:b], x)
                    own = ids[at][None, :] == q_ids[:, None]
                    if second:
                        row, col = np.nonzero((score >= -(-least[:, None] // lists)) & ~own)
                        yield rows(p, q_ids[row], ids[at][col], np.where(least[row] == _NONE, lists, lists * score[row, col] - least[row] + 1))
                    else:
                        score[own] = _NONE
                        found = np.broadcast_to(ids[at], score.shape)
                        if (p, n) in best:
                            score, found = np.hstack([best[p, n][0], score]), np.hstack([best[p, n][1], found])
                        if score.shape[1] > k:
                            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                            score, found = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
                        best[p, n] = score, found
        for (p, n), (score, found) in best.items():
            row, col = np.nonzero(score > _NONE)
            yield rows(p, held[n][0][row], found[row, col], score[row, col])

    return entries


def _whole(queries):
    """Rows (vec_id, v, asked: query ids) as (query_id, vec_id, score), with the whole score where it reaches the query's cut-off."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = queries.value
        for batch in batches:
            v, asked, ids = batch.column("v"), batch.column("asked"), batch.column("vec_id").to_numpy(zero_copy_only=False)
            size, m = v.value_lengths().to_numpy(zero_copy_only=False), asked.value_lengths().to_numpy(zero_copy_only=False)
            flat, offset = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            wanted, cut = asked.flatten().to_numpy(zero_copy_only=False), np.cumsum(m) - m
            for n in np.unique(size).tolist():
                q_ids, q, least = held.by_size[n]
                every = np.flatnonzero(size == n)
                for i in range(0, len(every), ROWS):  # a tile: some vectors, and all queries that ask for one of them
                    at = every[i : i + ROWS]
                    row = np.repeat(np.arange(len(at)), m[at])
                    pick = wanted[np.repeat(cut[at] - (np.cumsum(m[at]) - m[at]), m[at]) + np.arange(len(row))]
                    which, own = np.unique(np.searchsorted(q_ids, pick), return_inverse=True)
                    score = _products(q[which], flat[offset[at][:, None] + np.arange(n)[None, :]])[own, row]
                    good = score >= least[which[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(pick[good]), pa.array(ids[at][row[good]]), pa.array(score[good])], ["query_id", "vec_id", "score"])

    return scores


def _resolved(pairs: DataFrame, candidates: DataFrame, queries) -> DataFrame:
    """Whole scores of pairs (query_id, vec_id); each vector travels once."""
    asked = pairs.groupBy("vec_id").agg(F.collect_list("query_id").alias("asked"))  # at most a block's queries
    return asked.join(candidates, "vec_id").select("vec_id", "v", "asked").mapInArrow(_whole(queries), "query_id long, vec_id long, score long")


def _best(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all others for each row of `vectors` that is_query holds for."""
    spark, found = vectors.sparkSession, []
    with tables.Scratch(spark) as scratch:
        every = scratch.written(integers(vectors), "vectors")
        queries = every.where(is_query)
        same = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
        candidates = scratch.written(every.withColumn("same", same).where(F.col("same") <= k + 1).select("vec_id", "v"), "candidates")
        size = F.size("v")
        parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", (F.floor(size * p / lists) + 1).cast("int"), (F.floor(size * (p + 1) / lists) - F.floor(size * p / lists)).cast("int")).alias("v")) for p in range(lists)]))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = candidates.select("vec_id", size.alias("size"), parts.alias("x")).select("vec_id", "size", "x.part", "x.v").repartition(tasks, "part", "vec_id")
        dealt = scratch.written(dealt, "lists")
        blocks = max(1, -(-queries.count() // block))
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about `block` rows
            shipped = spark.sparkContext.broadcast(_Queries(rows))
            shape = "query_id long, part int, vec_id long, score long"
            local = _best(dealt.mapInArrow(_local(shipped, lists, k, False), shape), k, "query_id", "part")
            first = _resolved(local.select("query_id", "vec_id").distinct(), candidates, shipped)
            reached = {r["query_id"]: r["score"] for r in _best(first, k, "query_id").where(F.col("rank") == k).collect()}
            cut = spark.sparkContext.broadcast(_Queries(rows, reached))
            sent = dealt.mapInArrow(_local(cut, lists, k, True), shape).groupBy("query_id", "vec_id").agg(F.sum("score").alias("helps"))
            open_ = sent.where(F.col("helps") >= lists).select("query_id", "vec_id")
            found.append(tables.written(_best(_resolved(open_, candidates, cut), k, "query_id"), "best"))
            shipped.destroy()
            cut.destroy()
    return reduce(DataFrame.unionByName, found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of all for every hundredth."""
    return top_k(tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
