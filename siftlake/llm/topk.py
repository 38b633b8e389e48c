"""Exact search for the k highest inner products.

Vectors are processed by descending length, in blocks. Round after round takes the next blocks, three times as many as all
rounds before, and raises each query's threshold (its k-th best score so far):

- a query goes to a block only if its length times the block's greatest length reaches the threshold (Cauchy-Schwarz); as
  lengths descend, a query that reaches no block of a round reaches none later;
- in a block all vectors are turned by the right singular vectors of the whole table, so that the first coordinates
  hold most of the length. A partial sum over them plus the product of the lengths of what is left bounds the score;
  pairs under the threshold go, coordinates are added step by step, and what is left is scored exactly on the integers.

So no pair that could count is passed over, and a query keeps some 3 k rows of a round, not k of every block. Blocks meet
queries by key: a group holds one block of each, both of bounded bytes.

Every component x becomes floor(scale * x). Vectors that are null or hold null or non-finite components take no part;
shorter vectors end in zeros; empty ones score 0. A query never finds its own row, but other rows of its id. Rows of
equal score are ordered by id, null ids last; a null id is no query unless the predicate takes it. Scores are 64-bit
sums. Without rows or queries the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.llm import common, vectors as vec

SCALE = 1024
#: Queries of a block, queries and vectors that are multiplied at once.
QUERIES, ROWS, COLUMNS = 32_768, 256, 4096
#: Candidate blocks of a table beyond the least block size.
PARTS = 256
GROWTH = 4
FOUND = "qn long, query_id long, vec_id long, score long"


def rotation(rows: DataFrame, f: vec.Figures) -> np.ndarray:
    """Right singular vectors of the table of all vectors, greatest first. Only dims ** 2 sums reach the driver."""
    d, unit = f.dims, max(f.norm, 1.0)

    def run(batches):
        gram = np.zeros((d, d))
        for b in batches:
            m = vec.matrix(b.column(0), d) / unit
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(gram.ravel())], names=["cell", "s"])

    got = rows.select("v").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    gram = np.zeros(d * d)
    gram[got["cell"].to_numpy()] = got["s"].to_numpy()
    return np.linalg.svd(gram.reshape(d, d))[0]


class _Best:
    """The k best (score, id) of each of n queries, as growing arrays that are cut again after each chunk."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, thresholds: np.ndarray) -> None:
        """Adds rows and raises the thresholds of full queries."""
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        thresholds[query[full]] = np.maximum(thresholds[query[full]], score[full])
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


class _Turned:
    """Integer vectors with their coordinates after the rotation and the lengths left after each step."""

    def __init__(self, v: np.ndarray, basis: np.ndarray, steps: list[int]):
        self.v, self.f = v, v.astype(np.float64)
        self.turned = self.f @ basis
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.left = {m: np.sqrt(squares[:, m]) if m < v.shape[1] else np.zeros(len(v)) for m in steps}
        self.norm = np.sqrt(squares[:, 0]) if v.shape[1] else np.zeros(len(v))


def _pairs(q: _Turned, c: _Turned, rows: np.ndarray, cols: np.ndarray, steps: list[int], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of which some pair may reach the row's threshold, by partial sums."""
    sums, at = None, 0
    for m in steps:
        more = q.turned[rows, at:m] @ c.turned[cols, at:m].T
        sums, at = more if sums is None else sums + more, m
        slack = 1e-9 * np.outer(q.norm[rows], c.norm[cols]) + 1
        may = sums + np.outer(q.left[m][rows], c.left[m][cols]) + slack >= low[rows, None]
        r, k = may.any(axis=1), may.any(axis=0)
        rows, cols, sums = rows[r], cols[k], sums[np.ix_(r, k)]
        if not len(rows):
            break
    return rows, cols


def _search(f: vec.Figures, basis: np.ndarray, k: int):
    """The cogroup function: a block of queries against a block of vectors."""
    steps = sorted({m for m in (f.dims // 8, f.dims // 4, f.dims // 2) if m})
    exact = f.norm * f.norm < vec.EXACT

    def found(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        order = np.lexsort((right["cn"].to_numpy(),))
        numbers, ids = right["cn"].to_numpy()[order], vec.ids_of(right["vec_id"])[order]
        c = _Turned(vec.matrix(right["v"], f.dims)[order], basis, steps)
        own, low = left["qn"].to_numpy(), left["low"].to_numpy()
        all_queries = vec.matrix(left["v"], f.dims)
        for a in range(0, len(own), ROWS):
            q = _Turned(all_queries[a : a + ROWS], basis, steps)
            mine, best, n = low[a : a + ROWS].copy(), _Best(len(q.v), k), own[a : a + ROWS]
            for b in range(0, len(ids), COLUMNS):
                reach = q.norm * c.norm[b : b + COLUMNS].max() * (1 + 1e-9) + 1 >= mine
                if not reach.any():
                    break
                rows, cols = _pairs(q, c, np.flatnonzero(reach), np.arange(b, min(b + COLUMNS, len(ids))), steps, mine)
                if not len(rows):
                    continue
                scores = (q.f[rows] @ c.f[cols].T).astype(np.int64) if exact else q.v[rows] @ c.v[cols].T
                counts = (scores >= mine[rows, None]) & (numbers[cols] != n[rows, None])
                if len(cols) > k + 1:
                    # the row itself may be among the k + 1 best
                    counts &= scores >= np.partition(scores, -k - 1, axis=1)[:, -k - 1, None]
                i, j = np.nonzero(counts)
                best.add(rows[i], scores[i, j], ids[cols[j]], mine)
            yield n[best.query], left["query_id"].take(pa.array(best.query + a)), best.id, best.score

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qn", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        got = list(found(left, right))
        query_id = pa.chunked_array([x for g in got for x in g[1].chunks], pa.int64())
        columns = [pa.array(np.concatenate([g[0] for g in got])), query_id, vec.id_column(np.concatenate([g[2] for g in got])), pa.array(np.concatenate([g[3] for g in got]))]
        return pa.table(columns, names=names)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qn").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the rows (vec_id, embedding) that `is_query` takes, against all rows."""
    spark = vectors.sparkSession
    rows = common.written(vec.quantised(vectors, scale, F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks")), "topk-rows")
    f = vec.figures(rows)
    out = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if not f.rows:
        return _best(spark.createDataFrame([], FOUND), k).select(*out)
    basis = rotation(rows, f)
    ordered = vec.narrow(rows, f).withColumns({"_less": -F.col("norm"), "_no_id": F.col("vec_id").isNull()})
    ranked = vec.ranked_rows(ordered, ["_less", "_no_id", "vec_id"], "topk-ranked", "cn")
    ranked = common.written(ranked.withColumn("cb", F.floor(F.col("cn") / vec.block_rows(f, PARTS))).drop("_less", "_no_id"), "topk-blocks")
    n_blocks = ranked.agg(F.max("cb")).first()[0] + 1
    lengths = ranked.groupBy("cb").agg(F.max("norm").alias("longest"))
    asking = ranked.where("asks").select(F.col("cn").alias("qn"), F.col("vec_id").alias("query_id"), "v", "norm")
    asking = common.written(asking, "topk-queries")
    query_blocks = max(1, -(-asking.count() // QUERIES))
    queries = asking.withColumn("qb", F.pmod(F.xxhash64("qn"), F.lit(query_blocks)))
    best, start, end = None, 0, 1
    while start < n_blocks:
        low = F.lit(None).cast("long").alias("low")
        if best is not None:
            kth = best.where(F.col("rank") == k).select("qn", F.col("score").alias("low"))
            asked = queries.join(kth, "qn", "left")
        else:
            asked = queries.withColumn("low", low)
        asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
        reaches = F.col("low").isNull() | (F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("low"))
        asked = asked.join(lengths, "cb").where(reaches).select("cb", "qb", "qn", "query_id", "v", F.coalesce("low", F.lit(-(1 << 63))).alias("low"))
        block = ranked.where(F.col("cb").between(start, end - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
        block = block.select("cb", "qb", "cn", "vec_id", "v")
        found = asked.groupBy("cb", "qb").cogroup(block.groupBy("cb", "qb")).applyInArrow(_search(f, basis, k), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = common.written(_best(found, k), "topk-best")
        start, end = end, min(n_blocks, end * GROWTH)
    return best.select(*out)
