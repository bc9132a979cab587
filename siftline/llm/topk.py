"""Exact top-k search by distributed histogram selection.

Vectors are quantised to integers and every candidate is scored against every query, a block of queries at a time, by
matrix products. No score is kept: each task adds up, for each query, how many candidates fall into each bin of the
query's score range; the summed histograms tell the bin of the k-th highest score, whose range is divided anew, until it
is one score wide. Among the candidates at that score the same selection runs on the ids, so that ties
go to the smaller ones. A last pass keeps what is above the threshold, or at it with an id that is small enough:
exactly the k rows of each query, of which the ranks follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

K = 20
SCALE = 64
#: Bins of a query's range in a round, and queries that are searched at once: 2 MB of counts a task.
BINS = 128
QUERY_BLOCK = 4096
#: Candidates that are scored at once.
ROWS = 512
_EXACT_FLOAT32, _EXACT_FLOAT64 = 1 << 24, 1 << 53

RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null, empty or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    bounded = lambda x: F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.floor(x.cast("double") * scale).cast("double")))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda x: bounded(x).cast("long")))


def _products(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products: in float32 or float64 while these hold every partial sum, else in Python's integers, kept within 64 bits."""
    top = float(np.abs(candidates).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    for kind, most in ((np.float32, _EXACT_FLOAT32), (np.float64, _EXACT_FLOAT64)):
        if top < most:
            return candidates.astype(kind) @ queries.astype(kind).T
    if top < 2**63:
        return candidates @ queries.T
    return np.clip((candidates.astype(object) @ queries.astype(object).T), -(2**63), 2**63 - 1).astype(np.int64)


class _Block:
    """Some queries of one dimension against all candidates (id, v) of that dimension."""

    def __init__(self, rows: DataFrame, ids: np.ndarray, queries: np.ndarray):
        self.rows, self.ids, self.queries = rows, ids, queries
        self.spark = rows.sparkSession

    def _histogram(self, which: np.ndarray, low: np.ndarray, shift: int, ties: np.ndarray | None) -> np.ndarray:
        """Counts by (query, bin) of the values from low up, 2**shift to a bin; higher values are left out. The values are the
        negated scores or, where ``ties`` gives a score, the ids of the candidates at that score."""
        n, dim = len(which), self.queries.shape[1]
        shared = self.spark.sparkContext.broadcast((self.ids[which], self.queries[which], low, ties))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, low, ties = shared.value
            total, at = np.zeros(n * BINS, np.int64), np.arange(n) * BINS
            for own, vectors in _chunks(batches, dim):
                scores = _products(vectors, queries).astype(np.int64, copy=False)
                own = own[:, None]
                values = -scores if ties is None else np.broadcast_to(own, scores.shape)
                bins = (values - low) >> shift
                take = (bins >= 0) & (bins < BINS) & (own != ids)
                if ties is not None:
                    take &= scores == ties
                total += np.bincount((bins + at)[take], minlength=n * BINS)
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": cells, "n": total[cells]})

        out = np.zeros(n * BINS, np.int64)
        summed = self.rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
        return out.reshape(n, BINS)

    def _select(self, which: np.ndarray, need: np.ndarray, low: np.ndarray, high: int, ties: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the need-th smallest value (the largest, if there are fewer), how many it still takes at that value, and
        how many there are. A query without values needs none."""
        low, need = low.copy(), need.copy()
        shift = max(0, int(high - int(low.min())).bit_length() - BINS.bit_length() + 1)
        rows, first = np.arange(len(which)), True
        while True:
            counts = self._histogram(which, low, shift, ties)
            if first:
                need, first = np.minimum(need, counts.sum(1)), False
            cum = np.cumsum(counts, 1)
            at = np.minimum((cum < need[:, None]).sum(1), BINS - 1)
            here = counts[rows, at]
            need = need - (cum[rows, at] - here)
            low = low + (at << shift)
            if shift == 0:
                return low, need, here
            shift = max(0, shift - BINS.bit_length() + 1)

    def search(self, k: int, bound: np.ndarray, id_range: tuple[int, int], offset: int) -> DataFrame:
        """(query, query_id, vec_id, score): each query's k best, and rows of equal ids beside them."""
        every = np.arange(len(self.ids))
        value, need, here = self._select(every, np.full(len(every), k), -bound, int(bound.max()), None)
        limit = np.full(len(every), 2**63 - 1)
        if len(tied := np.flatnonzero(here > need)):
            least, _, _ = self._select(tied, need[tied], np.full(len(tied), id_range[0]), id_range[1], -value[tied])
            limit[tied] = least
        limit[need == 0] = -(2**63)
        dim, shared = self.queries.shape[1], self.spark.sparkContext.broadcast((self.ids, self.queries, -value, limit, need > 0))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, score, limit, some = shared.value
            for own, vectors in _chunks(batches, dim):
                scores = _products(vectors, queries).astype(np.int64, copy=False)
                own_ = own[:, None]
                row, query = np.nonzero((own_ != ids) & some & ((scores > score) | ((scores == score) & (own_ <= limit))))
                yield pa.RecordBatch.from_pydict({"query": query + offset, "query_id": ids[query], "vec_id": own[row], "score": scores[row, query]})

        return self.rows.mapInArrow(keep, "query long, query_id long, vec_id long, score long")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        ids, vectors = b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, dim)
        for a in range(0, len(ids), ROWS):
            yield ids[a : a + ROWS], vectors[a : a + ROWS]


def top_k(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k candidates of the highest integer inner product with each query: query_id, rank, vec_id, score.

    queries: which rows are queries, by the column ``id``. Candidates are all rows but those of the query's own id. Ties go to the smaller
    vec_id; fewer candidates than k are all returned. Rows with a null id, a null or empty vector, or null or
    non-finite components take no part, and vectors meet only those of their own length. Rows that repeat an id are
    candidates, and queries, each by itself. Components count within +-2**62 and scores within 64 bits. An empty
    table gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = quantised(F.col(embedding), scale)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(rows.select("id", "v", F.size("v").alias("dim"), F.sqrt(norm).alias("norm")), "vectors")
    found, offset = [], 0
    for d in sorted(rows.groupBy("dim").agg(F.max("norm").alias("norm"), F.min("id").alias("low"), F.max("id").alias("high")).collect()):
        own = rows.filter(F.col("dim") == d.dim).select("id", "v")
        for ids, block in _query_blocks(own.filter(queries), d.dim):
            length = np.sqrt((block.astype(np.float64) ** 2).sum(1))
            bound = np.minimum(np.ceil(length * d.norm * (1 + 1e-9)) + 1, 2.0**62).astype(np.int64)
            found.append(_Block(own, ids, block).search(k, bound, (d.low, d.high), offset))
            offset += len(ids)
    if not found:
        return spark.createDataFrame([], RESULT)
    if len(found) > 1:
        found = [materialize(x, "hits") for x in found]
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", best.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _query_blocks(rows: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, QUERY_BLOCK at a time; the driver holds one block and one partition of queries."""
    ids, block = [], []
    for r in rows.toLocalIterator():
        ids.append(r.id)
        block.append(r.v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(block, np.int64).reshape(-1, dim)
            ids, block = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(block, np.int64).reshape(-1, dim)
