"""Exact top-k inner products by no-random-access aggregation.

Every dimension is a list of the vectors sorted by component; a query reads it
from the top where its own component is positive, from the bottom where it is
negative.  Lists are read in step, to ever greater depths.  A vector's lower
bound takes what has been read of it and the list's last value for the rest;
its upper bound takes the value last read.  Once few vectors can still reach
the k-th lower bound, reading stops and their final scores are resolved as
exact integers.  Many queries read together: at a depth, the bounds of a block
of vectors for a batch of queries are matrix products.

Scale: vectors are dealt into blocks of about ``block`` by a hash of the id;
each block's task holds that block and streams the queries past it.  Only
queries are copied, once for each block; a block returns k rows a query, and
the best k of these are the answer.  Nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; every other row counts, also those that share
an id: a row is told by a number of its own, each row of a query's id asks for itself and
leaves out only itself; only vectors of equal length meet; equal scores go to the
smaller id; scores that 64 bits can't hold raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK, QUERIES, K = 8192, 128, 5
DEPTHS = (1 / 64, 1 / 8, 1 / 2, 7 / 8, 1)  # the last reads every list to its end, where both bounds are the product
FEW = 1 / 16  # of a block: so few open vectors are resolved at once


class Block:
    """The sorted lists of one block of vectors of one length; ``rows`` are the rows' own numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.whole = rows[order], ids[order], vectors[order]
        self.by_row = np.argsort(self.rows)
        self.x = self.whole.astype(np.float64)
        self.lists = np.sort(self.x, axis=0)  # ascending: the top is the last row
        self.depths: dict[int, tuple] = {}

    def at(self, depth: int) -> tuple:
        """What reading every list to a depth shows: values for the upper and the lower bounds, from either end."""
        if depth not in self.depths:
            if depth == len(self.x):
                return (self.x,) * 4
            top, bottom = self.lists[-depth], self.lists[depth - 1]
            self.depths[depth] = (np.maximum(self.x, top), np.minimum(self.x, bottom),
                                  np.where(self.x >= top, self.x, self.lists[0]), np.where(self.x <= bottom, self.x, self.lists[-1]))
        return self.depths[depth]

    def still_open(self, rows: np.ndarray, queries: np.ndarray, k: int, depths=DEPTHS) -> np.ndarray:
        """Queries x vectors: the others that may be among the k best once the lists are read so deep."""
        n = len(self.ids)
        if float(np.abs(queries).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * self.x.shape[1] >= 2.0**63:
            raise OverflowError("inner products of these vectors need more than 64 bits")
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        # products of long components are not exact as doubles: bounds are widened by what rounding can do
        slack = np.abs(queries).astype(np.float64).sum(1) * np.abs(self.x).max(initial=0) * 1e-12
        slack = np.where(slack > 100, slack, 0.25)
        open_ = np.ones((len(rows), n), bool)
        todo = np.arange(len(rows))
        own = self.by_row[np.minimum(np.searchsorted(self.rows, rows, sorter=self.by_row), n - 1)]
        mine = self.rows[own] == rows
        open_[mine, own[mine]] = False
        for share in depths:
            depth = max(1, int(n * share))
            if n <= k or not len(todo):
                break
            high_top, high_bottom, low_top, low_bottom = self.at(depth)
            upper = up[todo] @ high_top.T + down[todo] @ high_bottom.T + slack[todo, None]
            lower = up[todo] @ low_top.T + down[todo] @ low_bottom.T - slack[todo, None]
            lower[~open_[todo]] = -np.inf
            bound = np.partition(lower, n - k, axis=1)[:, n - k]
            open_[todo] &= upper >= bound[:, None]
            todo = todo[open_[todo].sum(1) > max(k, n * FEW)]
        return open_

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int):
        """(place of the query, ids, scores) of the k best others of each query."""
        open_ = self.still_open(rows, queries, k)
        for at in range(len(rows)):
            left = np.flatnonzero(open_[at])
            scores = (self.whole[left] * queries[at]).sum(1)
            best = np.lexsort((self.ids[left], -scores))[:k]
            yield at, self.ids[left[best]], scores[best]


def _vectors(column, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return flat[offsets[rows][:, None] + np.arange(sizes[rows[0]])] if len(rows) else np.zeros((0, 0), np.int64)


def _search_rows(batches, k: int):
    """Rows sorted by (block, query?): a block's vectors, then its queries."""
    current, held, ready = None, [], None

    def built():
        blocks = {}
        for size in {len(v) for _, _, v in held}:
            same = [x for x in held if len(x[2]) == size]
            blocks[size] = Block(np.array([r for r, _, _ in same]), np.array([i for _, i, _ in same]), np.stack([v for _, _, v in same]))
        return blocks

    for batch in batches:
        where, asks, keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        vectors = batch.column(4)
        sizes = np.diff(vectors.offsets.to_numpy())
        cuts = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (asks[1:] != asks[:-1])))) if len(where) else []
        for a, b in zip(cuts, [*cuts[1:], len(where)]):
            if where[a] != current:
                current, held, ready = where[a], [], None
            if not asks[a]:
                for size in np.unique(sizes[a:b]):
                    rows = a + np.flatnonzero(sizes[a:b] == size)
                    held += zip(keys[rows].tolist(), ids[rows].tolist(), _vectors(vectors, sizes, rows))
                continue
            if ready is None:
                ready = built()
            out: list[list] = [[], [], [], []]
            for size in np.unique(sizes[a:b]):
                if size not in ready:
                    continue
                rows = a + np.flatnonzero(sizes[a:b] == size)
                for s in range(0, len(rows), QUERIES):
                    part = rows[s:s + QUERIES]
                    for at, found, scores in ready[size].search(keys[part], _vectors(vectors, sizes, part), k):
                        out[0] += [keys[part[at]]] * len(found)
                        out[1] += [ids[part[at]]] * len(found)
                        out[2] += found.tolist()
                        out[3] += scores.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K,
          block: int = BLOCK, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others for each row whose id is divisible by ``every``."""
    src = C.pick(vectors, id=id_col, v=vector_col).where("id is not null and v is not null")
    whole = src.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    large = F.exists("v", lambda x: F.abs(x) * scale >= 2.0**53)
    ints = C.written(whole.select(F.monotonically_increasing_id().alias("row"), "id", F.when(large, F.raise_error(F.lit("a component is too large for exact scores")))
                                  .otherwise(F.transform("v", lambda x: F.floor(x * scale))).alias("v")), "topk-rows")
    blocks = max(1, -(-ints.count() // block))
    where = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    queries = ints.where(F.col("id") % every == 0)
    dealt = (ints.select(where.alias("block"), F.lit(False).alias("asks"), "row", "id", "v")
             .unionByName(queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "row", "id", "v"))
             .repartition(blocks, "block").sortWithinPartitions("block", "asks"))
    found = dealt.mapInArrow(lambda b: _search_rows(b, k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.n ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""
