"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into groups of bounded rows. Every pair of a query group and a candidate group is one tile, a
task of its own: the stated query set meets all rows in blocks. In a tile, int8 products give each inner product with a bound on
its quantisation error; pairs whose upper bound reaches the query's k-th best lower bound are computed again in double precision
and kept in a heap of k per query. The heaps of all tiles of a query are merged by (score, vec_id). The result is exact: a score is the
sum, from left to right, of the products of components, every step rounded to double precision.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of one dimension
are compared; a row repeated with the same vec_id and vector counts once; a row never finds its own vec_id; ties go to the smaller
vec_id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query group and of a candidate group: a tile holds this many vectors of each side, whatever the table's size.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: Candidates multiplied at once inside a tile.
BLOCK_ROWS = 2048
#: Vector pairs computed again at once.
EXACT_PAIRS = 1 << 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norms of the quantised rows and of what quantisation left out."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    return code, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows. A float32 product of 512 components stays below 2**24, so it is exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 512):
        out += a[:, i : i + 512].astype(np.float32) @ b[:, i : i + 512].astype(np.float32).T
    return out


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs of rows: every product rounded to double precision, the products summed from left to right.

    The order of the sum is part of the measure: scores that tie in exact arithmetic, or nearly so, rank alike wherever they are computed.
    """
    parts = [np.add.accumulate(a[i[s : s + EXACT_PAIRS]] * b[j[s : s + EXACT_PAIRS]], axis=1)[:, -1] for s in range(0, len(i), EXACT_PAIRS)]
    return np.concatenate(parts or [np.zeros(0)])


def search_tile(q_ids, q, c_ids, c, k: int):
    """The k best candidates of each query of a tile as (query_id, vec_id, score) arrays; also the number of pairs computed exactly."""
    qc, qs, qn, qe = quantise(q)
    c_norm = np.linalg.norm(c, axis=1)
    heaps: list[list] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)  # the k-th best score so far
    recomputed = 0
    for at in range(0, len(c_ids), BLOCK_ROWS):
        block, ids = c[at : at + BLOCK_ROWS], c_ids[at : at + BLOCK_ROWS]
        bc, bs, _, be = quantise(block)
        near = int_products(qc, bc) * qs[:, None] * bs[None, :]
        # |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y|; the last term covers rounding.
        slack = qn[:, None] * be[None, :] + qe[:, None] * c_norm[None, at : at + BLOCK_ROWS]
        slack += 1e-9 * ((qn + qe)[:, None] * c_norm[None, at : at + BLOCK_ROWS])
        own = q_ids[:, None] == ids[None, :]
        lower = np.where(own, -np.inf, near - slack)
        if len(ids) > k:
            floor_now = np.maximum(floor, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
        else:
            floor_now = floor
        i, j = np.nonzero((near + slack >= floor_now[:, None]) & ~own)
        recomputed += len(i)
        for n, m, s in zip(i.tolist(), ids[j].tolist(), exact(q, block, i, j).tolist()):
            heap = heaps[n]
            if len(heap) < k:
                heapq.heappush(heap, (s, -m))
            elif (s, -m) > heap[0]:
                heapq.heapreplace(heap, (s, -m))
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    rows = [(qid, -m, s) for qid, h in zip(q_ids.tolist(), heaps) for s, m in h]
    out = tuple(np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return out, recomputed


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    ids = t.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, repeated rows once."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    live = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return (live.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))
            .dropDuplicates(["vec_id", "v"]))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, query_rows: int = QUERY_ROWS,
            candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products for every row of ``vectors`` that ``is_query`` selects.

    ``vectors`` comes from ``usable``. Groups are random deals by a hash, so no vector or id can make one group hot.
    """
    spark = vectors.sparkSession
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    q_groups, c_groups = max(1, -(-n_queries // query_rows)), max(1, -(-n // candidate_rows))

    def dealt(df, groups, other, mine, theirs):
        group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias(mine)
        return df.select("dim", "vec_id", "v", group, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    queries = dealt(vectors.filter(is_query), q_groups, c_groups, "qg", "cg")
    candidates = dealt(vectors, c_groups, q_groups, "cg", "qg")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q = _matrix(left)
        c_ids, c = _matrix(right)
        (qi, ci, s), _ = search_tile(q_ids, q, c_ids, c, k) if len(q_ids) and len(c_ids) else ((np.zeros(0, int),) * 2 + (np.zeros(0),), 0)
        return pa.table({"query_id": pa.array(qi, pa.int64()), "vec_id": pa.array(ci, pa.int64()), "score": pa.array(s, pa.float64())})

    # One partition per tile: tiles are independent and of bounded size.
    tiles = min(q_groups * c_groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["dim", "qg", "cg"]
    found = (queries.repartition(tiles, *key).groupBy(*key)
             .cogroup(candidates.repartition(tiles, *key).groupBy(*key))
             .applyInArrow(tile, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
