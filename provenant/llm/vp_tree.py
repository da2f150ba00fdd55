"""Operator 6: nearest neighbours by vantage-point trees, one per shard.

Vectors are hashed into shards of about ``SHARD`` rows.  Each shard lifts its
vectors by one coordinate to equal length, so that Euclidean distance orders
them like the inner product, and builds a vantage-point tree: a node's vantage
point splits the rest at the median distance.  A subtree is left out for a
query when the triangle inequality says that even its nearest point is too
far: ``bound * factor > distance of the k-th nearest so far``.  ``factor`` 1 is
exact; larger values prune more and may miss.  Queries go through a tree as a
batch, the nearer side first, with matrix products at the leaves.

The trees are one table in the shared folder.  Queries are broadcast in blocks
of at most ``QUERY_BLOCK`` rows (a block's bytes are bounded by the vectors'
dimension); more queries take more passes.  Per shard only the k best of a query leave, and
the k best of all are chosen with a limit before the shuffle.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows without vec_id; vectors meet
only those of their own dimension; of rows that repeat a vec_id the smallest
vector counts; equal vectors are one tree entry and rank by vec_id; an empty
table has no rows.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.session import materialize

SHARD = 4096
LEAF = 64
QUERY_BLOCK = 16_384
#: relative slack against rounding in matrix products
ROUNDING = 1e-9


class VantageTree:
    """A tree over distinct vectors; ``ids`` lists each one's row ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        which = which.ravel()
        x = vectors[first]
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max())
        lift = np.sqrt(np.maximum(0.0, self.top - norms))
        n = len(x)
        self.order = np.arange(n)
        self.nodes: dict[tuple[int, int], tuple] = {}  # range -> split, near low/high, far low/high
        todo = [(0, n)]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                continue
            part = self.order[a:b]
            # the first of the range, which earlier splits left in distance order: an outer point
            part[[0, -1]] = part[[-1, 0]]
            p = part[0]
            d = np.sqrt(np.maximum(0.0, 2 * (self.top - (x[part[1:]] @ x[p] + lift[part[1:]] * lift[p]))))
            by = np.argsort(d, kind="stable")
            part[1:] = part[1:][by]
            d = d[by]
            m = a + 1 + len(d) // 2
            near, far = d[:m - a - 1], d[m - a - 1:]
            self.nodes[a, b] = (m, near[0], near[-1], far[0], far[-1])
            todo += [(a + 1, m), (m, b)]
        self.x = x[self.order]
        self.lift = lift[self.order]
        by_vector = np.argsort(which, kind="stable")  # ids ascending within a vector
        ends = np.cumsum(np.bincount(which, minlength=n))
        groups = np.split(ids[by_vector], ends[:-1])
        self.ids = [groups[k] for k in self.order]

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) that hold the k entries of largest inner
        product of every query, and all within rounding of the k-th."""
        nq, n = len(q), len(self.x)
        k = min(k, n)
        norm = np.einsum("ij,ij->i", q, q)
        slack = ROUNDING * np.sqrt(norm * self.top) + 1e-300
        best = np.full((nq, k), -np.inf)  # inner products, the smallest first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def distance(who, ip):
            return np.sqrt(np.maximum(0.0, norm[who] + self.top - 2 * ip))

        def meet(who, a, b):
            ip = q[who] @ self.x[a:b].T
            i, j = np.nonzero(ip >= (best[who, 0] - slack[who])[:, None])
            if len(i):
                found.append((who[i], j + a, ip[i, j]))
                both = np.concatenate((best[who], ip), axis=1)
                cut = both.shape[1] - k
                both.partition(cut, axis=1)
                top = both[:, cut:]
                top.sort(axis=1)
                best[who] = top
            return ip

        def open_(who, d, low, high):
            """Queries for which the part at distances low..high may matter."""
            bound = np.maximum(d - high, low - d) * factor
            kth = distance(who, best[who, 0] - slack[who])
            return bound <= kth + ROUNDING * math.sqrt(self.top) * 1e3

        stack = [(0, n, np.arange(nq), None)]
        while stack:
            a, b, who, check = stack.pop()
            if check is not None:
                keep = open_(who, *check) if check[0] is not None else slice(None)
                who = who[keep]
            if not len(who):
                continue
            node = self.nodes.get((a, b))
            if node is None:
                meet(who, a, b)
                continue
            m, near_low, near_high, far_low, far_high = node
            d = distance(who, meet(who, a, a + 1)[:, 0])
            inner = d <= (near_high + far_low) / 2
            # last in, first out: each query's nearer side comes first
            stack.append((a + 1, m, who[~inner], (d[~inner], near_low, near_high)))
            stack.append((m, b, who[inner], (d[inner], far_low, far_high)))
            stack.append((m, b, who[~inner], None))
            stack.append((a + 1, m, who[inner], None))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, entry, ip = (np.concatenate(x) for x in zip(*found))
        keep = ip >= best[who, 0] - slack[who]
        return who[keep], entry[keep]


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def valid(v: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part, one per id."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v")))
    if rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def build_trees(rows: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(dim, shard, tree): the index, written to the shared folder."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        tree = VantageTree(group.column("id").to_numpy(), flat)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
                         "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"))


def _search_block(trees: DataFrame, queries: list, k: int, factor: float) -> DataFrame:
    """The k best of every shard for one block of queries [(id, vector)]."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(v) for _, v in queries}:
        own = [(i, v) for i, v in queries if len(v) == dim]
        by_dim[dim] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64))
    shared = trees.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches):
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("tree")):
                if dim not in shared.value:
                    continue
                ids, q = shared.value[dim]
                tree: VantageTree = pickle.loads(raw.as_py())
                # the query itself may be among the k + 1 nearest entries
                who, entry = tree.search(q, k + 1, factor)
                score = inner_products(q[who], tree.x[entry])
                cut = [tree.ids[e][:k + 1] for e in entry.tolist()]
                times = np.array([len(c) for c in cut])
                who, score = np.repeat(who, times), np.repeat(score, times)
                other = np.concatenate(cut) if cut else np.zeros(0, np.int64)
                keep = ids[who] != other
                who, score, other = who[keep], score[keep], other[keep]
                order = np.lexsort((other, -score, who))
                who, score, other = who[order], score[order], other[order]
                place = np.arange(len(who)) - np.searchsorted(who, who, side="left")
                keep = place < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[who[keep]]), pa.array(other[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(trees: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query."""
    blocks = max(1, math.ceil(queries.count() / block))
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(blocks)) == b)
        found = _search_block(trees, [(r["id"], r["v"]) for r in part.collect()], k, factor)
        parts.append(found if blocks == 1 else materialize(found))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every``."""
    rows = vectors_of(table, id_col, vector_col)
    return nearest(build_trees(rows), rows.where(F.col("id") % every == 0), k, factor)
