"""Operator 13: SimHash near-duplicates through vantage-point trees.

1. Each text becomes a 64-bit fingerprint: a bit is one if more than half of
   its shingles' XXH64 values have it.  Equal fingerprints collapse to their
   smallest doc_id (combined before the shuffle).
2. Distinct fingerprints are dealt to shards by the upper part of a
   vantage-point tree.  A node sends a fingerprint at Hamming distance d of its
   vantage point to the near side if d <= m + r and to the far side if d > m
   (r: the link radius).  By the triangle inequality two fingerprints within r
   are then together on the near side (if either has d <= m) or on the far
   side: those near a boundary are queried against both, and no pair is lost.
   The tree is fitted on a bounded sample (``SAMPLE`` fingerprints a round) that
   decides only where the cuts lie; shards that are still too large are cut
   again by a new round on a sample of their own.
3. Each shard goes down the same kind of tree to small leaves, where all pairs
   are compared.  Fingerprints within r of a vantage point are tied to it, and
   a branch whose members are tied together already is left out: one dense
   cluster costs little more than its size.  A shard gives a tree of links, at
   most one for each member.
4. Links go through connected components (alternating large-star, small-star).

All links are exact; sample, shard size and random choices never change them.
Distances to a vantage point crowd around 32, so a cut leaves about 0.65 of the
rows on each side: copies dealt grow as (rows / shard)^0.58, comparisons as
rows^1.58.

Defined results: null, empty or word-less text has fingerprint zero and is
linked like any other; with fewer words than a shingle the whole sequence is
the one shingle; repeated rows are each reported, and rows that share a doc_id
but not the text are each linked by their own text; a null doc_id is no
document: its row has a fingerprint and no component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import text_slices
from provenant.llm.graph import components
from provenant.operators.skew import hot_split_join
from provenant.session import materialize

RADIUS = 3
SHARD = 32_768
#: fingerprints on the driver at once (8 bytes each), to place the cuts
SAMPLE = 65_536
#: a shard's cuts are fitted down to this many sampled fingerprints
SAMPLE_LEAF = 64
LEAF = 1024
#: a cut pays if the pairs left inside its two sides are below this share of all
WORTH = 0.95
#: no more shards than about this times the overlap: larger tables get larger shards
SHARDS = 4096
SEED = 42


def fingerprint(text: str | None, k: int) -> int:
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))  # each one past the space
    if len(words) < k:
        grams = [joined]
    else:
        grams = [joined[a:b - 1] for a, b in zip([0, *ends], ends[k - 1:])]
    values = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 8192):
        bits = np.unpackbits(values[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""

    def run(batches):
        for batch in text_slices(batches, "text"):
            prints = [fingerprint(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def distances(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


def choose_cut(prints: np.ndarray, radius: int, rng: np.random.Generator, tries: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage point, m, distances) of the cut that leaves the fewest pairs,
    of some points drawn; None if none is worth it."""
    n = len(prints)
    best, cut = WORTH * n * n, None
    for point in prints[rng.integers(0, n, tries)]:
        d = distances(prints, point)
        upto = np.cumsum(np.bincount(d, minlength=65 + radius))
        near = upto[np.minimum(np.arange(64) + radius, 64)].astype(float)
        cost = near ** 2 + (n - upto[:64]).astype(float) ** 2
        m = int(cost.argmin())
        if cost[m] < best:
            best, cut = cost[m], (point, m, d)
    return cut


def fit_cuts(prints: np.ndarray, rows: float, radius: int, shard_rows: int, rng: np.random.Generator, new_shard):
    """Upper tree over a sample that stands for ``rows`` fingerprints: nested
    (point, m, near, far) with shard numbers at the ends."""
    if rows <= shard_rows or len(prints) < SAMPLE_LEAF:
        return new_shard()
    cut = choose_cut(prints, radius, rng, 12)
    if cut is None:
        return new_shard()
    point, m, d = cut
    sides = [prints[d <= m + radius], prints[d > m]]
    return (point, m, *(fit_cuts(side, rows * len(side) / len(prints), radius, shard_rows, rng, new_shard) for side in sides))


def _route(tree, prints: np.ndarray, index: np.ndarray, radius: int, out: list):
    if not isinstance(tree, tuple):
        out.append((tree, index))
    elif len(index):
        point, m, near, far = tree
        d = distances(prints[index], point)
        _route(near, prints, index[d <= m + radius], radius, out)
        _route(far, prints, index[d > m], radius, out)


def deal_shards(points: DataFrame, radius: int, shard_rows: int, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """(shard, fp), where any two fingerprints within ``radius`` share a
    shard, and the number of shards; they hold about ``shard_rows``, unless
    they cannot be cut."""
    now = points.select(F.lit(0).cast("long").alias("shard"), "fp")
    counts = {0: now.count()}
    shard_rows = max(shard_rows, counts[0] // SHARDS)
    rng = np.random.default_rng(1)
    closed: set[int] = set()
    last, turn = 0, 0
    while True:
        open_ = {s: c for s, c in counts.items() if c > shard_rows and s not in closed}
        if not open_:
            return now, len(counts)
        turn += 1
        total = sum(open_.values())
        share = F.pmod(F.xxhash64(F.lit(turn), "fp"), F.lit(1 << 40)) < min(1.0, sample / total) * (1 << 40)
        if len(open_) < len(counts):
            share &= F.col("shard").isin(list(open_))
        drawn = np.array([tuple(r) for r in now.where(share).select("shard", "fp").limit(2 * sample).collect()], np.int64).reshape(-1, 2)

        def new_shard():
            nonlocal last
            last += 1
            return last

        trees = {}
        for s, c in open_.items():
            mine = drawn[drawn[:, 0] == s, 1].astype(np.uint64)
            trees[s] = fit_cuts(mine, c, radius, shard_rows, rng, new_shard)
            if not isinstance(trees[s], tuple):  # no cut helps: it stays one shard
                closed.add(trees[s])
        now = materialize(_deal(now, trees, radius))
        counts = {r["shard"]: r["count"] for r in now.groupBy("shard").count().collect()}


def _deal(rows: DataFrame, trees: dict, radius: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column("shard").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
            ends: list = []
            for s in np.unique(shards).tolist():
                _route(shared.value.get(s, s), prints, np.flatnonzero(shards == s), radius, ends)
            at = np.concatenate([index for _, index in ends])
            shard = np.repeat(np.array([s for s, _ in ends], np.int64), [len(index) for _, index in ends])
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("fp").take(pa.array(at))], names=["shard", "fp"])

    return rows.mapInArrow(run, "shard long, fp long")


class Links:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, index: np.ndarray) -> np.ndarray:
        now = self.parent[index]
        while True:
            up = self.parent[now]
            if np.array_equal(up, now):
                self.parent[index] = now
                return now
            now = up

    def tie(self, a: np.ndarray, b: np.ndarray):
        """Join the components of a[i] and b[i], for all i."""
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_prints(prints: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """For each position the smallest one connected to it by steps of at most
    ``radius`` bits."""
    links, rng = Links(len(prints)), np.random.default_rng(2)
    todo = [np.arange(len(prints))]
    while todo:
        index = todo.pop()
        if len(index) < 2 or (links.roots(index) == links.roots(index[:1])).all():
            continue
        own = prints[index]
        cut = choose_cut(own, radius, rng, 3) if len(index) > leaf else None
        if cut is not None:
            point, m, d = cut
            ball = index[d <= radius]
            links.tie(ball[1:], np.full(len(ball) - 1, ball[0]) if len(ball) else ball[1:])
            todo += [index[d <= m + radius], index[d > m]]
            continue
        # small, or of no use to cut: all pairs, a block of rows at a time
        step = max(1, (1 << 20) // len(index))
        for at in range(0, len(index), step):
            rows = own[at:at + step]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ own[None, at:]) <= radius)
            links.tie(index[at + i], index[at + j])
    return links.roots(np.arange(len(prints)))


def shard_links(shards: DataFrame, count: int, radius: int) -> DataFrame:
    """(a, b): each fingerprint's smallest linked one inside its shard.

    One partition a shard: their rows are few bytes, but much work."""

    def link(group: pa.Table) -> pa.Table:
        prints = np.sort(group.column("fp").to_numpy())
        root = link_prints(prints.view(np.uint64), radius)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": prints[tied], "b": prints[root[tied]]})

    return shards.repartition(count, "shard").groupBy("shard").applyInArrow(link, "a long, b long")


def near_fingerprints(docs: DataFrame, k: int = 3, radius: int = RADIUS, shard_rows: int = SHARD, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, fingerprint (hex), component_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = materialize(fingerprints(rows, k))
    points = materialize(table.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    tied = components(shard_links(*deal_shards(points, radius, shard_rows), radius))
    named = points.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    named = hot_split_join(named, least, "root").select("fp", "component")
    done = hot_split_join(table, named, "fp", "left")
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
