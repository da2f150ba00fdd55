"""Operator 1: MinHash near-duplicate components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes).
   Universal hash functions (multiply-add-shift) give many minima; ``ROWS``
   minima make a band, and there are as many bands as keep the chance of
   missing a pair at the threshold below ``MISS``.
2. Equal sets (128-bit fingerprint) collapse to their smallest doc_id, with
   partial aggregation, so groups of copies cost one row from here on.
3. Per band bucket, members are paired with the bucket's smallest member only
   (never all pairs).  A member's most frequent such partner is verified: first
   by signature, then on the full sets.
4. Verified links go through connected components.  Buckets whose members are
   now one component need no more work.  In the others only pairs *between*
   components are open.  They are compared in bounded blocks, without listing
   pairs: first by a byte of each minimum, which leaves the rows that have a
   possible partner at all, then by 16 bits of each element, which bound from
   above what two sets share, then on the full sets of the rows left.  The links
   found are joined to the components in a second, smaller run.

Full sets are the wide rows here: they meet others by sort-merge joins at every
size, and only sets of rows that passed the narrow tests are shuffled.

All thresholds are integer comparisons on full sets, so links are exact; the
only approximation is ``MISS``.

Defined results: null, empty or word-less text has the empty set and is linked
with nothing; with fewer words than a shingle, the whole sequence is the one
shingle; repeated rows are each reported, with the component of their text; a
null doc_id is no document: its row has component null and is kept; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import mix, text_slices
from provenant.llm.graph import components
from provenant.session import materialize

ROWS = 6
MISS = 1e-6
#: rows of one side of a block
BLOCK = 512
#: the lowest bits of a bucket's key are its band
BAND = 0xFFF
#: ids up to this number may be broadcast to pick texts (16 MB at most)
BROADCAST_IDS = 1_000_000


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words of each text."""
    words: list[bytes] = []
    counts = []
    for t in texts:
        own = t.encode().lower().split() if t else []  # bytes: A-Z and ASCII space only
        counts.append(len(own))
        words += own
    coded = pa.array(words, pa.binary()).dictionary_encode()
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    index = coded.indices.to_numpy()
    return values[index] if len(index) else np.zeros(0, np.uint64), np.asarray(counts, np.int64)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    h = mix(w + np.uint64(k))
    grams = h[:max(0, len(w) - k + 1)].copy()
    for j in range(1, k):
        grams = mix(grams + w[j:j + len(grams)])
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(grams[end - n:end - k + 1]))
        elif n:
            x = mix(w[end - n:end - n + 1] + np.uint64(1000 + n))
            for j in range(1, n):
                x = mix(x + w[end - n + j])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """``bands`` bands of ``ROWS`` universal hash minima for one threshold."""

    def __init__(self, percent: int, rows: int = ROWS, miss: float = MISS, seed: int = 20):
        s = percent / 100
        self.rows = rows
        self.bands = max(1, math.ceil(math.log(miss) / math.log1p(-min(s ** rows, 1 - 1e-9))))
        rng = np.random.default_rng(seed)
        n = self.bands * rows
        if self.bands > BAND:
            raise ValueError(f"{percent} % needs {self.bands} bands; at most {BAND} are supported")
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # six standard deviations below the expected matches at the threshold
        self.least = math.floor(n * s - 6 * math.sqrt(n * s * (1 - s)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        x = shingles >> np.uint64(32)
        for at in range(0, len(x), 512):
            part = (self.a[:, None] * x[None, at:at + 512] + self.b[:, None]).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return (low >> np.uint64(32)).astype(np.uint32)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        m = signature.astype(np.uint64).reshape(self.bands, self.rows)
        band = np.arange(self.bands, dtype=np.uint64)
        key = mix((m * self.mul[None, :]).sum(axis=1, dtype=np.uint64) + band * np.uint64(0x9E3779B97F4A7C15))
        return (key & ~np.uint64(BAND) | band).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _band_table(rows: DataFrame, k: int, model: MinHash) -> DataFrame:
    """doc_id, n, fingerprint (f1, f2), bands; rows in any order."""

    def run(batches):
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            prints = [_fingerprint(s) for s in sets]
            bands = [model.band_keys(model.signature(s)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                 pa.array([p[1] for p in prints], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "f1", "f2", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, f1 long, f2 long, bands array<long>")


def _set_table(rows: DataFrame, k: int, model: MinHash) -> DataFrame:
    """id, n, low (a byte of each minimum), short (16 bits of each element,
    sorted), elements (sorted 64-bit values) of candidate texts."""

    def run(batches):
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([model.signature(s).astype(np.uint8).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                 pa.array([np.sort(s.astype(np.uint16)).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "low", "short", "elements"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, low binary, short binary, elements binary")


def pieces(short: bytes) -> np.ndarray:
    """Sorted 16-bit pieces as distinct values, each with its number among its
    equals.  Two sets share no more elements than these values, so that sets
    that are ``similar`` have ``similar`` pieces."""
    v = np.frombuffer(short, np.uint16).astype(np.uint64)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(v)))
    return v << np.uint64(32) | (np.arange(len(v)) - np.repeat(first, count)).astype(np.uint64)


def _one_each(sets: DataFrame) -> DataFrame:
    """One of the sets of each id; those of ids with one set are not shuffled."""
    again = materialize(sets.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    if not again.limit(1).count():
        return sets
    return materialize(sets.join(again, "id", "left_anti").unionByName(
        sets.join(again, "id", "left_semi").dropDuplicates(["id"])))


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of these ids; few ids go to the sets, the other sets stay."""
    ids = ids.distinct()
    few = ids.count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame, model: MinHash, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: by signature, then on the full sets of
    the pairs that remain."""
    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])

    def passed(pairs, sets, column, kind, test):
        one = sets.select(F.col("id").alias("a"), F.col(column).alias("of_a"))
        two = sets.select(F.col("id").alias("b"), F.col(column).alias("of_b"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "of_a", "of_b")

        def run(batches):
            for batch in text_slices(batches, "of_a"):
                cols = [batch.column(c).to_pylist() for c in ("of_a", "of_b")]
                ok = [bool(test(np.frombuffer(x, kind), np.frombuffer(y, kind))) for x, y in zip(*cols)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return both.mapInArrow(run, schema)

    near = materialize(passed(pairs, sets, "low", np.uint8, lambda x, y: np.count_nonzero(x == y) >= model.least))
    ends = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
    return passed(near, _only(sets, ends), "elements", np.uint64, lambda x, y: similar(x, y, percent))


def _open_blocks(members: DataFrame) -> DataFrame:
    """Bucket members (key, id, comp) dealt into bounded comparison blocks:
    (block, band, id, comp, left, right), narrow rows.

    Only buckets of several components are given.  The members outside the
    bucket's largest component (side 0) meet each other and those of the
    largest component (side 1); side 1 never meets itself.  Rows of a side are
    hashed into parts of about ``BLOCK``; a block holds two parts."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("k"))
    tops = tops.where("k > 1").select("key", F.col("top.comp").alias("top"), F.ceil(F.col("top.c") / BLOCK).alias("p1"),
                                      F.ceil((F.col("all") - F.col("top.c")) / BLOCK).alias("p0"))
    m = members.join(tops, "key").withColumn("side", (F.col("comp") == F.col("top")).cast("int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    i0, i1 = part("p0"), part("p1")
    name = lambda x, y, s: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(s).alias("across"))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("p0") - 1), lambda j: name(F.least(i0, j), F.greatest(i0, j), False)),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("p1") - 1), lambda j: name(i0, j, True)))
    inside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p0") - 1), lambda j: name(j, i1, True))
    return m.select("key", "id", "comp", "side", F.when(F.col("side") == 0, i0).otherwise(i1).alias("own"),
                    F.explode(F.when(F.col("side") == 0, outside).otherwise(inside)).alias("block")).select(
        F.xxhash64("key", "block.x", "block.y", "block.across").alias("block"), F.col("key").bitwiseAND(F.lit(BAND)).cast("int").alias("band"),
        "id", "comp",
        # the two parts that meet in this block; equal where a part meets itself
        F.when(F.col("block.across"), F.col("side") == 0).otherwise(F.col("own") == F.col("block.x")).alias("left"),
        F.when(F.col("block.across"), F.col("side") == 1).otherwise(F.col("own") == F.col("block.y")).alias("right"))


def _by_block(rows: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work(columns of one block)`` -> output tuples, block by block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, arrow = rows.columns, to_arrow_schema(schema)
    rows = rows.repartition("block").sortWithinPartitions("block")

    def run(batches):
        group, now = [], None
        for batch in text_slices(batches, names[-1], 16 << 20):
            found: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] != now:
                    if len(group) > 1:
                        found += work(*zip(*group))
                    group, now = [], row[0]
                group.append(row)
            yield found
        if len(group) > 1:
            yield work(*zip(*group))

    def out(batches):
        for found in run(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    return rows.mapInArrow(out, schema)


def _compare_blocks(blocks: DataFrame, sets: DataFrame, model: MinHash, percent: int) -> DataFrame:
    """Links (a, b) between components found inside the blocks; at most one
    link for each two components of a block.

    Two rows that share several buckets are compared in that of the first band
    they share.  (It is open as well, for they are of two components; of
    buckets with the same members that of the first band is kept.)"""

    def partners(i, band, right, codes, sizes, low):
        """Rows on the right that may be similar to row i, of another
        component, and share no earlier band with it."""
        near = right & (codes != codes[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        at = np.flatnonzero(near)
        equal = low[at] == low[i]
        enough = np.count_nonzero(equal, axis=1) >= model.least
        at, equal = at[enough], equal[enough]
        return at[equal.reshape(len(at), model.bands, model.rows).all(axis=2).argmax(axis=1) == band]

    def arrays(comp, right, n, low):
        names = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        return (np.array(right), np.array([names[c] for c in comp]), np.array(n),
                np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1))

    def possible(block, band, id_, comp, left, right, n, low):
        right_, codes, sizes, low_ = arrays(comp, right, n, low)
        keep = np.zeros(len(id_), bool)
        for i in np.flatnonzero(left).tolist():
            found = partners(i, band[0], right_, codes, sizes, low_)
            keep[found] = True
            keep[i] |= len(found) > 0
        return [(block[i], band[i], id_[i], comp[i], left[i], right[i]) for i in np.flatnonzero(keep).tolist()]

    def likely(block, band, id_, comp, left, right, n, low, short):
        right_, codes, sizes, low_ = arrays(comp, right, n, low)
        sets_ = [pieces(s) for s in short]
        keep = np.zeros(len(id_), bool)
        for i in np.flatnonzero(left).tolist():
            for j in partners(i, band[0], right_, codes, sizes, low_).tolist():
                if not (keep[i] and keep[j]) and similar(sets_[i], sets_[j], percent):
                    keep[i] = keep[j] = True
        return [(block[i], band[i], id_[i], comp[i], left[i], right[i]) for i in np.flatnonzero(keep).tolist()]

    def links(block, band, comp, left, right, n, low, elements):
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        right_, codes, sizes, low_ = arrays(comp, right, n, low)
        sets_ = [np.frombuffer(e, np.uint64) for e in elements]
        found = []
        for i in np.flatnonzero(left).tolist():
            for j in partners(i, band[0], right_, codes, sizes, low_).tolist():
                x, y = root(comp[i]), root(comp[j])
                if x != y and similar(sets_[i], sets_[j], percent):
                    parent[x] = y
                    found.append((comp[i], comp[j]))
        return found

    row = ["block", "band", "id", "comp", "left", "right"]
    kind = blocks.select(row).schema
    narrow = blocks.join(sets.select("id", "n", "low").hint("merge"), "id").select(*row, "n", "low")
    some = materialize(_by_block(narrow, possible, kind))
    short = some.join(sets.select("id", "n", "low", "short").hint("merge"), "id").select(*row, "n", "low", "short")
    some = materialize(_by_block(short, likely, kind))
    wide = some.join(_only(sets, some.select("id")).hint("merge"), "id").select(
        "block", "band", "comp", "left", "right", "n", "low", "elements")
    kind = blocks.schema["comp"].dataType
    return _by_block(wide, links, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    model = MinHash(percent)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = materialize(_band_table(rows, k, model))

    # copies collapse: one row for each set
    reps = materialize(table.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    bands = reps.select("id", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = materialize(bands.join(buckets, "key"))
    wanted = members.select("id").distinct()
    few = wanted.count() <= BROADCAST_IDS
    wanted = wanted.withColumnRenamed("id", "doc_id")
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    sets = _one_each(materialize(_set_table(texts, k, model)))

    # first run: each member and the bucket minimum it meets most often
    tried = members.where("id != pivot").groupBy("id", "pivot").agg(F.count("*").alias("c")).groupBy("id").agg(
        F.max(F.struct("c", "pivot")).alias("top")).select(F.col("id").alias("a"), F.col("top.pivot").alias("b"))
    first = components(_verify(tried, sets, model, percent))

    # second run: between the components that still share a bucket
    named = members.join(first.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("comp"))
    h = F.xxhash64("id")
    open_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"),
                                         F.sum(F.shiftright(h, 20)).alias("s"), F.bit_xor(h).alias("h"))
    # buckets of the same members need one comparison, in their first band
    first_band = F.min_by("key", F.col("key").bitwiseAND(F.lit(BAND)))
    open_keys = open_keys.where("x != y").groupBy("c", "s", "h").agg(first_band.alias("key")).select("key")
    blocks = _open_blocks(materialize(named.join(open_keys, "key", "left_semi")))
    second = components(_compare_blocks(blocks, sets, model, percent))

    # set -> first component -> second component
    final = reps.select("f1", "f2", "n", "id").join(first.select(F.col("node").alias("id"), F.col("component").alias("c1")), "id", "left")
    final = final.withColumn("c1", F.coalesce("c1", "id")).join(
        second.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
    final = final.select("f1", "f2", "n", F.coalesce("c2", "c1").alias("component"))
    done = table.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all
    its columns; rows that repeat a doc_id count as one document, of which the
    row with the smallest text stays; rows without a doc_id stay."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    kept = materialize(found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(id_col)).agg(
        F.count_if("kept").alias("n")))
    # the ids to drop are few beside those kept: texts stay where they are
    gone = kept.where("n = 0").select(id_col)
    few = gone.count() <= BROADCAST_IDS
    repeats = kept.where("n > 1").limit(1).count() > 0
    chosen = docs.where(F.col(id_col).isNotNull()).join(F.broadcast(gone) if few else gone, id_col, "left_anti")
    if repeats:
        again = kept.where("n > 1").select(id_col)
        twice = chosen.join(again, id_col, "left_semi")
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last(), F.xxhash64(*[F.col(c) for c in docs.columns]))
        first = twice.withColumn("_rk", F.row_number().over(order)).where("_rk = 1").drop("_rk")
        chosen = chosen.join(again, id_col, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))
    return chosen.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
