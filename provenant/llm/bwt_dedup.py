"""Operator 3: byte-exact removal of repeated strings by merging Burrows-Wheeler
transforms.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a
document of smaller id.  All suffixes of the corpus are never sorted together:

1. Copies: of equal texts only the smallest id goes on; the others are removed
   whole (one aggregate over text digests).
2. Anchors: every ``LENGTH``-byte window has an anchor, the least hash among its
   ``ANCHOR``-byte strings, which depends on the window's bytes alone.  Texts are
   hashed into shards; each shard sends its distinct anchors once (48 bits),
   packed by bucket, and learns which of them another document has too.
   Windows whose anchor is unique cannot repeat and go no further.  An anchor
   with very many runs is hot; its windows are dealt by longer strings.
3. Merging: neighbouring windows of one repeated anchor form a short string.  A
   shard's distinct strings go to the bucket of their anchor, so all
   occurrences of a window meet in one bucket.  There the strings, what shards
   have alike once, become Burrows-Wheeler transforms, merged by
   iterative interleave refinement: an interleave of shard numbers, refined
   two symbols a round by a stable bucketing along the transforms, is in the
   end ordered by the first ``LENGTH`` symbols.  Where a round parts two
   neighbours their common prefix ends, so the blocks that remain are the
   repeated intervals.  A block's smallest document answers all its
   windows.
4. Shards mark the windows whose answer is smaller than the document's own id
   and cut the covered bytes.

Hot strings: a passage in a third of all documents is one entry per shard; an
anchor in very many contexts is spread over buckets.  Buckets, shards and tasks
grow in number with the input, not in size.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose
nothing; rows that repeat a doc_id are each reported and do not remove each
other; a row without doc_id loses nothing and removes nothing; ids must be
integers; matches never cross texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import mix, text_slices, total_bytes
from provenant.session import materialize

LENGTH = 50
ANCHOR = 16
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
#: windows of one string at most, so strings are short
RUN = 64
#: an anchor of this many runs, or of 255 in one shard, is hot: its windows are
#: dealt by longer strings, common to ``STEP`` neighbouring windows
HOT_RUNS = 8192
STEP = 5
#: strings of about this many bytes make one transform
TRANSFORM_BYTES = 256 << 10
BROADCAST_IDS = 1_000_000
_HASH_BITS = 47
_PIECE = 1 << 19  # bytes hashed at once


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words(data: bytes, n: int, at: int) -> np.ndarray:
    """The eight bytes ``at`` places after each of the first ``n``, as a number."""
    return np.ndarray((n,), "<u8", buffer=np.frombuffer(data, np.uint8)[at:], strides=(1,))


def string_hashes(data: bytes) -> np.ndarray:
    """Hash of the ``ANCHOR``-byte string at every position."""
    n = len(data) - ANCHOR + 1
    word = lambda at: _words(data, n, at)
    low = mix(word(0) * np.uint64(0x9E3779B97F4A7C15) + (word(8) ^ (word(8) >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
    return low >> np.uint64(64 - _HASH_BITS)


def window_anchors(data: bytes) -> np.ndarray:
    """The anchor of the ``LENGTH``-byte window at every position."""
    low = string_hashes(data)
    wide = LENGTH - ANCHOR + 1
    span = 1
    while span < wide:  # minimum over a window by doubling
        step = min(span, wide - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low


class ShardText:
    """A shard's texts end to end, with the windows inside each text."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.asarray(ids, np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.data = b"".join(texts)
        inside = np.ones(len(self.data), bool)  # does a window of one text begin here?
        tails = (self.starts + self.sizes)[:, None] - np.arange(1, LENGTH)[None, :]
        inside[tails[tails >= self.starts[:, None]]] = False
        # runs of windows with one anchor, a piece of the shard at a time;
        # between texts there are places without a window, so no run crosses
        at, length, value = [], [], []
        for a in range(0, len(self.data), _PIECE):
            own = inside[a:a + _PIECE]
            if not own.any():
                continue
            anchors = window_anchors(self.data[a:a + _PIECE + LENGTH - 1])
            own = own[:len(anchors)]
            new = own.copy()
            new[1:] &= ~own[:-1] | (anchors[1:] != anchors[:-1])
            edge = np.append(np.flatnonzero(new | ~own), len(own))
            first = np.flatnonzero(new[edge[:-1]])
            at.append(edge[first] + a)
            length.append(edge[first + 1] - edge[first])
            value.append(anchors[edge[first]])
        at, length = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, length))
        value = np.concatenate(value) if value else np.zeros(0, np.uint64)
        pieces = -(-length // RUN)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.run_at = np.repeat(at, pieces) + part * RUN
        self.run_len = np.minimum(np.repeat(length, pieces) - part * RUN, RUN)
        self.run_anchor = np.repeat(value, pieces)
        self.run_doc = np.searchsorted(self.starts, self.run_at, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, whether two texts here have it, and its
        runs (255 at most)."""
        order = np.argsort(self.run_anchor, kind="stable")
        value, doc = self.run_anchor[order], self.run_doc[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        if not len(first):
            return value, np.zeros(0, bool), np.zeros(0, np.uint8)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        count = np.diff(np.append(first, len(value)))
        return value[first], many, np.minimum(count, 255).astype(np.uint8)


# ---- anchors: asked by shards, answered by buckets --------------------------------------


def _pack_anchors(shard: ShardText, buckets: int):
    values, many, count = shard.anchors()
    bucket = (mix(values) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    packed = np.zeros((len(values), 8), np.uint8)
    packed[:] = ((values[order] << np.uint64(1)) | many[order]).view(np.uint8).reshape(-1, 8)
    packed[:, 6] = count[order]
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part, b in zip(np.split(packed[:, :7], cuts), np.split(bucket[order], cuts)):
        if len(part):
            yield int(b[0]), part.tobytes()


def _unpack_anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(anchors with their flag, runs)."""
    seven = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(seven), 8), np.uint8)
    out[:, :6] = seven[:, :6]
    return out.view(np.uint64).ravel(), seven[:, 6].astype(np.int64)


def _shared_anchors(blobs: list[bytes], hot_runs: int = HOT_RUNS) -> list[bytes]:
    """For each shard's anchors of a bucket two bits, all the first before all
    the second: another text has it; it is hot."""
    parts = [_unpack_anchors(b) for b in blobs]
    flat, count = (np.concatenate(x) for x in zip(*parts))
    value, many = flat >> np.uint64(1), (flat & np.uint64(1)).astype(np.int64)
    distinct, which = np.unique(value, return_inverse=True)
    shared = np.bincount(which, weights=1 + many, minlength=len(distinct)) > 1
    count[count == 255] = hot_runs
    hot = shared & (np.bincount(which, weights=count, minlength=len(distinct)) >= hot_runs)
    cuts = np.cumsum([len(p) for p, _ in parts])[:-1]
    return [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared[which], cuts), np.split(hot[which], cuts))]


class Runs:
    """Runs of windows that may repeat: place, windows, text, and the number
    whose bucket all occurrences of their windows meet in."""

    def __init__(self, at, length, doc, key):
        self.at, self.length, self.doc, self.key = at, length, doc, key


def repeated_runs(shard: ShardText, buckets: int, answers: dict[int, bytes]) -> Runs:
    """The runs whose anchor another text has too; those of hot anchors in
    pieces."""
    values, _, _ = shard.anchors()
    bucket = (mix(values) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bits = np.zeros((2, len(values)), bool)
    if len(values):
        ids, counts = np.unique(bucket, return_counts=True)
        raw = [np.frombuffer(answers[int(b)], np.uint8).reshape(2, -1) for b in ids]
        bits[:, order] = np.concatenate([np.unpackbits(r, axis=1)[:, :c] for r, c in zip(raw, counts)], axis=1).astype(bool)
    shared, hot = bits[:, np.searchsorted(values, shard.run_anchor)] if len(values) else np.zeros((2, 0), bool)
    plain = np.flatnonzero(shared & ~hot)
    own = Runs(shard.run_at[plain], shard.run_len[plain], shard.run_doc[plain], shard.run_anchor[plain] + np.uint64(1))
    split = hot_pieces(shard, np.flatnonzero(hot))
    both = [np.concatenate([getattr(own, c), getattr(split, c)]) for c in ("at", "length", "doc", "key")]
    by = np.argsort(both[0], kind="stable")  # in text order
    return Runs(*(x[by] for x in both))


def hot_pieces(shard: ShardText, runs: np.ndarray) -> Runs:
    """The runs cut into pieces of at most ``STEP`` windows.

    A window's place relative to the first occurrence of its anchor in it, and
    so the piece, depend on its bytes alone; all windows of a piece hold one
    string of ``LENGTH - STEP + 1`` bytes, whose hash is the piece's number.
    Equal windows thus meet in one bucket, and an anchor with very many
    contexts is spread by them."""
    at, length = shard.run_at[runs], shard.run_len[runs]
    if not len(runs):
        return Runs(at, length, shard.run_doc[runs], shard.run_anchor[runs])
    size = length + LENGTH - 1
    base = np.cumsum(size) - size
    data = b"".join(shard.data[a:a + k] for a, k in zip(at.tolist(), size.tolist()))
    run = np.repeat(np.arange(len(runs)), size)
    here = np.arange(len(data))
    held = string_hashes(data)
    is_anchor = np.zeros(len(data), bool)
    is_anchor[:len(held)] = held == shard.run_anchor[runs][run[:len(held)]]
    following = np.minimum.accumulate(np.where(is_anchor, here, len(data))[::-1])[::-1]
    window = here[here - base[run] < length[run]]
    first, of = following[window], run[window]
    common = first - (first - window) // STEP * STEP
    new = np.append(True, (common[1:] != common[:-1]) | (of[1:] != of[:-1]))
    start = np.flatnonzero(new)
    place, wide = common[start], LENGTH - STEP + 1
    key = np.zeros(len(start), np.uint64)
    for k in [*range(0, wide - 8, 8), wide - 8]:
        key = mix(key + _words(data, len(data) - wide + 1, k)[place])
    of, window = of[start], window[start]
    return Runs(at[of] + window - base[of], np.diff(np.append(start, len(new))), shard.run_doc[runs][of], key)


def shard_strings(shard: ShardText, runs: Runs, buckets: int):
    """Distinct strings of the runs by bucket: (bucket, strings, sizes, least
    document) and, per run, its bucket and place there."""
    data, at, n = shard.data, runs.at.tolist(), runs.length.tolist()
    bucket = (mix(runs.key) % np.uint64(buckets)).astype(np.int64)
    ids = shard.ids[runs.doc].tolist()
    by: dict[int, dict[bytes, int]] = {}
    least: dict[int, list[int]] = {}
    place = []
    for b, a, k, i in zip(bucket.tolist(), at, n, ids):
        own = by.setdefault(b, {})
        s = data[a:a + k + LENGTH - 1]
        j = own.setdefault(s, len(own))
        low = least.setdefault(b, [])
        if j == len(low):
            low.append(i)
        elif i < low[j]:
            low[j] = i
        place.append(j)
    packed = [(b, b"".join(own), np.array([len(s) for s in own], np.uint16), np.array(least[b], np.int64)) for b, own in by.items()]
    return packed, bucket, np.asarray(place, np.int64)


# ---- Burrows-Wheeler transforms and their merge -------------------------------------------


def first_symbols(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The first symbols of every suffix as one number, 0 after its end, and how
    many they are: as many as 64 bits hold."""
    key, held = symbols, 1
    while key.itemsize < 8:
        wide = key.astype(f"u{2 * key.itemsize}")
        follow = np.zeros_like(wide)
        follow[:-held] = wide[held:]
        follow[(key & np.iinfo(symbols.dtype).max) == 0] = 0
        key = (wide << (8 * key.itemsize)) | follow
        held *= 2
    return key, held


class Transform:
    """BWT of a collection of strings over symbols 1.., each ended by 0.

    ``order``: position of every row's suffix; ``prefix``: its first symbols;
    ``symbols``: the symbol before it; ``back``: the row of the suffix one symbol
    longer."""

    def __init__(self, symbols: np.ndarray, to_end: np.ndarray):
        n = len(symbols)
        key, h = first_symbols(symbols)
        order = np.argsort(key)
        rank, open_ = self._ranks(order, key[order], np.arange(n), n)
        # doubling, only for suffixes that are not yet alone
        while len(open_):
            follow = np.zeros(len(open_), np.int64)
            far = to_end[open_] >= h
            follow[far] = rank[open_[far] + h] + 1
            own = rank[open_]
            by = np.argsort(own * np.int64(n + 2) + follow)
            open_, follow, own = open_[by], follow[by], own[by]
            start = np.append(True, own[1:] != own[:-1])
            edge = start | np.append(True, follow[1:] != follow[:-1])
            at = np.arange(len(open_))
            first = np.maximum.accumulate(np.where(edge, at, 0))
            group = np.maximum.accumulate(np.where(start, at, 0))
            rank[open_] = own + first - group
            alone = edge & np.append(edge[1:], True)
            # what reached its end is equal to its like for good
            open_ = open_[~alone & (to_end[open_] >= h)]
            h *= 2
        self.order = np.argsort(rank * np.int64(n) + np.arange(n))  # equal suffixes by place
        self.prefix = key[self.order]
        before = symbols[self.order - 1]
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = symbols[:-1] == 0
        before[starts[self.order]] = 0
        self.symbols = before
        self.back = np.empty(n, np.int64)
        self.back[np.argsort(before, kind="stable")] = np.arange(n)

    @staticmethod
    def _ranks(order, key, at, n):
        edge = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(edge, at, 0))
        return rank, order[~(edge & np.append(edge[1:], True))]


def merge_transforms(parts: list[Transform], wanted: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement.

    The interleave lists the parts' rows, each part's in its own order.  It
    begins in the order of the first symbols that the transforms keep as one
    number.  A round steps every row back by two symbols and buckets stably by
    them, which orders the interleave by two symbols more.  ``wanted`` are the
    rows, over the parts end to end, that have those first symbols and can step
    back by the rest of ``rounds`` (an even number); a row alone in its block
    stays alone in all longer ones, so it leaves the interleave.  Returned are
    the rows left and their blocks: rows of one block share their first
    ``rounds`` symbols."""
    offset = np.cumsum([0] + [len(p.symbols) for p in parts])
    kind = np.int32 if offset[-1] < 1 << 31 else np.int64
    bwt = np.concatenate([p.symbols for p in parts])
    back = np.concatenate([(p.back + o).astype(kind) for p, o in zip(parts, offset)])
    two = (bwt[back].astype(f"u{2 * bwt.itemsize}") << (8 * bwt.itemsize)) | bwt  # the farther symbol orders first
    back = back[back]
    rows = np.flatnonzero(wanted).astype(kind)
    prefix = np.concatenate([p.prefix for p in parts])[rows]
    move = np.argsort(prefix, kind="stable")
    rows, block = _blocks(prefix[move], np.zeros(len(rows), np.int32), rows[move])
    for _ in range((rounds - 8 // bwt.itemsize) // 2):
        symbol = two[rows]
        move = np.argsort(symbol, kind="stable")
        rows, block = _blocks(symbol[move], block[move], back[rows[move]])
    return rows, block


def _blocks(symbol: np.ndarray, came: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, parted where symbols or former blocks differ; rows alone
    in their block left out."""
    edge = np.empty(len(rows) + 1, bool)
    edge[:1] = edge[-1:] = True
    edge[1:-1] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])
    block = np.cumsum(edge[:-1], dtype=np.int32)
    alone = edge[:-1] & edge[1:]
    return (rows[~alone], block[~alone]) if alone.any() else (rows, block)


def distinct_strings(strings: list[bytes], sizes: list[np.ndarray], least: list[np.ndarray]):
    """The shards' strings, each once: (strings, least documents) and, per
    shard, the place of each of its own among them."""
    place: dict[bytes, int] = {}
    owner = []
    for blob, size in zip(strings, sizes):
        end = np.cumsum(size.astype(np.int64))
        owner.append(np.array([place.setdefault(blob[a:z], len(place)) for a, z in zip((end - size).tolist(), end.tolist())], np.int64))
    low = np.full(len(place), np.iinfo(np.int64).max)
    for own, ids in zip(owner, least):  # a shard's strings are distinct
        low[own] = np.minimum(low[own], ids)
    return list(place), low, owner


def bucket_answers(strings: list[bytes], sizes: list[np.ndarray], least: list[np.ndarray]) -> list[np.ndarray]:
    """Per shard: for every window of its strings, in order, the smallest
    document in which the window occurs.

    What several shards have alike is one string of the first of them; small
    shards share a transform, so that their number follows the bytes."""
    every, low, owner = distinct_strings(strings, sizes, least)
    lengths = np.array([len(x) for x in every], np.int64)
    joined = np.frombuffer(b"".join(every), np.uint8)
    used = np.flatnonzero(np.bincount(joined, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16  # 0 ends a string
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    dense = code[joined]
    parts, docs, windows, after, ahead, at = [], [], [], [], [], 0
    chunk = (np.cumsum(lengths) - lengths) // TRANSFORM_BYTES
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    for size, ids in zip(np.split(lengths, cuts), np.split(low, cuts)):
        total = int(size.sum())
        symbols = np.zeros(total + len(size), kind)
        last = np.cumsum(size + 1) - 1
        body = np.ones(len(symbols), bool)
        body[last] = False
        symbols[body] = dense[at:at + total]
        at += total
        of = np.repeat(np.arange(len(size)), size + 1)
        to_end = last[of] - np.arange(len(symbols))
        parts.append(Transform(symbols, to_end))
        docs.append(ids[of])
        windows.append(to_end >= LENGTH)
        after.append(np.repeat(size, size + 1) - to_end)  # symbols before each place
        ahead.append(to_end)
    # by row, over the parts end to end: its position and suffix length
    place = np.concatenate([p.order + o for p, o in zip(parts, np.cumsum([0] + [len(p.order) for p in parts[:-1]]))])
    doc = np.concatenate(docs)
    held = 8 // dense.itemsize
    far = (np.concatenate(after) >= LENGTH - held) & (np.concatenate(ahead) >= held)
    rows, block = merge_transforms(parts, far[place], LENGTH)
    answer = doc.copy()  # a window that is alone has its own document
    if len(rows):
        where = place[rows]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        answer[where] = np.repeat(np.minimum.reduceat(doc[where], first), np.diff(np.append(first, len(rows))))
    answer = answer[np.concatenate(windows)]
    wide = lengths - LENGTH + 1
    first = np.cumsum(wide) - wide
    out = []
    for own in owner:
        n = wide[own]
        out.append(answer[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return out


# ---- the job ------------------------------------------------------------------------------


def _by(batches, columns: list[str], keys: int):
    """Rows, sorted by the first ``keys`` columns, as (key, rows)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def removed_spans(size: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows at ``starts`` (sorted)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    a = starts[np.append(0, cut + 1)]
    b = starts[np.append(cut, len(starts) - 1)] + LENGTH
    return list(zip(a.tolist(), b.tolist()))


def _finished(ids, texts, spans) -> dict:
    kept, found = [], []
    for t, s in zip(texts, spans):
        at, out = 0, []
        for a, b in s:
            out.append(t[at:a])
            at = b
        out.append(t[at:])
        kept.append(b"".join(out))
        found.append([{"start": a, "end": b} for a, b in s])
    return {"doc_id": list(ids), "n_bytes": [len(t) for t in texts], "spans": found, "kept": kept}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _output(ids, texts, spans, digest: bool) -> pa.Table:
    made = _finished(ids, texts, spans)
    kept = made["kept"]
    last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
    return pa.table({"doc_id": pa.array(made["doc_id"], pa.int64()), "n_bytes": pa.array(made["n_bytes"], pa.int64()),
                     "spans": pa.array(made["spans"], _SPANS), "kept": last})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                   shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per document row: doc_id, n_bytes, spans (removed byte ranges) and kept
    (the remaining bytes, or with ``digest`` their SHA-256 in hex)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = total_bytes(rows, "text")
    shards, buckets = max(1, math.ceil(size / shard_bytes)), max(16, math.ceil(size / bucket_bytes))
    least_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_shard = lambda df: df.repartition(max(least_parts, shards), "shard").groupBy("shard")
    by_bucket = lambda df, *keys: df.repartition(max(least_parts, buckets), "bucket").sortWithinPartitions("bucket", *keys)

    # copies: of equal texts the smallest id goes on
    prints = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("id", F.sha2("text", 256).alias("h"))
    leaders = prints.groupBy("h").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = materialize(prints.join(leaders, "h").where("id > lead").select("id", "h").distinct())
    few = copies.count() <= BROADCAST_IDS
    marked = rows.withColumn("h", F.sha2("text", 256)).join(F.broadcast(copies) if few else copies, ["id", "h"], "left_anti").drop("h")
    copied = rows.withColumn("h", F.sha2("text", 256)).join(F.broadcast(copies) if few else copies, ["id", "h"], "left_semi").select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.sha2(F.lit("").cast("binary"), 256) if digest else F.lit("").cast("binary")
    copied = copied.select("doc_id", "n_bytes", one.alias("spans"), nothing.alias("kept"))

    def pack(batches):
        """Texts of a slice by shard, compressed: what the shuffles carry."""
        for batch in text_slices(batches, "text", 16 << 20):
            shard = batch.column("shard").to_numpy()
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            out = []
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s).tolist()
                out.append((s, [ids[i] for i in own], [len(texts[i]) for i in own], _squeeze(b"".join(texts[i] for i in own))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.binary())],
                names=["shard", "ids", "sizes", "data"])

    packed = marked.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")).mapInArrow(
        pack, "shard int, ids array<long>, sizes array<long>, data binary")

    def load(table: pa.Table) -> tuple[list, list[bytes]]:
        """Ids and texts of a shard in an order that does not depend on the
        shuffle."""
        ids, texts = [], []
        for i, sizes, data in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "data"))):
            raw, at = _unsqueeze(data), 0
            for x, k in zip(i, sizes):
                ids.append(x)
                texts.append(raw[at:at + k])
                at += k
        order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] or 0, texts[j]))
        return [ids[j] for j in order], [texts[j] for j in order]

    def shard_of(ids, texts) -> ShardText:
        # a row without an id takes no part
        return ShardText([i for i in ids if i is not None], [t for i, t in zip(ids, texts) if i is not None])

    def ask(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out = list(_pack_anchors(shard_of(*load(table)), buckets))
        return pa.table({"shard": pa.array([shard] * len(out), pa.int32()), "bucket": pa.array([o[0] for o in out], pa.int32()),
                         "anchors": pa.array([o[1] for o in out], pa.binary())})

    def reply(batches):
        for (bucket,), group in _by(text_slices(batches, "anchors", 16 << 20), ["bucket", "shard", "anchors"], 1):
            bits = _shared_anchors([g[1] for g in group], hot_runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], pa.int32()), pa.array([bucket] * len(group), pa.int32()), pa.array(bits, pa.binary())],
                names=["shard", "bucket", "bits"])

    asked = by_shard(packed).applyInArrow(ask, "shard int, bucket int, anchors binary")
    shared = materialize(by_bucket(asked).mapInArrow(reply, "shard int, bucket int, bits binary"))

    out_kind = "kept string" if digest else "kept binary"
    kept_type = pa.string() if digest else pa.binary()
    plan_schema = ("shard int, bucket int, strings binary, sizes binary, least binary, texts binary, runs binary, "
                   f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, {out_kind}")
    plan_arrow = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("strings", pa.binary()), ("sizes", pa.binary()), ("least", pa.binary()),
                            ("texts", pa.binary()), ("runs", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", kept_type)])

    def plan(table: pa.Table, bits: pa.Table) -> pa.Table:
        """Untouched documents are done; of the others the strings to ask
        for (a row per bucket) and what is needed to finish them."""
        shard = table.column("shard")[0].as_py()
        ids, texts = load(table)
        own = shard_of(ids, texts)
        runs = repeated_runs(own, buckets, dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist())))
        strings, bucket, place = shard_strings(own, runs, buckets)
        touched = np.unique(runs.doc)
        with_id = [t for i, t in zip(ids, texts) if i is not None]
        rest = sorted(set(range(len(own.ids))) - set(touched.tolist()))
        done_ids = [int(own.ids[k]) for k in rest] + [None for i in ids if i is None]
        done_texts = [with_id[k] for k in rest] + [t for i, t in zip(ids, texts) if i is None]
        done = _output(done_ids, done_texts, [[]] * len(done_ids), digest)
        tables = [_fill(done.append_column("shard", pa.array([shard] * done.num_rows, pa.int32())), plan_arrow)]
        tables.append(_fill(pa.table({
            "shard": pa.array([shard] * len(strings), pa.int32()), "bucket": pa.array([s[0] for s in strings], pa.int32()),
            "strings": pa.array([_squeeze(s[1]) for s in strings], pa.binary()), "sizes": pa.array([s[2].tobytes() for s in strings], pa.binary()),
            "least": pa.array([s[3].tobytes() for s in strings], pa.binary())}), plan_arrow))
        if len(touched):
            doc = np.searchsorted(touched, runs.doc)
            at = runs.at - own.starts[runs.doc]
            runs_of = np.stack([doc, at, runs.length, bucket, place]).astype(np.int64)
            body = b"".join(with_id[k] for k in touched.tolist())
            heads = np.stack([own.ids[touched], own.sizes[touched]]).astype(np.int64)
            tables.append(_fill(pa.table({
                "shard": pa.array([shard], pa.int32()), "texts": pa.array([_squeeze(heads.tobytes() + body)], pa.binary()),
                "runs": pa.array([_squeeze(len(touched).to_bytes(8, "little") + runs_of.tobytes())], pa.binary())}), plan_arrow))
        return pa.concat_tables(tables)

    planned = materialize(by_shard(packed).cogroup(by_shard(shared)).applyInArrow(plan, plan_schema))

    def merge(batches):
        for (bucket,), group in _by(text_slices(batches, "strings", 16 << 20), ["bucket", "shard", "strings", "sizes", "least"], 1):
            found = bucket_answers([_unsqueeze(g[1]) for g in group], [np.frombuffer(g[2], np.uint16) for g in group],
                                   [np.frombuffer(g[3], np.int64) for g in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], pa.int32()), pa.array([bucket] * len(group), pa.int32()),
                 pa.array([_squeeze(f.tobytes()) for f in found], pa.binary()), pa.array([g[2] for g in group], pa.binary())],
                names=["shard", "bucket", "first", "sizes"])

    wanted = planned.where("strings is not null").select("bucket", "shard", "strings", "sizes", "least")
    answered = materialize(by_bucket(wanted, "shard").mapInArrow(
        merge, "shard int, bucket int, first binary, sizes binary"))

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _output([], [], [], digest)
        runs = _unsqueeze(table.column("runs")[0].as_py())
        n = int.from_bytes(runs[:8], "little")
        doc, at, windows, bucket, place = np.frombuffer(runs[8:], np.int64).reshape(5, -1)
        raw = _unsqueeze(table.column("texts")[0].as_py())
        ids, sizes = np.frombuffer(raw[:16 * n], np.int64).reshape(2, n)
        ends = np.cumsum(sizes) + 16 * n
        texts = [raw[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]
        # the answers end to end, and where each bucket's strings begin there
        flat, offsets, base = [], {}, 0
        for b, first, size in zip(*(found.column(c).to_pylist() for c in ("bucket", "first", "sizes"))):
            per = np.frombuffer(size, np.uint16).astype(np.int64) - LENGTH + 1
            offsets[b] = base + np.cumsum(per) - per
            flat.append(np.frombuffer(_unsqueeze(first), np.int64))
            base += int(per.sum())
        flat = np.concatenate(flat)
        begin = np.array([offsets[b][p] for b, p in zip(bucket.tolist(), place.tolist())], np.int64)
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        least = flat[np.repeat(begin, windows) + step]
        owner = np.repeat(doc, windows)
        hit = least < ids[owner]
        owner, where = owner[hit], (np.repeat(at, windows) + step)[hit]
        cuts = np.searchsorted(owner, np.arange(n + 1))
        spans = [removed_spans(int(sizes[k]), where[cuts[k]:cuts[k + 1]]) for k in range(n)]
        return _output(ids.tolist(), texts, spans, digest)

    schema = f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, {out_kind}"
    touched = planned.where("texts is not null").select("shard", "texts", "runs")
    finished = by_shard(touched).cogroup(by_shard(answered)).applyInArrow(finish, schema)
    untouched = planned.where("n_bytes is not null").select("doc_id", "n_bytes", "spans", "kept")
    return untouched.unionByName(finished).unionByName(copied)


def _fill(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The table with the schema's columns; those it lacks are null."""
    n = table.num_rows
    return pa.table([table.column(f.name) if f.name in table.column_names else pa.nulls(n, f.type) for f in schema], schema=schema)


def repeat_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = remove_repeats(docs, digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.col("kept").alias("kept_sha256"))
