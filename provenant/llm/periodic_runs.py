"""Operator 12: runs of repeating words, by scale-tiled distribution.

A run is a maximal stretch of words with smallest period q, at least 4q (and
6) words long.  Periods are taken by octave: 2^k <= q < 2^(k+1), with
boundaries every s = 2^(k+1) words.  A run of the octave is at least 2s long.
For its first boundary c, and all up to 2q + 1 words before its end, the words
from c repeat for q + 1 words at distance q; and from c - s to c + 3s such a
boundary sees a stretch that overlaps the next boundary's by at least q words.

1. Scan: each document's words get numbers and, octave by octave, names (64-bit
   hashes of 2^k words, each made of two of the octave before).  Boundaries
   where two names agree at a distance inside the octave are marked.  Marked
   boundaries of ``TILE`` words make a tile: its words, from s before the first
   mark to 3s after the last.  Unmarked parts make no tile.
2. Tiles are dealt to tasks by hash, so a long document is solved in many.  A
   tile is solved alone: the Z-functions of the words right and left of each
   boundary give every period's stretch around it, exactly; a period that is a
   multiple of a shorter one is left out by the same Z-function.
3. Stretches are shuffled by document and period and stitched: those that
   overlap by a period or more are one.  Too short ones go.

Only names are hashes, used to choose tiles; two names that differ are never
equal, so no run is lost, and a false mark costs work but gives no run.  (A
multiple of a shorter period is also skipped by names; that a false match
hides a run has a chance of about 1e-19 for each comparison.)

Defined results: null, empty or word-less text has no words and no runs;
repeated rows are each reported; a null doc_id is reported like any other;
ties for the longest run go to the smallest start, then period; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import mix, sha, text_slices
from provenant.session import materialize

#: boundaries of this many words (or of 8 steps, if more) make one tile
TILE = 4096
MIN_WORDS, MIN_PERIODS = 6, 4
OUT_BYTES = 1 << 20
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


@lru_cache(maxsize=4)
def least_factors(n: int) -> np.ndarray:
    """Smallest prime factor of each number below n (of 0 and 1: 1)."""
    out = np.arange(n)
    out[:2] = 1
    for r in range(2, int(n ** 0.5) + 1):
        if out[r] == r:
            part = out[r * r::r]
            part[part == np.arange(r * r, n, r)] = r
    return out


def marked_boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) that runs of the octave's periods may cross."""
    n, k = len(ids), 0
    names = mix(ids.astype(np.uint64) + np.uint64(1))
    while max(MIN_WORDS, MIN_PERIODS << k) <= n:
        h, s = 1 << k, 2 << k
        grid = np.zeros(-(-len(names) // s) * s, np.uint64)
        grid[:len(names)] = names
        grid = grid.reshape(-1, s)
        row, column = np.nonzero(grid[:, h:] == grid[:, :1])
        if len(row):
            at, period = row * s, column + h

            def agree(c, d, p):
                """The p + 1 words from c equal those d further on."""
                return (names[c] == names[c + d]) & (names[c + p + 1 - h] == names[c + d + p + 1 - h])

            inside = at + 2 * period + 1 <= n
            at, period = at[inside], period[inside]
            same = agree(at, period, period)
            at, period = at[same], period[same]
            whole = np.ones(len(at), bool)
            rest = period.copy()
            factors = least_factors(s) if len(at) else None
            while len(at) and rest.max() > 1:
                r = factors[rest]
                d = np.where(rest > 1, period // r, period)
                whole &= (rest <= 1) | ~agree(at, d, period)
                rest = rest // r
            if whole.any():
                yield k, np.unique(at[whole])
        names = mix(names[:-h] * np.uint64(0x9E3779B97F4A7C15) + names[h:])
        k += 1


def z_function(x: list[int]) -> list[int]:
    """Length of the common prefix of x and each of its suffixes."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and x[m] == x[i + m]:
            m += 1
        if i + m > right:
            left, right = i, i + m
        z[i] = m
    return z


def solve_tile(words: list[int], octave: int, marks: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the stretches around marked boundaries, as
    far as the tile shows them; marks and results count from the tile's start."""
    h, s = 1 << octave, 2 << octave
    factors = least_factors(s)
    found: dict[int, list[list[int]]] = {}
    for c in marks:
        ahead = z_function(words[c:c + 3 * s])
        periods = []
        for p in range(h, min(s, len(ahead))):
            if ahead[p] <= p:
                continue
            rest, whole = p, True
            while rest > 1 and whole:
                d = p // factors[rest]
                whole = ahead[d] < p - d
                rest //= factors[rest]
            if whole:
                periods.append(p)
        if not periods:
            continue
        left, end = words[max(0, c - s):c][::-1], min(len(words), c + s)
        behind = z_function(left + [-1] + words[max(0, c - s):end][::-1])
        for p in periods:
            back = behind[len(left) + 1 + end - c - p] if left else 0
            start, stop = c - back, c + p + ahead[p]
            own = found.setdefault(p, [])
            if own and start <= own[-1][1] - p:
                own[-1][1] = max(own[-1][1], stop)
            else:
                own.append([start, stop])
    return [(p, a, b) for p, own in found.items() for a, b in own]


SCAN = "key binary, doc_id {kind}, n long, text string, plain string, octave int, tile long, at long, marks binary, words binary"


def _scan(rows: DataFrame, keep_text: bool) -> DataFrame:
    """A row for each document (tile null) and for each of its tiles.

    ``key`` names a document's id and text.  ``plain`` is the hash of the words
    joined by spaces; ``text``, these words, is there where tiles are (or
    always, with ``keep_text``)."""

    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, "text"):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            split = [t.encode().split() if t else [] for t in texts]
            coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            out, size, end = [], 0, 0
            for row, (doc_id, words) in enumerate(zip(ids.to_pylist(), split)):
                own, end = coded[end:end + len(words)], end + len(words)
                joined = b" ".join(words)
                key = xxhash.xxh3_128_digest(b"\0" + joined if doc_id is None else f"{doc_id} ".encode() + joined)
                tiles = []
                for octave, marks in marked_boundaries(own):
                    s = 2 << octave
                    number = marks // max(TILE, 8 * s)
                    for t in np.unique(number).tolist():
                        inside = marks[number == t]
                        a, b = max(0, int(inside[0]) - s), min(len(own), int(inside[-1]) + 3 * s)
                        tiles.append((key, None, None, None, None, octave, t, a, (inside - a).astype(np.int32).tobytes(),
                                      own[a:b].astype(np.int32).tobytes()))
                        size += 4 * (b - a)
                text = joined.decode() if tiles or keep_text else None
                size += len(joined) if text is not None else 0
                out.append((key, ids[row].as_py(), len(words), text, sha(joined), None, None, None, None, None))
                out += tiles
                if size > OUT_BYTES:
                    yield _batch(out, ids.type)
                    out, size = [], 0
            if out:
                yield _batch(out, ids.type)

    def _batch(out, id_type):
        types = [pa.binary(), id_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["key", "doc_id", "n", "text", "plain", "octave", "tile", "at", "marks", "words"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, SCAN.format(kind=kind))


def _solve(tiles: DataFrame) -> DataFrame:
    """key, period, start, stop of the stretches of all tiles."""

    def run(batches):
        for batch in batches:
            keys, out = batch.column("key").to_pylist(), []
            parts = zip(keys, *(batch.column(c).to_pylist() for c in ("octave", "at", "marks", "words")))
            for key, octave, at, marks, words in parts:
                for p, a, b in solve_tile(np.frombuffer(words, np.int32).tolist(), octave, np.frombuffer(marks, np.int32).tolist()):
                    out.append((key, p, at + a, at + b))
            if out:
                key, p, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in (p, a, b))],
                                                 names=["key", "period", "start", "stop"])

    return tiles.mapInArrow(run, "key binary, period long, start long, stop long")


def stitch(stretches: DataFrame) -> DataFrame:
    """(key, period, start, length) of whole runs, of overlapping stretches."""
    order = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before - F.col("period"))).cast("int")
    numbered = stretches.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    whole = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period"))).drop("run")


def _collapse(rows: DataFrame) -> DataFrame:
    """Adds ``collapsed``: the words that no run repeats, joined by spaces."""

    def run(batches):
        for batch in text_slices(batches, "text"):
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.split(" ") if text else []
                keep = np.ones(len(words), bool)
                for r in runs or []:
                    keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
                out.append(" ".join([words[i] for i in np.flatnonzero(keep).tolist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "collapsed"])

    names = ["doc_id", "n", "runs"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*names, "text").mapInArrow(run, f"doc_id {kind}, n long, runs {RUNS}, collapsed string")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n, runs (start, period, length; in order), collapsed,
    collapsed_sha256.  Without ``keep_text`` the ``collapsed`` text is null
    where there is no run, and such texts are never written or shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialize(_scan(rows, keep_text))
    tiles = scanned.where("tile is not null").select("key", "octave", "tile", "at", "marks", "words")
    stretches = _solve(tiles.repartition("key", "octave", "tile"))
    runs = stitch(stretches).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).cast(RUNS).alias("runs"))
    whole = scanned.where("tile is null and text is not null").select("key", "doc_id", "n", "text").join(runs, "key", "left")
    changed = _collapse(whole).withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    plain = scanned.where("tile is null and text is null").select(
        "doc_id", "n", F.lit(None).cast(RUNS).alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("plain").alias("collapsed_sha256"))
    return changed.unionByName(plain).withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, where every tenth one (by crc32 of its id) ends in
    repetitions of some of its own words: a known answer for ``find_runs``."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # the words as a one-element array: split once, not once for each use
    changed = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), tail), F.lit(0))
    return docs.withColumn(text_col, F.when(h % 10 == 0, F.coalesce(changed, F.col(text_col))).otherwise(F.col(text_col)))


def run_digest(docs: DataFrame) -> DataFrame:
    """Runs of every document: number, longest, and hashes of all of them
    and of the collapsed text."""
    found = find_runs(docs, keep_text=False)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.withColumn("top", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
