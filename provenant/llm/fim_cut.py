"""Operator 11: fill-in-middle documents, cut through a learned rank index.

A text's units are its lines, and a cut is a number of units, so each cut asks
"at which code point does unit r end?".  The boundaries of all texts of a
slice are numbered in order (their rank), and ``RankIndex`` learns the map
from rank to offset: straight segments whose error is at most ``EPSILON`` code
points, and one small residual for each boundary.  A cut's offset is predicted
by its segment and then corrected by the stored residual, which is exact.

Each document is prepared alone: no shuffle, no state between rows, memory
bounded by a slice of texts (or one longer text).

Defined results: null text counts as empty; an empty text, and one that holds
a marker already, stays plain; the pieces hold no marker, so ``restored``
finds each marker again in exactly one place; a null doc_id draws its cuts
like an empty id; repeated rows are each transformed, alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: largest error of a segment in code points: residuals fit into one byte
EPSILON = 120


class RankIndex:
    """Rank -> offset of nondecreasing offsets, by error-bounded segments."""

    def __init__(self, offsets: np.ndarray, epsilon: int = EPSILON):
        first, start, slope = [], [], []
        values = offsets.tolist()
        n, i = len(values), 0
        while i < n:
            y, low, high, j = values[i], 0.0, float("inf"), i + 1
            # the cone of slopes that pass all points so far within epsilon
            while j < n:
                rise, run = values[j] - y, j - i
                new_low, new_high = max(low, (rise - epsilon) / run), min(high, (rise + epsilon) / run)
                if new_low > new_high:
                    break
                low, high, j = new_low, new_high, j + 1
            first.append(i)
            start.append(y)
            slope.append((low + high) / 2 if j > i + 1 else 0.0)
            i = j
        self.first = np.asarray(first, np.int64)
        self.start = np.asarray(start, np.int64)
        self.slope = np.asarray(slope, np.float64)
        off = np.asarray(offsets, np.int64) - self.predict(np.arange(n))
        # rounding may add one to the bound
        self.residuals = off.astype(np.int8 if epsilon < 127 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.start[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries of these ranks."""
        return self.predict(ranks) + self.residuals[ranks]


def unit_boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: offsets of all unit boundaries (each text's
    start included), the rank of each text's first one, and its units."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    after = np.flatnonzero(points == 10) + 1
    owner = np.concatenate((np.arange(len(texts)), np.searchsorted(ends, after), np.arange(len(texts))))
    at = np.concatenate((ends - lengths, after, ends))
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
    owner, at = owner[new], at[new]
    counts = np.bincount(owner, minlength=len(texts))
    return at, np.cumsum(counts) - counts, counts - 1


def draws(doc_id, seed: str) -> list[int]:
    """Four 32-bit numbers that depend on the id only."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[8 * i:8 * i + 8], 16) for i in range(4)]


def transform(ids: list, texts: list[str | None], seed: str, fim_percent: int, spm_percent: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    texts = [t or "" for t in texts]
    boundaries, base, units = unit_boundaries(texts)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (units + 1)[:, None], axis=1)
    index = RankIndex(boundaries)
    ends = index.offsets((base[:, None] + cuts).ravel()).reshape(-1, 2) - boundaries[base][:, None]
    out = []
    for text, n, (a, b), (_, _, h3, h4) in zip(texts, units.tolist(), ends.tolist(), h.tolist()):
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= fim_percent:
            out.append((n, "plain", None, None, text))
            continue
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            out.append((n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle))
        else:
            out.append((n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle))
    return out


def fill_in_middle(docs: DataFrame, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in text_slices(batches, "text"):
            ids = batch.column("doc_id")
            n, form, prefix, middle, output = zip(*transform(ids.to_pylist(), batch.column("text").to_pylist(), seed, fim_percent, spm_percent))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a prepared document was made from."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    middle = F.substring_index(body, MIDDLE, -1)
    head = F.substring_index(body, MIDDLE, 1)
    psm = F.concat(F.substring_index(head, SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(head, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digest(docs: DataFrame) -> DataFrame:
    """Prepared documents by the hashes of their output and restored text."""
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
