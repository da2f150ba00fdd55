"""Operator 9: language identification with bit-sliced Bloom filters.

Training: n-grams of four bytes of the normalised text are counted per
language over a bounded, hash-chosen sample of the distinct labelled texts, cut
into pieces (about ``SAMPLE_BYTES`` of text per language, of as many texts as
there are).  An n-gram belongs to a language if it
makes up at least ``MIN_SHARE`` of that language's n-grams, so a language has
at most ``1 / MIN_SHARE`` of them and the filter's size is bounded by its
parameters.  All languages share one Bloom filter of machine words: the word at
a hash position has a bit per language (bit slices), so looking up an n-gram --
the AND of ``HASHES`` words -- gives the set of all languages containing it.

Prediction: per text the bits of each language are counted over all n-grams of
the whole text, the counts are corrected for the language's false-positive rate
(its share of set bits to the power ``HASHES``), and the largest wins, ties by
name.  ``score`` is the winner's part of the sum of corrected counts.

Defined results: null text, or text without a letter, is ``und`` with score 0;
where no n-gram of a text is known, the most frequent learned language with
score 0; with nothing to learn from, everything is ``und``.  Null lang rows are
not learned from.  Repeated rows are each reported; extra columns are ignored by
:func:`identify` and kept by :func:`keep_identified`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import mix, text_slices

SAMPLE_BYTES = 4 << 20
PIECE = 2048
MIN_SHARE = 2e-5
HASHES = 3
SLOTS = 1 << 18
UNKNOWN = "und"

_TO_SPACE = bytes(b if (97 <= b <= 122 or b >= 128) else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all four-byte n-grams of the texts, and where each text's begin.

    Letters and all non-ASCII bytes stay, A-Z in lower case, anything else is
    one space; words are framed by spaces."""
    parts, starts, at = [], [], 0
    for t in texts:
        p = b" ".join((t or "").lower().encode().translate(_TO_SPACE).split())
        p = b" " + p + b" " if p else b""
        starts.append(at)
        p += b"\x00\x00\x00\x00"
        parts.append(p)
        at += len(p)
    data = np.frombuffer(b"".join(parts) + b"\x00" * 4, dtype=np.uint8)
    codes = np.ndarray((at,), dtype="<u4", buffer=data, strides=(1,))
    return codes, np.asarray(starts, dtype=np.int64)


def _inside(codes: np.ndarray) -> np.ndarray:
    """N-grams that do not reach over the end of their text."""
    return (codes >> np.uint32(24)) > 0


def _positions(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((low + np.uint64(k) * (high | np.uint64(1))) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    """The filter: ``words[slot, 64 languages]`` as bit masks."""

    def __init__(self, members: dict[str, np.ndarray], prior: dict[str, int], slots: int = SLOTS):
        self.names = sorted(members)
        self.common = max(self.names, key=lambda n: (prior.get(n, 0), [-ord(c) for c in n])) if self.names else UNKNOWN
        while slots < 8 * max((len(m) for m in members.values()), default=0):
            slots *= 2
        planes = max(1, -(-len(self.names) // 64))
        self.words = np.zeros((planes, slots), dtype=np.uint64)
        for k, name in enumerate(self.names):
            bit = np.uint64(1 << (k % 64))
            for pos in _positions(members[name], slots):
                self.words[k // 64, pos] |= bit
        self.false_rate = np.array([
            float(((self.words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** HASHES for k in range(len(self.names))])

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts [text, language] and numbers of n-grams."""
        codes, starts = grams(texts)
        inside = _inside(codes)
        n = np.add.reduceat(inside, starts, dtype=np.int64).astype(np.float64) if len(codes) else np.zeros(len(starts))
        pos = _positions(codes, self.words.shape[1])
        out = np.zeros((len(starts), len(self.names)))
        for plane, words in enumerate(self.words):
            found = words[pos[0]]
            for p in pos[1:]:
                found &= words[p]
            found[~inside] = 0
            for k in range(plane * 64, min(len(self.names), plane * 64 + 64)):
                hit = (found >> np.uint64(k % 64)) & np.uint64(1)
                out[:, k] = np.add.reduceat(hit, starts, dtype=np.int64)
        rate = self.false_rate[None, :]
        return np.maximum(0.0, (out - rate * n[:, None]) / np.maximum(1e-9, 1.0 - rate)), n

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and the winner's share of all n-grams, per text."""
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        counts, n = self.counts(texts)
        best = counts.argmax(axis=1)
        top, total = counts[np.arange(len(best)), best], counts.sum(axis=1)
        names, scores, covers = [], [], []
        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):
                names.append(UNKNOWN)
                scores.append(0.0)
                covers.append(0.0)
            elif top[i] <= 0:
                names.append(self.common)
                scores.append(0.0)
                covers.append(0.0)
            else:
                names.append(self.names[best[i]])
                scores.append(float(min(1.0, top[i] / total[i])))
                covers.append(float(min(1.0, top[i] / max(1.0, n[i]))))
        return names, scores, covers


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES,
          min_share: float = MIN_SHARE) -> LanguageFilter:
    """Build the filter from labelled rows.

    One aggregate finds the bytes of each language's distinct texts; pieces of
    at most ``PIECE`` code points are then chosen by a hash of their text and
    number so that a language's sample holds about ``sample_bytes``.  A piece
    of a copied text counts once."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("key", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "key").agg(F.max(F.octet_length("text")).cast("long").alias("b"), F.count("*").alias("n"))
    sizes = {r["lang"]: (int(r["b"]), int(r["n"])) for r in distinct.groupBy("lang").agg(
        F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    if not sizes:
        return LanguageFilter({}, {})
    # keep a piece if its hash, in [0, 1), is below the language's share
    share = F.create_map(*[x for k, (b, _) in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_bytes / max(1, b))))])
    here = share[F.col("lang")]
    chosen = F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")),
                      lambda k: F.pmod(F.xxhash64("key", k), F.lit(1 << 30)) / F.lit(float(1 << 30)) < here)
    cut = F.transform(chosen, lambda k: F.struct(k.alias("piece"), F.substring("text", k * PIECE + 1, F.lit(PIECE)).alias("text")))
    sample = rows.where(F.length("text") > 0).select("lang", "key", F.explode(cut).alias("part")).select("lang", "key", "part.*").distinct().select("lang", "text")

    def count(batches):
        for batch in text_slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                codes, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                values, n = np.unique(codes[_inside(codes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: int(r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter({k: np.zeros(0, np.uint32) for k in sizes}, {k: n for k, (_, n) in sizes.items()})
    least = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(max(1.0, min_share * n)))])
    # at most 1 / min_share n-grams of each language can pass
    kept = counted.where(F.col("n") >= least[F.col("lang")]).select("lang", "code").toArrow()
    langs, codes = kept.column("lang").to_numpy(zero_copy_only=False), kept.column("code").to_numpy().astype(np.uint32)
    members = {k: codes[langs == k] for k in sizes}
    return LanguageFilter(members, {k: n for k, (_, n) in sizes.items()})


def held_out(id_col: str = "doc_id", mod: int = 4) -> Column:
    """crc32 of the id's text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod) == F.lit(2), F.lit(False))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, lang_pred, score, cover (winner's share of
    all n-grams)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_slices(batches, "text"):
            names, scores, covers = shared.value.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(covers, pa.float64())],
                names=["doc_id", "lang_pred", "score", "cover"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cover double")


def language_digest(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_cover: float = 0.15) -> DataFrame:
    """The documents whose language is told: their best language, after the
    correction, knows at least ``min_cover`` of their n-grams.  Rejected go."""
    model = train(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_slices(batches, text_col):
            names, _, covers = shared.value.decide(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and c >= min_cover for n, c in zip(names, covers)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
