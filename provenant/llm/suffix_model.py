"""Operator 7: scoring texts with a probabilistic suffix tree over tokens.

A text is its lower-cased words and an end token.  A token is predicted from
the up to ``DEPTH`` tokens before it; the end token stands before the first:

* without context, one of the ``V`` training tokens has ``(1 - u) * c / N`` and
  unknown, one symbol as in the base score, ``u = (once + 1) / (N + 2)``, the
  share of tokens that training saw once;
* a context is retained as a state if its next-token distribution diverges
  from that of its longest retained suffix: predicting each training
  occurrence from the context's *other* occurrences must gain likelihood over
  the suffix, ``sum of n * ln((n - 1) / p) over tokens seen n > 1 times
  + n1 * ln(kinds) > total * ln(total - 1 + kinds)`` (``p`` in the suffix, ``n1``
  tokens seen once).  So contexts grow only where the corpus supports them;
* a state's distribution is smoothed with that of its longest retained suffix
  (Witten-Bell), ``(n + kinds * p) / (total + kinds)``;
* a token is scored in the longest suffix of its past that is a state.

In every context the probabilities of the ``V + 1`` symbols sum to one, and the
weight of a state depends on its own counts, not on the size of the corpus.

Texts are cut into shards of about ``SHARD_BYTES`` (a longer text is one of its
own), stored once as token numbers.  Depth by depth a shard sends each distinct
context and gram (context and token) once, with its training count, packed by
bucket; a bucket sums all shards, tests its contexts and answers every shard
with the values of exactly its entries.  Grams of one context share a bucket,
but a context seen ``HOT_COUNT`` times or more is dealt by gram over all
buckets, and its sums are added up by a grouping.  A context seen once is never
a state, so longer contexts are only sent where the shorter one repeats.  No
model is broadcast; tasks hold one shard or one bucket, and the driver gets
the numbers N, V and ``once``.  Words and contexts are named by 64-bit hashes,
a context's grams by 48 bits.

Defined results: null text is empty (one end token); repeated rows are each
scored and, unless held out, each learned from; a null id is not held out;
with no training rows the counts are 0 and every token is unknown; no rows give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import mix, text_slices, total_bytes
from provenant.session import ensure_checkpoint_dir, materialize

DEPTH = 2
SHARD_BYTES = 16 << 20
HOT_COUNT = 1 << 18
HELD_OUT = (7, 2)

END = b"\n"
_END_NAME = np.uint64(xxhash.xxh3_64_intdigest(END))
_LOG_STEPS = 8  # ln p is sent to the divergence test in eighths
_WORDS, _PARTIAL, _ASK = 0, -1, -2  # kinds of rows; grams have their depth
_ASKED = "shard long, kind int, bucket int, contexts binary, runs binary, keys binary, counts binary, logs binary"
_ANSWER = "shard long, kind int, bucket int, values binary, states binary, context long, n long, kinds long, ones long, gain double"


def _pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed: small numbers take little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def is_held_out(key) -> bool:
    mod, rest = HELD_OUT
    return key is not None and zlib.crc32(str(key).encode()) % mod == rest


def token_shards(rows: DataFrame, shard_bytes: int, parts: int) -> DataFrame:
    """One row per shard: ids, and as arrays in binary form the hashes of its
    words, its tokens as places among them, tokens per text, texts held out."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        words = [(t.encode().lower().split() if t else []) + [END] for t in texts]
        coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        held = np.fromiter(map(is_held_out, ids.to_pylist()), bool, len(ids))
        blobs = {"names": names, "tokens": coded.indices.to_numpy().astype(np.int32), "sizes": sizes, "held": held}
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids.to_pylist()], pa.list_(ids.type))} | {
            n: pa.array([_pack(b)], pa.binary()) for n, b in blobs.items()})

    def run(batches):
        ids, texts, size = [], [], 0
        for piece in text_slices(batches, "text", shard_bytes):
            more = piece.column("text").nbytes
            if texts and size + more > shard_bytes:
                yield pack(pa.concat_arrays(ids), texts)
                ids, texts, size = [], [], 0
            ids.append(piece.column("id"))
            texts += piece.column("text").to_pylist()
            size += more
        if texts:
            yield pack(pa.concat_arrays(ids), texts)

    packed = rows.mapInArrow(run, f"ids array<{kind}>, names binary, tokens binary, sizes binary, held binary")
    numbered = packed.withColumn("shard", F.monotonically_increasing_id())
    # dealt once and kept dealt, so that the levels only move their answers: a
    # checkpoint knows its partitioning if the plan that made it was not adaptive
    conf, adaptive = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        return numbered.repartition(parts, "shard").checkpoint()
    finally:
        conf.set(adaptive, before)


def _tails(keys: np.ndarray) -> bytes:
    """The low six bytes of each key, which name a gram within its context."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_tails(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


class Entries:
    """The distinct keys of a shard at one depth, each under its context, in
    the order in which they are sent: by bucket, then context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, buckets: int, contexts: np.ndarray | None = None,
                 hot: np.ndarray | None = None, logs: np.ndarray | None = None):
        self.contexts = keys if contexts is None else contexts
        spread = keys if hot is None else np.where(hot, keys, self.contexts)
        bucket = mix(spread ^ (spread >> np.uint64(7))) % np.uint64(buckets)
        self.given = keys
        # one stable sort; contexts with equal high bits may mix, in more runs
        self.order = np.argsort((bucket << np.uint64(40)) | (self.contexts >> np.uint64(24)), kind="stable")
        self.keys, self.counts, self.bucket = keys[self.order], counts[self.order].astype(np.uint32), bucket[self.order]
        self.contexts = self.contexts[self.order]
        self.logs = None if logs is None else np.minimum(np.rint(logs[self.order] * -_LOG_STEPS), 255).astype(np.uint8)
        self.is_hot = np.zeros(len(keys), bool) if hot is None else hot[self.order]
        new = np.ones(len(keys), bool)
        new[1:] = (self.contexts[1:] != self.contexts[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.run_starts = np.flatnonzero(new)  # a context's keys within a bucket

    def packed(self, shard: int, kind: int):
        """Rows of ``_ASKED``: one per bucket (the runs of hot contexts are
        negative), and one per hot context."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(self.keys))):
            if a == b:
                continue
            runs, contexts = None, None
            if kind != _WORDS:
                i, j = np.searchsorted(self.run_starts, (a, b))
                at = self.run_starts[i:j]
                runs = _pack((np.diff(np.append(at, b)) * np.where(self.is_hot[at], -1, 1)).astype(np.int32))
                contexts = self.contexts[at].tobytes()
            yield (shard, kind, int(self.bucket[a]), contexts, runs, self.keys[a:b].tobytes() if kind == _WORDS else _tails(self.keys[a:b]), _pack(self.counts[a:b]),
                   None if self.logs is None else _pack(self.logs[a:b]))
        for context in np.unique(self.contexts[self.is_hot]):
            yield shard, _ASK, int(mix(np.array([context]))[0] % np.uint64(max(1, len(cuts) + 1))), context.tobytes(), None, None, None, None

    def unsorted(self, values: np.ndarray) -> np.ndarray:
        """Values in sending order, put into the order of the given keys."""
        if len(values) != len(self.keys):
            raise ValueError("answers do not fit the shard")
        out = np.empty_like(values)
        out[self.order] = values
        return out


class Shard:
    """A shard's tokens and, level by level, their probabilities."""

    def __init__(self, row: dict, buckets: int, hot_count: int):
        self.buckets, self.hot_count = buckets, hot_count
        self.names = _unpack(row["names"], np.uint64)
        self.word_at = _unpack(row["tokens"], np.int32)
        self.sizes = _unpack(row["sizes"], np.int64)
        self.held = _unpack(row["held"], bool)
        self.learned = np.repeat(~self.held, self.sizes)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.entries = Entries(self.names, np.bincount(self.word_at[self.learned], minlength=len(self.names)), buckets)
        self.depth = 0

    def take_words(self, values: np.ndarray, n_train: int, v_train: int, once: int) -> None:
        c = self.entries.unsorted(values).astype(np.int64)
        at = c[self.word_at]
        unknown = (once + 1) / (n_train + 2)
        self.known = at > 0
        self.base = np.log10((at + 1) / (n_train + v_train + 1))
        self.p = np.where(self.known, (1 - unknown) * at / max(1, n_train), unknown)
        self.key, self.n = self.names[self.word_at], at
        self.end_n = int(c[self.names == _END_NAME][0])

    def next_level(self) -> None:
        """Contexts one token longer, each the gram that ends a token before."""
        self.depth += 1
        context, context_n = np.roll(self.key, 1), np.roll(self.n, 1)
        context[self.starts], context_n[self.starts] = (_END_NAME, self.end_n) if self.depth == 1 else (0, 0)
        self.live = np.flatnonzero(context_n >= 2)
        context, context_n = context[self.live], context_n[self.live]
        grams = mix(context * np.uint64(0x9E3779B97F4A7C15) + self.names[self.word_at[self.live]] + np.uint64(self.depth))
        self.gram_at, keys = pd.factorize(grams)
        first = np.empty(len(keys), np.int64)
        first[self.gram_at[::-1]] = np.arange(len(grams) - 1, -1, -1)
        counts = np.bincount(self.gram_at[self.learned[self.live]], minlength=len(keys))
        self.entries = Entries(keys, counts, self.buckets, context[first], context_n[first] >= self.hot_count,
                               np.log(self.p[self.live][first]))

    def take_grams(self, n: np.ndarray, states: np.ndarray, hot: np.ndarray, hot_states: np.ndarray) -> None:
        """``states``: (total, kinds) of each run of a context sent, 0 if it is
        not a state or hot; ``hot`` and theirs: the hot contexts retained."""
        e = self.entries
        if len(states) != len(e.run_starts):
            raise ValueError("answers do not fit the shard")
        of_run = states.copy()
        if len(hot):
            by = np.argsort(hot)
            at = by[np.minimum(np.searchsorted(hot, e.contexts[e.run_starts], sorter=by), len(hot) - 1)]
            found = hot[at] == e.contexts[e.run_starts]
            of_run[found] = hot_states[at[found]]
        runs = np.diff(np.append(e.run_starts, len(e.keys)))
        total, kinds = (e.unsorted(np.repeat(of_run[:, k], runs))[self.gram_at] for k in (0, 1))
        n = e.unsorted(n)[self.gram_at].astype(np.int64)
        p = self.p[self.live]
        self.p = self.p.copy()
        self.p[self.live] = np.where(total > 0, (n + kinds * p) / np.maximum(1, total + kinds), p)
        key, count = np.zeros(len(self.p), np.uint64), np.zeros(len(self.p), np.int64)
        key[self.live], count[self.live] = e.given[self.gram_at], n
        self.key, self.n = key, count


def _retained(total, kinds, ones, gain) -> np.ndarray:
    """The divergence test; ``gain`` sums ``n * ln((n - 1) / p)`` over n > 1."""
    rest = total * np.log(np.maximum(total - 1 + kinds, 1)) - ones * np.log(np.maximum(kinds, 1))
    return (total > 1) & (gain > rest)


def _sums(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray, logs: np.ndarray):
    """Place of each row's gram, counts of the distinct grams; the distinct
    contexts and their total, kinds, ones, gain."""
    named, of_row = np.unique(contexts, return_inverse=True)
    order = np.lexsort((keys, of_row))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (of_row[order][1:] != of_row[order][:-1])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    n = np.bincount(which, weights=counts, minlength=len(first)).astype(np.int64)
    own, log = of_row[first], logs[first]

    def add(values: np.ndarray) -> np.ndarray:
        return np.bincount(own, weights=values, minlength=len(named))

    gain = add(np.where(n > 1, n * (np.log(np.maximum(n - 1, 1)) - log), 0.0))
    return which, n, named, add(n).astype(np.int64), add(n > 0).astype(np.int64), add(n == 1).astype(np.int64), gain


def _answers(kind: int, bucket: int, rows: list[dict]):
    """Rows of ``_ANSWER`` to the shards that asked one bucket."""
    parts = [np.frombuffer(r["keys"], np.uint64) if kind == _WORDS else _from_tails(r["keys"]) for r in rows]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    keys, counts = np.concatenate(parts), np.concatenate([_unpack(r["counts"], np.uint32) for r in rows])
    if kind == _WORDS:
        distinct, which = np.unique(keys, return_inverse=True)
        n = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        sums = int(n.sum()), int(np.count_nonzero(n)), int(np.count_nonzero(n == 1))
        for i, (r, part) in enumerate(zip(rows, np.split(n[which], cuts))):
            yield r["shard"], kind, bucket, _pack(part), None, 0, *(sums if i == 0 else (0, 0, 0)), 0.0
        return
    signed = [_unpack(r["runs"], np.int32) for r in rows]
    runs, sent = np.concatenate(signed), np.frombuffer(b"".join(r["contexts"] for r in rows), np.uint64)
    logs = np.concatenate([_unpack(r["logs"], np.uint8) for r in rows]) / -_LOG_STEPS
    which, n, named, total, kinds, ones, gain = _sums(keys, np.repeat(sent, np.abs(runs)), counts, logs)
    at = np.searchsorted(named, sent)
    hot = np.zeros(len(named), bool)
    hot[at[runs < 0]] = True
    state = _retained(total, kinds, ones, gain) & ~hot
    states = np.where(state[:, None], np.stack([total, kinds], axis=1), 0)[at]
    run_cuts = np.cumsum([len(s) for s in signed])[:-1]
    for r, values, own in zip(rows, np.split(n[which], cuts), np.split(states, run_cuts)):
        yield r["shard"], kind, bucket, _pack(values), _pack(own.reshape(-1)), 0, 0, 0, 0, 0.0
    for i in np.flatnonzero(hot):
        yield -1, _PARTIAL, bucket, None, None, int(named[i].view(np.int64)), int(total[i]), int(kinds[i]), int(ones[i]), float(gain[i])


def _reply(batches):
    """Answers of a partition sorted by kind and bucket."""
    names = [part.split()[0] for part in _ANSWER.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    kinds = [types[part.split()[1]] for part in _ANSWER.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), kinds)], names=names)

    now, rows = None, []
    for batch in text_slices(batches, "keys", 16 << 20):
        passed = []
        for r in batch.to_pylist():
            if r["kind"] == _ASK:
                passed.append((r["shard"], _ASK, r["bucket"], None, None, int(np.frombuffer(r["contexts"], np.int64)[0]), 0, 0, 0, 0.0))
                continue
            if (r["kind"], r["bucket"]) != now:
                if rows:
                    yield batch_of(list(_answers(*now, rows)))
                now, rows = (r["kind"], r["bucket"]), []
            rows.append(r)
        if passed:
            yield batch_of(passed)
    if rows:
        yield batch_of(list(_answers(*now, rows)))


def _hot_states(answers: DataFrame) -> DataFrame:
    """(shard, kind _ASK, context, n, kinds, ones, gain): sums of hot contexts
    over all buckets, for each shard that has them."""
    sums = answers.where(F.col("kind") == _PARTIAL).groupBy("context").agg(*(F.sum(c).alias(c) for c in ("n", "kinds", "ones", "gain")))
    asked = answers.where(F.col("kind") == _ASK).select("shard", "context")
    return materialize(asked.join(sums, "context"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                depth: int = DEPTH, hot_count: int = HOT_COUNT) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ensure_checkpoint_dir(rows.sparkSession)
    buckets = max(16, math.ceil(total_bytes(rows, "text") / shard_bytes))
    shards = token_shards(rows, shard_bytes, buckets)
    id_type = shards.schema["ids"].dataType.elementType.simpleString()

    def table_of(rows) -> pa.Table:
        columns = list(zip(*rows)) or [()] * 8
        types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table({part.split()[0]: pa.array(c, t) for part, c, t in zip(_ASKED.split(", "), columns, types)})

    def answered(asked: DataFrame) -> DataFrame:
        return materialize(asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_reply, _ANSWER))

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = table_of(Shard(row, buckets, hot_count).entries.packed(row["shard"], _WORDS))
                yield from table.to_batches()

    words = answered(shards.drop("ids").mapInArrow(ask_words, _ASKED))
    n_train, v_train, once = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("kinds"), F.sum("ones")).first())

    def level(row: dict, found: pa.Table) -> Shard:
        """The shard after the answers of all levels so far."""
        own = Shard(row, buckets, hot_count)
        order = found.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = order.column("kind").to_numpy()
        levels = order.column("level").to_numpy()
        
        def joined(name: str, at: np.ndarray) -> np.ndarray:
            parts = [_unpack(b, np.int64) for b in order.column(name).take(pa.array(at)).to_pylist()]
            return np.concatenate(parts) if parts else np.empty(0, np.int64)

        own.take_words(joined("values", np.flatnonzero(kinds == _WORDS)), n_train, v_train, once)
        for d in range(1, int(levels.max()) + 1):
            own.next_level()
            at = np.flatnonzero(kinds == d)
            hot = order.filter(pa.array((kinds == _ASK) & (levels == d)))
            n, k, ones, gain = (hot.column(c).to_numpy() for c in ("n", "kinds", "ones", "gain"))
            state = _retained(n, k, ones, gain)
            context = hot.column("context").to_numpy().view(np.uint64)
            own.take_grams(joined("values", at), joined("states", at).reshape(-1, 2), context[state], np.stack([n, k], axis=1)[state])
        return own

    columns = ["shard", "kind", "bucket", "values", "states", "context", "n", "kinds", "ones", "gain"]
    answers = words.select(*columns, F.lit(0).alias("level"))

    def ask(texts: pa.Table, found: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        own = level(row, found)
        own.next_level()
        return table_of(own.entries.packed(row["shard"], own.depth))

    for d in range(1, depth + 1):
        asked = shards.drop("ids").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(ask, _ASKED)
        found = answered(asked)
        hot = _hot_states(found).select("shard", F.lit(_ASK).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("values"),
                                        F.lit(None).cast("binary").alias("states"), "context", "n", "kinds", "ones", "gain")
        answers = answers.unionByName(found.where("kind > 0").select(*columns).unionByName(hot).withColumn("level", F.lit(d)))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        row = texts.drop_columns(["ids"]).to_pylist()[0]
        own = level(row, found)
        add = lambda values: pa.array(np.add.reduceat(values, own.starts))
        return pa.table({
            "doc_id": texts.column("ids").combine_chunks().flatten(), "held_out": pa.array(own.held), "n_tokens": pa.array(own.sizes),
            "n_known": add(own.known.astype(np.int64)), "train_tokens": pa.array(np.full(len(own.sizes), n_train, np.int64)),
            "base_score": add(own.base), "score": add(np.log10(own.p))})

    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
