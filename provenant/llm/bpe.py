"""Operator 4: byte-level BPE by prefix-sharing trie traversal.

Texts are cut into words by the tokenizer's own pattern.  The distinct words of
a slice are put into a trie of bytes, and a depth-first walk gives every node
the last token of the encoding of its prefix.  A token ``t`` ending at a node
is that last token exactly if the encoding of the prefix before ``t`` ends in a
token ``s`` such that BPE keeps ``s t`` apart; so a node needs only the states
of its ancestors, and a prefix shared by many words is encoded once.  A word's
tokens are read back from the last-token states.

Texts are cut ``PART`` characters at a time, so a very long one is never held
as a list of all its words.  Encodings of words are kept per task, about twice
``MAX_CACHED`` of them (those not met lately go, which changes time, not
results).  The vocabulary (a file
of bounded size, path given) is read by the driver and broadcast.  Nothing is
shuffled.

Defined results: null and empty text have no tokens and decode to ""; repeated
rows are each reported; a special token's string in the text becomes that
token, as in the library; very long texts and words are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import sha, text_slices

MAX_CACHED = 120_000
SLICE = 512 << 10
PART = 256 << 10
MAX_VOCABULARY_BYTES = 64 << 20

# Fixed pattern of byte-level pre-tokenisation.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_file(path: str) -> bytes:
    """A tokenizer file's bytes, their number checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("vocabulary file too large to broadcast")
    return data


def read_vocabulary(path: str) -> dict:
    """Merges and ids of tokens, as bytes, from a tokenizer file."""
    return parse_vocabulary(vocabulary_file(path))


def parse_vocabulary(data: bytes) -> dict:
    spec = json.loads(data)
    model, letters = spec["model"], byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"ids": {raw(t): i for t, i in model["vocab"].items() if t not in special},
            "merges": [(raw(a), raw(b)) for a, b in pairs], "special": special}


class _Texts(dict):
    """Decimal text of numbers, made once each."""

    def __missing__(self, key: int) -> str:
        value = self[key] = str(key)
        return value


_NEVER = (1 << 60, -1)
_ONE = (1,)


class TrieEncoder:
    """Encodes words of bytes; see the module's text."""

    def __init__(self, vocabulary: dict):
        ids = vocabulary["ids"]
        self.token_bytes = {i: b for b, i in ids.items()}
        self.special = vocabulary["special"]
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.rank = {}
        self.made = {}
        for k, (a, b) in enumerate(vocabulary["merges"]):
            self.rank.setdefault((ids[a], ids[b]), (k, ids[a + b]))
        self.single = [ids[bytes([b])] for b in range(256)]
        # only tokens that BPE makes from their own bytes can be a last token
        self.ids = {b: i for b, i in ids.items() if self.merge(b) == [i]}
        # lengths of tokens by their last three (two) bytes, longest first
        tails: dict[bytes, list[int]] = {}
        for b in self.ids:
            tails.setdefault(b[-3:], []).append(len(b))
        self.pairs = {k: [2, 1] for k in tails if len(k) == 2}
        self.tails = {k: sorted({*v, *self.pairs.get(k[1:], [1])}, reverse=True) for k, v in tails.items() if len(k) == 3}
        self.apart: dict[int, bool] = {}  # by both tokens in one number, smaller than a pair
        # words seen lately, and those of the generation before: ids as text
        self.words: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.decimal = _Texts()
        self.unlike: set[str] = set()  # words that do not decode to themselves
        self.split = regex.compile(WORDS).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """BPE by its definition: join the pair of least rank, leftmost first."""
        rank, none = self.rank, _NEVER
        out = [self.single[b] for b in word]
        costs = [rank.get(p, none)[0] for p in zip(out, out[1:])]
        while costs:
            least = min(costs)
            if least == none[0]:
                break
            k = costs.index(least)
            out[k:k + 2] = [rank[out[k], out[k + 1]][1]]
            del costs[k]
            if k:
                costs[k - 1] = rank.get((out[k - 1], out[k]), none)[0]
            if k < len(costs):
                costs[k] = rank.get((out[k], out[k + 1]), none)[0]
        return out

    def stay_apart(self, s: int, t: int) -> bool:
        """Does BPE of the two tokens' bytes give just these two tokens?"""
        known = self.apart.get(s << 32 | t)
        if known is None:
            if len(self.apart) > 3 * MAX_CACHED:
                self.apart.clear()
            known = self.apart[s << 32 | t] = self.merge(self.token_bytes[s] + self.token_bytes[t]) == [s, t]
        return known

    def encode_words(self, words: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each word; the words are walked in trie order.

        Sorted words visit the trie depth first: what a word shares with the
        one before is its path from the root, whose states are kept on a
        stack."""
        order = sorted(words)
        get, apart, stay, tails, pairs = self.ids.get, self.apart.get, self.stay_apart, self.tails.get, self.pairs.get
        done: dict[bytes, list[int]] = {}
        last: list[int] = []   # last token of the prefix of length i + 1
        width: list[int] = []  # its length in bytes
        before = b""
        for word in order:
            shared = 0
            top = min(len(word), len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del last[shared:], width[shared:]
            for end in range(shared + 1, len(word) + 1):
                lengths = tails(word[end - 3:end]) if end > 2 else None
                for n in lengths or pairs(word[end - 2:end] if end > 1 else b"", _ONE):
                    if n > end:
                        continue
                    t = get(word[end - n:end])
                    if t is None:
                        continue
                    if n == end:
                        break
                    s = last[end - n - 1]
                    ok = apart(s << 32 | t)
                    if ok is None:
                        ok = stay(s, t)
                    if ok:
                        break
                last.append(t)
                width.append(n)
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at - 1])
                at -= width[at - 1]
            done[word] = tokens[::-1]
            before = word
        return [done[w] for w in words]

    def learn(self, words: set[str]) -> None:
        """Put the words' encodings into the cache."""
        if len(self.words) > MAX_CACHED:
            self.words, self.before, self.unlike = {}, self.words, set()
        now, old = self.words, self.before
        new = []
        for w in words:
            if w not in now:
                ids = old.get(w)
                if ids is None or w in self.unlike:
                    new.append(w)
                else:
                    now[w] = ids
        raw = [w.encode() for w in new]
        text, part = self.decimal.__getitem__, self.token_bytes.__getitem__
        for w, r, ids in zip(new, raw, self.encode_words(raw)):
            now[w] = ",".join(map(text, ids))
            if b"".join(map(part, ids)) != r:
                self.unlike.add(w)

    def forget(self) -> None:
        self.words, self.before, self.unlike, self.apart = {}, {}, set(), {}
        self.decimal.clear()

    def words_of(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, in order, in lists.

        A word that ends close to the end of a part may go on after it (the
        pattern looks at most two characters past a word), so it is cut again
        with the next part."""
        at, size = 0, PART
        while at < len(text):
            stop = at + size
            found = self.split(text, at, stop)
            if stop < len(text):
                end = stop
                while found and end > stop - 3:
                    end -= len(found.pop())
                size = PART if found else 2 * size
                stop = end if found else at
            at = stop
            if found:
                yield found

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens of a text, in order, in lists."""
        if self.cut is None or not any(s in text for s in self.special):
            yield from self.words_of(text)
            return
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                yield [part]
            else:
                yield from self.words_of(part)

    def encode_texts(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Per text: its ids (decimal, comma-joined) and the decoded text."""
        done: list[list[str]] = [[] for _ in texts]
        alike = [True] * len(texts)
        for group in self._groups(texts):
            distinct = set().union(*(p for _, p in group))
            specials = distinct & self.special.keys()
            self.learn(distinct - specials)
            known = self.words if not specials else self.words | {s: str(self.special[s]) for s in specials}
            for k, p in group:
                done[k].append(",".join(map(known.__getitem__, p)))
                # words that decode to themselves decode to the text
                if self.unlike and not self.unlike.isdisjoint(p):
                    alike[k] = False
        out = []
        for t, parts, same in zip(texts, done, alike):
            ids = ",".join(parts)
            out.append((ids, (t or "") if same else self.decode(ids)))
        return out

    def _groups(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """(number of the text, its next words), in groups of about ``PART``."""
        group, size = [], 0
        for k, t in enumerate(texts):
            for words in self.pieces(t) if t else ():
                group.append((k, words))
                size += sum(map(len, words))
                if size >= PART:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def decode(self, ids: str) -> str:
        return b"".join(self.token_bytes[int(i)] for i in ids.split(",") if i).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}  # of a worker process: the last vocabulary's


def _encoder(key: str, vocabulary: Callable[[], bytes]) -> TrieEncoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(parse_vocabulary(vocabulary()))
    return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, ids (array<int>), decoded (text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _encoded(rows, vocabulary_path, "text", ["doc_id"], lambda both: [
        pa.array([_numbers(i) for i, _ in both], pa.list_(pa.int32())), pa.array([d for _, d in both], pa.string())],
        "ids array<int>, decoded string")


def encode_rows(docs: DataFrame, vocabulary_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, then ids (array<int>) and n_tokens."""
    return _encoded(docs.select(*dict.fromkeys([*keep, text_col])), vocabulary_path, text_col, keep, lambda both: [
        pa.array([_numbers(i) for i, _ in both], pa.list_(pa.int32())), pa.array([_count(i) for i, _ in both], pa.int64())],
        "ids array<int>, n_tokens long")


def token_digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The contract's columns: n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(docs.select("doc_id", "text"), vocabulary_path, "text", ["doc_id"], lambda both: [
        pa.array([_count(i) for i, _ in both], pa.int64()), pa.array([sha(i.encode()) for i, _ in both], pa.string()),
        pa.array([sha(d.encode()) for _, d in both], pa.string())],
        "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=",")


def _count(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def _encoded(rows: DataFrame, path: str, text_col: str, keep: list[str], columns, added: str) -> DataFrame:
    """``keep`` columns of the rows, then what ``columns`` makes of each
    text's (ids, decoded)."""
    # the file itself: its parsed form would stay in every worker beside the encoder
    vocabulary = vocabulary_file(path)
    key, shared = sha(vocabulary), rows.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL(added).fields])
    names = schema.names

    def run(batches):
        encoder = _encoder(key, lambda: shared.value)
        try:
            for batch in text_slices(batches, text_col, SLICE):
                both = encoder.encode_texts(batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns(both)], names=names)
        finally:
            encoder.forget()  # an idle worker keeps the vocabulary only

    return rows.mapInArrow(run, schema)
