"""Operator 10: benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are put into one suffix automaton.
Document words are streamed through it; the automaton state tells, after every
word, the longest suffix read so far that occurs in some item.  Where that
length reaches the window (10 words) the last 10 words are a window of an item,
and the state's suffix-link ancestor of that length names the items.  Items
shorter than the window count as one window of their own length.

The items of one automaton are bounded (``MAX_BLOCK_WORDS``): a larger
benchmark is hashed into blocks and the documents are streamed once per block,
each pass adding its hits to those of the passes before.  Work per document is
one pass over its words; nothing is shuffled.

Defined results: null or word-less text has 0 words and no hits; an empty
benchmark hits nothing; items without words have no window; items that repeat
an item_id are one item; an item whose id is null marks words but is not
listed; document rows that repeat are each reported; other columns are ignored
by :func:`benchmark_hits` and kept by :func:`remove_contamination`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import text_slices
from provenant.session import materialize

WINDOW = 10
MAX_BLOCK_WORDS = 2_000_000

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytearray(range(256))
for _b in _SEPARATORS:
    _NORMAL[_b] = 0x20
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 32
_NORMAL = bytes(_NORMAL)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.encode().translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the word sequences of many items.

    ``items``: (item id or None, words).  After :meth:`__init__`,
    ``window_items[state]`` lists the items holding the window-long string of
    that state, ``short[state]`` the (length, item numbers) of items shorter
    than the window that end in that state.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]
        self.names: list[str | None] = []
        numbers: dict[object, int] = {}
        sequences = []
        for name, words in items:
            if not words:
                continue
            if name is None or name not in numbers:
                number = len(self.names)
                self.names.append(None if name is None else str(name))
                if name is not None:
                    numbers[name] = number
            else:
                number = numbers[name]
            sequences.append((number, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, seq in sequences:
            last = 0
            for symbol in seq:
                last = self._add(last, symbol)
        self._mark(sequences)

    def _state(self, size: int, link: int, go: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.go.append(go)
        return len(self.size) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """State of the string of ``p`` plus symbol, cut off from ``q``."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = clone
        while p >= 0 and self.go[p].get(symbol) == q:
            self.go[p][symbol] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, symbol: int) -> int:
        known = self.go[last].get(symbol)
        if known is not None:
            return self._split(last, known, symbol)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in self.go[p]:
            self.go[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.go[p][symbol], symbol)
        return new

    def _mark(self, sequences: list[tuple[int, list[int]]]) -> None:
        w = self.window
        n = len(self.size)
        # the ancestor holding the window-long suffix, in order of length
        self.at_window = [-1] * n
        for s in sorted(range(1, n), key=self.size.__getitem__):
            if self.size[s] >= w:
                self.at_window[s] = s if self.size[self.link[s]] < w else self.at_window[self.link[s]]
        self.window_items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        shortest = w
        for number, seq in sequences:
            state = 0
            for i, symbol in enumerate(seq):
                state = self.go[state][symbol]
                if i + 1 >= w:
                    self.window_items.setdefault(self.at_window[state], set()).add(number)
            if len(seq) < w:
                shortest = min(shortest, len(seq))
                marks = self.short.setdefault(state, [])
                if (len(seq), number) not in marks:
                    marks.append((len(seq), number))
        self.shortest = shortest
        self.above_short = [-1] * n
        if self.short:
            for s in sorted(range(1, n), key=self.size.__getitem__):
                self.above_short[s] = s if s in self.short else self.above_short[self.link[s]]

    def scan(self, words: list[int], start: int, stop: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (word positions) and items in ``words[start:stop]``."""
        go, link, size, window = self.go, self.link, self.size, self.window
        state = length = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i in range(start, stop):
            symbol = words[i]
            while state and symbol not in go[state]:
                state = link[state]
                length = size[state]
            step = go[state].get(symbol)
            if step is None:
                length = 0
                continue
            state, length = step, length + 1
            if length >= window:
                # at length == size the state's own window ancestor; shorter
                # matches still end in the same window-long string
                found |= self.window_items[self.at_window[state]]
                _push(spans, i + 1 - window, i + 1)
            up = self.above_short[state]
            while up > 0:
                for m, number in self.short[up]:
                    if m <= length:
                        found.add(number)
                        _push(spans, i + 1 - m, i + 1)
                up = self.above_short[link[up]] if link[up] > 0 else -1
        return spans, found


def _push(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Add a span ending last, merging overlaps and neighbours."""
    while spans and a <= spans[-1][1]:
        x, y = spans.pop()
        a, b = min(a, x), max(b, y)
    spans.append((a, b))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        _push(out, a, b)
    return out


def _scan_slice(texts: list[str | None], auto: ItemAutomaton) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """Per text: number of words, hit spans, item numbers."""
    get = auto.vocab.get
    ids: list[int] = []
    ends = []
    for t in texts:
        ids += [get(x, -1) for x in normal_words(t)]
        ids.append(-1)  # matches end with the text
        ends.append(len(ids))
    known = np.concatenate(([0], (np.asarray(ids, dtype=np.int64) >= 0).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(known))
    first, last = turn[::2], turn[1::2]
    # only stretches of item words long enough for a window can hit
    enough = last - first >= auto.shortest
    first, last = first[enough], last[enough]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    owner = np.searchsorted(starts, first, side="right") - 1
    hits: dict[int, tuple[list, set]] = {}
    for a, b, d in zip(first.tolist(), last.tolist(), owner.tolist()):
        spans, found = auto.scan(ids, a, b)
        if spans:
            own = hits.setdefault(d, ([], set()))
            own[0].extend((x - int(starts[d]), y - int(starts[d])) for x, y in spans)
            own[1].update(found)
    for d, (s, e) in enumerate(zip(starts.tolist(), ends)):
        spans, found = hits.get(d, ([], set()))
        yield e - s - 1, spans, found


def _pass(df: DataFrame, text_col: str, names: dict[str, str], items: list[tuple[object, list[bytes]]], window: int) -> DataFrame:
    """One pass of the documents through the automaton of one block."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(items)
    n_words, spans_c, items_c, unnamed_c = names["n_words"], names["spans"], names["items"], names["unnamed"]
    keep = [c for c in df.columns if c not in names.values()]
    span_t = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    out_schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(n_words, T.LongType()),
                               T.StructField(spans_c, span_t), T.StructField(items_c, T.ArrayType(T.StringType())),
                               T.StructField(unnamed_c, T.IntegerType())])
    arrow_span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        auto = ItemAutomaton(shared.value, window)
        for batch in text_slices(batches, text_col):
            before_spans = batch.column(spans_c).to_pylist() if spans_c in batch.schema.names else [None] * batch.num_rows
            before_items = batch.column(items_c).to_pylist() if items_c in batch.schema.names else [None] * batch.num_rows
            before_unnamed = batch.column(unnamed_c).to_pylist() if unnamed_c in batch.schema.names else [0] * batch.num_rows
            n, all_spans, all_items, all_unnamed = [], [], [], []
            results = _scan_slice(batch.column(text_col).to_pylist(), auto)
            for (words, spans, found), s0, i0, u0 in zip(results, before_spans, before_items, before_unnamed):
                n.append(words)
                if s0:
                    spans = spans + [(x["a"], x["b"]) for x in s0]
                all_spans.append([{"a": a, "b": b} for a, b in _merge(spans)])
                all_items.append(sorted({auto.names[k] for k in found if auto.names[k] is not None} | set(i0 or [])))
                all_unnamed.append(sum(auto.names[k] is None for k in found) + u0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(all_spans, arrow_span),
                 pa.array(all_items, pa.list_(pa.string())), pa.array(all_unnamed, pa.int32())],
                names=[*keep, n_words, spans_c, items_c, unnamed_c])

    return df.mapInArrow(run, out_schema)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                max_words: int = MAX_BLOCK_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items as bounded lists of (id, words); one block unless the
    benchmark is larger than ``max_words`` (at least two bytes a word)."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / max_words))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield [(r["id"], normal_words(r["text"])) for r in part.collect()]


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                    prefix: str = "hit_", max_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``<prefix>n_words``, ``<prefix>spans`` (word positions,
    end exclusive, merged), ``<prefix>items`` (sorted item ids) and
    ``<prefix>unnamed`` (number of items without an id)."""
    names = {k: prefix + k for k in ("n_words", "spans", "items", "unnamed")}
    clash = set(names.values()) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    out = docs
    for k, items in enumerate(item_blocks(benchmark, max_words=max_words)):
        out = _pass(materialize(out) if k else out, text_col, names, items, window)
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, max_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted ids),
    spans (word positions), contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = benchmark_spans(rows, benchmark, "text", window, max_words=max_words)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return found.select("doc_id", F.col("hit_n_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("hit_items").cast("long").alias("n_items"), F.col("hit_items").alias("items"),
                        F.col("hit_spans").alias("spans"), (n_hit > 0).alias("contaminated"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns from :func:`benchmark_hits`."""
    return benchmark_hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return "".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                         max_coverage: float = 0.8) -> DataFrame:
    """Documents without the passages of the benchmark.

    Hit spans are cut from the text; a document of whose words more than
    ``max_coverage`` are hit is dropped whole.  Others stay unchanged, with
    all their columns."""
    columns = docs.columns
    prefix = "hit_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    found = benchmark_spans(docs, benchmark, text_col, window, prefix=prefix)
    spans = F.col(prefix + "spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    found = found.where(n_hit <= F.lit(max_coverage) * F.col(prefix + "n_words"))
    spans_c = prefix + "spans"

    def run(batches):
        for batch in text_slices(batches, text_col):
            hit = batch.column(spans_c).to_pylist()
            texts = batch.column(text_col)
            if any(hit):
                texts = pa.array([cut_words(t, [(x["a"], x["b"]) for x in h]) if h else t
                                  for t, h in zip(texts.to_pylist(), hit)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in columns], names=columns)

    return found.mapInArrow(run, docs.schema)
