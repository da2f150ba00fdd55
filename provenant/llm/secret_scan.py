"""Operator 8: secret scan with multipart credential linking.

Strong spans (assignments, access identifiers, long hex) are found by pattern
and always reported.  Weak candidates -- account names, bare high-entropy
strings, service endpoints -- say nothing alone.  A scope is an interval: a run
of lines without a blank line between them.  Every part is joined to the scope
that holds its start, and the parts of a scope are linked to each other,
however far apart.  A weak candidate is reported only when a complementary part
is in its scope:

* a weak secret needs an identifier (access id or account) or an endpoint;
* an account needs a secret (assignment, hex or weak secret);
* an endpoint needs a secret and an identifier, so a plain link beside a hash
  is not enough.

Scopes never cross documents, so the join is a sweep over one document's
sorted parts and scope ends: nothing is shuffled, pairs are never listed, and
memory is one text.

Defined results: null or empty text has no spans; an empty table gives no rows; repeated rows are each
reported; a very long text is scanned whole; extra columns are ignored by
:func:`find_secrets` and kept by :func:`redact_secrets`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import text_slices

MIN_ENTROPY = 3.5

# Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so short runs can be left out here

# Weak parts.
ACCOUNT = re.compile(
    r"\b(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey_?[Ii][Dd])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::\d+)?")
BREAK = re.compile(r"\n[\x20\t\r]*\n")

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("weak_secret", "account", "endpoint")
IDENTIFIERS, SECRETS = {"access", "account"}, {"assign", "hex", "weak_secret"}
_RANK = {k: i for i, k in enumerate(BASE_KINDS + WEAK_KINDS)}
Span = tuple[str, int, int]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[Span]:
    """Strong spans in code points, in report order."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def weak_candidates(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that no strong span covers."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("account", *m.span()) for m in ACCOUNT.finditer(text)]
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        s = m[0]
        kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
        if kinds == 3 and _entropy(s) >= MIN_ENTROPY:
            out.append(("weak_secret", *m.span()))
    free: list[Span] = []
    if not out:
        return free
    # one sweep: strong spans and accepted weak ones block what overlaps them
    taken = sorted((a, b) for _, a, b in strong)
    starts = [a for a, _ in taken]
    reach, far = [], 0
    for _, b in taken:
        far = max(far, b)
        reach.append(far)
    end = 0
    for kind, a, b in sorted(out, key=lambda s: (s[1], -s[2], _RANK[s[0]])):
        k = bisect_left(starts, b)
        if (k and reach[k - 1] > a) or a < end:
            continue
        free.append((kind, a, b))
        end = b
    return free


def link_parts(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """The weak candidates whose complementary parts co-occur in scope."""
    if not weak:
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    scope = lambda span: bisect_right(breaks, span[1])
    found: dict[int, set[str]] = {}
    for span in strong + weak:
        found.setdefault(scope(span), set()).add(span[0])
    kept: list[Span] = []
    for span in weak:
        kinds = found[scope(span)]
        identifier, secret = not kinds.isdisjoint(IDENTIFIERS), not kinds.isdisjoint(SECRETS)
        ok = {"weak_secret": identifier or "endpoint" in kinds, "account": secret, "endpoint": identifier and secret}
        if ok[span[0]]:
            kept.append(span)
    return kept


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans) of a text, each in report order."""
    if not text:
        return [], []
    strong = base_spans(text)
    linked = link_parts(text, strong, weak_candidates(text, strong))
    return strong, in_order(strong + linked)


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, strong (spans), spans (strong and linked)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in text_slices(batches, "text"):
            strong, every = [], []
            for t in batch.column("text").to_pylist():
                s, e = scan_text(t)
                strong.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
                every.append([{"kind": k, "start": a, "end": b} for k, a, b in e])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(strong, kind), pa.array(every, kind)],
                                             names=["doc_id", "strong", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, strong {_SPAN}, spans {_SPAN}")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_secrets`."""
    found = find_secrets(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(joined("strong").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every covered stretch replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text blotted out."""
    columns = docs.columns

    def run(batches):
        for batch in text_slices(batches, text_col):
            texts = batch.column(text_col)
            new = []
            for t in texts.to_pylist():
                spans = scan_text(t)[1]
                new.append(redact(t, spans) if spans else t)
            new = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)
