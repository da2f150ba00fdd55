"""Operator 5: quotation linking of chat and mail messages (DataFrame only).

The lines of a message carry a quote level (the number of leading ``>``).
Neighbouring lines of one level form a passage; blank lines and changes of
level part passages.  Passages and single lines are normalised (case, white
space) and hashed.  A quoted hash is joined, within its conversation, to the
earliest message that holds it unquoted, and a message's parent is the earlier
message that most quoted characters of its outermost level come from.  Messages
are put out without quotes and attribution lines (all of them, or with
``keep_unlinked`` those whose original is found; an empty quoted line goes with
the passage before it); ``(conv_id, root_turn,
turn)`` is the reply order: every message that answers none, followed by all
that answer it directly or through others.

Only column expressions, joins and grouping run; the chain of parents is
followed by doubling, so a chain of n replies takes log n rounds.  Originals
are reduced to one row per (conversation, hash) by a minimum, so neither a
frequent line nor a large conversation meets itself.

Defined results: null text counts as empty; a message with null conv_id or
turn is not linked and its own root; rows that repeat (conv_id, turn) are one
message for links (their quotes together) and each put out; a quote found only
in later or equal turns is not linked; very long texts are handled whole; extra
columns are ignored; no messages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.session import materialize

#: a single line must have this many characters to count as evidence
MIN_LINE = 12
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def _lines(text: Column) -> Column:
    """Array of (level, content, blank, raw) of a text's lines."""
    raw = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^[ \t]*(?:>[ \t]?)*+", 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        content = F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)*+", "")
        return F.struct(level.alias("level"), F.when(level > 0, content).otherwise(x).alias("content"), (F.trim(content) == "").alias("blank"),
                        x.alias("raw"))

    return F.transform(raw, line)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s \x1e\x1f]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``lines``: (level, content, blank, raw, attribution)."""
    rows = messages.withColumn("lines", _lines(F.col("text")))
    following = lambda i: F.get(F.col("lines"), i + 1)
    marked = F.transform("lines", lambda x, i: F.struct(
        x["level"].alias("level"), x["content"].alias("content"), x["blank"].alias("blank"), x["raw"].alias("raw"),
        F.coalesce((x["level"] == 0) & x["content"].rlike(ATTRIBUTION) & (following(i)["level"] > 0), F.lit(False)).alias("attribution")))
    return rows.withColumn("lines", marked)


def _starts(x: Column, i: Column) -> Column:
    """Does line ``i`` begin a passage?"""
    before = F.when(i > 0, F.get(F.col("lines"), i - 1))
    return ~F.coalesce((before["level"] == x["level"]) & ~before["blank"] & ~before["attribution"], F.lit(False))


def _passages() -> Column:
    """Passages (level, norm) of the lines: runs are joined to one string,
    parted where the level changes or a line is blank, and cut apart."""
    piece = F.transform("lines", lambda x, i: F.when(x["blank"] | x["attribution"], F.lit("")).otherwise(F.concat(
        F.when(_starts(x, i), F.concat(F.lit("\u001e"), x["level"].cast("string"), F.lit("\u001f"))).otherwise(F.lit(" ")),
        F.translate(x["content"], "\u001e\u001f", "  "))))
    runs = F.filter(F.split(F.array_join(piece, ""), "\u001e"), lambda s: s != "")
    return F.transform(runs, lambda s: F.struct(
        F.substring_index(s, "\u001f", 1).cast("int").alias("level"),
        _normal(F.substring(s, F.locate("\u001f", s) + 1, F.length(s))).alias("norm")))


def _blocks() -> Column:
    """The lines in blocks (kind, lines): a passage with the blank lines after it
    (kind: its level) or an attribution line (kind -1).  Every line is in one
    block, as it was written."""
    escaped = lambda t: F.replace(F.replace(t, F.lit("\u001f"), F.lit("\u001f1")), F.lit("\u001e"), F.lit("\u001f0"))
    back = lambda t: F.replace(F.replace(t, F.lit("\u001f0"), F.lit("\u001e")), F.lit("\u001f1"), F.lit("\u001f"))
    head = lambda kind: F.concat(F.lit("\u001e"), kind.cast("string"), F.lit("\u001f2"))
    piece = F.transform("lines", lambda x, i: F.concat(
        F.when(x["attribution"], head(F.lit(-1))).when((i == 0) | (~x["blank"] & _starts(x, i)), head(x["level"])).otherwise(F.lit("\n")),
        escaped(x["raw"])))
    runs = F.filter(F.split(F.array_join(piece, ""), "\u001e"), lambda s: s != "")
    return F.transform(runs, lambda s: F.struct(
        F.substring_index(s, "\u001f2", 1).cast("int").alias("kind"),
        F.transform(F.split(F.substring(s, F.locate("\u001f2", s) + 2, F.length(s)), "\n"), back).alias("lines")))


def _without_linked(blocks: Column, linked: Column) -> Column:
    """The lines that stay: all but quoted passages and lines whose hash is
    linked, and attributions of a passage of which something is linked."""
    content = lambda t: F.regexp_replace(t, r"^[ \t]*(?:>[ \t]?)*+", "")
    whole = lambda b: F.xxhash64(_normal(F.array_join(F.transform(b["lines"], content), " ")))
    hit = lambda t: F.array_contains(linked, F.xxhash64(_normal(content(t))))
    marked = F.transform(blocks, lambda b: F.struct(
        b["kind"].alias("kind"), b["lines"].alias("lines"),
        F.when(b["kind"] <= 0, F.array().cast("array<string>")).when(
            F.array_contains(linked, whole(b)), F.filter(b["lines"], lambda t: F.trim(t) != "")).otherwise(F.filter(b["lines"], hit)).alias("gone")))
    kept = F.transform(marked, lambda b, i: F.when(b["kind"] < 0, F.when(F.size(F.get(marked, i + 1)["gone"]) > 0, F.array().cast("array<string>")).otherwise(
        b["lines"])).when(F.size(b["gone"]) > 0, F.filter(b["lines"], lambda t: ~F.array_contains(b["gone"], t))).otherwise(b["lines"]))
    return F.flatten(kept)


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, size) of all passages and longer lines."""
    single = F.transform(F.filter("lines", lambda x: ~x["blank"] & ~x["attribution"]),
                         lambda x: F.struct(x["level"].alias("level"), _normal(x["content"]).alias("norm")))
    every = F.concat(_passages(), F.filter(single, lambda x: F.length(x["norm"]) >= MIN_LINE))
    rows = parsed(messages).where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(every).alias("u"))
    return rows.where("u.norm != ''").select("conv_id", "turn", "u.level", F.xxhash64("u.norm").alias("hash"), F.length("u.norm").alias("size"))


def linked_units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, size, source_turn) of the quoted units that
    an earlier message holds unquoted."""
    u = units(messages)
    original = u.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn"))
    quoted = u.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.max("size").alias("size"))
    return quoted.join(original, ["conv_id", "hash"]).where("source_turn < turn")


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source_turn, size, units): which message the
    quotes of each level come from."""
    return _counted(linked_units(messages))


def _counted(linked: DataFrame) -> DataFrame:
    return linked.groupBy("conv_id", "turn", "level", "source_turn").agg(F.sum("size").alias("size"), F.count("*").alias("units"))


def parents(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn): by the outermost linked level, the source
    of most characters, the latest of equals."""
    best = F.max(F.struct(-F.col("level"), F.col("size"), F.col("source_turn"))).alias("best")
    return links.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.source_turn").alias("parent_turn"))


def roots(parent: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) by pointer doubling."""
    now = materialize(parent.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "up"], "left")
        if not joined.where("up2 is not null").limit(1).count():
            break
        now = materialize(joined.select("conv_id", "turn", "parent_turn", F.coalesce("up2", "up").alias("up"),
                                        (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return now.select("conv_id", "turn", "parent_turn", F.col("up").alias("root_turn"), "depth")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                keep_unlinked: bool = False) -> DataFrame:
    """Per message row: conv_id, root_turn, turn, parent_turn, depth, role,
    n_quoted (passages), text without quotes, formatted (role-tagged turn).

    With ``keep_unlinked`` a line that begins with ``>`` and whose original is
    not found stays as it was written, its attribution line too; otherwise all
    quoted lines are left out."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                           F.col(text_col).alias("text"))
    links = materialize(linked_units(rows))
    tree = roots(parents(_counted(links)))
    if keep_unlinked:  # a message's linked hashes: no more than it has lines
        hashes = links.groupBy("conv_id", "turn").agg(F.collect_set("hash").alias("linked"))
        tree = tree.join(hashes, ["conv_id", "turn"])
    found = parsed(rows).join(tree, ["conv_id", "turn"], "left")
    if keep_unlinked:
        # without links there is nothing to look up: the blocks of most messages are not made
        own = F.when(F.col("linked").isNull(), F.transform("lines", lambda x: x["raw"])).otherwise(_without_linked(_blocks(), F.col("linked")))
    else:
        own = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["attribution"]), lambda x: x["content"])
    clean = F.regexp_replace(F.array_join(own, "\n"), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    n_quoted = F.size(F.filter(_passages(), lambda p: p["level"] > 0)).cast("long")
    out = found.select("conv_id", "turn", "role", n_quoted.alias("n_quoted"), clean.alias("text"), "parent_turn", "root_turn", "depth")
    tag = F.coalesce("role", F.lit("user"))
    return out.select("conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn", "parent_turn",
                      F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "role", "n_quoted", "text",
                      F.concat(F.lit("<|"), tag, F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("formatted"))
