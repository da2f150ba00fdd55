"""Operator 2: main text of web pages by wrapper induction.

A host's pages are grouped by layout (the label paths of their containers), and
each page is aligned with one page of its group (the pivot, the page of least
hash) by simple tree matching over their block-level DOM: two nodes match if
their labels are equal, and their children are matched in order so that the
number of matched nodes is largest.  For every text node of the pivot the pages
count how often their aligned node says the same.  Nodes that say the same on
nearly all pages (``CONSTANT`` of at least ``MIN_PAGES`` that vote) are the
wrapper's template; the varying slots are content.  Pages with the same text
have one vote together, so copies never turn an article into template.  A page
alone with its layout is taken to the largest group with the same upper layout,
else of the host, and votes there only if that group has no votes of its own.

What HTML itself names as not being the article (menus, headers, footers,
asides, forms, scripts, comments, adverts ... by element, role, or a whole class
name or id) is left out as well, unless it is around the article or most of the
varying text; and where at least half of what then varies is marked as article
or main part, only the marked text (both) counts.

Groups are joined to the pages by host and page hash, pivots (packed) by group:
broadcast when their bytes are checked to be small, else by an ordinary shuffle
join.  Votes are bit sets, summed per batch before the shuffle.

Defined results: null or empty html gives "" and 0; a page without a readable
host has no wrapper and is taken alone; repeated rows are each reported;
elements nested deeper than ``MAX_DEPTH`` hang on the element at that depth (no
text is lost); very long pages are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import text_slices
from provenant.session import materialize

MIN_PAGES = 2
#: votes that make text inside a marked article or main part template: two pages
#: may be near copies
MIN_MARKED = 5
CONSTANT = 0.9
MAX_DEPTH = 200
#: pivots up to this many bytes in all may be broadcast
BROADCAST_BYTES = 32 << 20
#: cells of one alignment table kept at once
TABLE_CELLS = 4_000_000

# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp noscript template iframe svg math object video audio canvas select button".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog fieldset".split())
# An opening tag of the first kind ends an open element of the second.
_BLOCK_STARTS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "thead": {"tbody", "thead"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody", "thead"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}
_CHROME = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement sponsored sponsor banner promo cookie cookies consent notice popup modal overlay comment comments reply replies disqus share sharing social related breadcrumb breadcrumbs newsletter subscribe signup login widget pagination pager skip".split())
_COMMENTS = frozenset("comment comments reply replies disqus".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

# What articles consist of: no part of a page's layout.
_CONTENT = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol dir dl dt dd li table thead tbody tfoot tr td th caption colgroup col blockquote pre figure figcaption hr address center details summary menu option".split())
_DIGITS = re.compile(r"\d+")
_MARKUP = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# How firm a mark is: by class, id or form; by element or role; hidden, head or comments.
_SOFT, _NAMED, _FIRM = 1, 2, 3


class Node:
    """A block element, or a run of text (label ``#``)."""

    __slots__ = ("label", "children", "text", "shape", "size", "mark", "chrome", "region", "index")

    def __init__(self, label: str, mark: int, region: int):
        self.label = label
        self.children: list[Node] = []
        self.text: str | None = None
        self.shape = 0
        self.size = 1
        self.mark = mark      # this element is named as not being the article
        self.chrome = False   # left out, see judge()
        self.region = region  # 2 inside an article, 1 inside main, else 0
        self.index = -1       # of a text node, in page order


def _mark(tag: str, attributes: str, inside: int) -> tuple[int, int, str]:
    """(how firmly it is left out, region this opens, class for the label)."""
    region = 2 if tag == "article" else 1 if tag == "main" else 0
    mark, classes = 0, ""
    if tag in LEFT_OUT and not (tag == "header" and inside == 2):
        mark = _FIRM if tag == "head" else _SOFT if tag in ("form", "fieldset") else _NAMED
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes or ""):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "class":
            classes = value
            names.update(value.lower().split())
        elif key == "id":
            names.add(value.strip().lower())
        elif key == "role":
            if value.lower() in _CHROME_ROLES:
                mark = max(mark, _SOFT if value.lower() == "form" else _NAMED)
            if value.lower() == "main":
                region = max(region, 1)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            mark = _FIRM
    found = _CHROME & names
    # the header of an article holds its title
    if found and tag not in ("body", "html", "article", "main") and not (inside == 2 and found == {"header"}):
        mark = max(mark, _FIRM if found & _COMMENTS else _SOFT)
    return mark, region, "" if tag in LEFT_OUT and mark else classes


def parse(page: str) -> tuple[Node, list[Node]]:
    """The block-level tree and its text nodes in page order."""
    root = Node("", 0, 0)
    path = [root]
    run: list[str] = []
    texts: list[Node] = []

    def flush():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                top = path[-1]
                leaf = Node("#", 0, top.region)
                leaf.text, leaf.index = text, len(texts)
                top.children.append(leaf)
                texts.append(leaf)

    def close(k: int):
        flush()
        del path[k:]

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
            continue
        if m[1]:
            for k in range(len(path) - 1, 0, -1):
                if path[k].label.partition(".")[0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK_STARTS:
            own = path[-1].label.partition(".")[0]
            if own == "p" or (own[:1] == tag[0] == "h" and own[1:].isdigit() and tag[1:].isdigit()):
                close(len(path) - 1)
        elif tag in _CLOSES:
            for k in range(len(path) - 1, 0, -1):
                own = path[k].label.partition(".")[0]
                if own in _CLOSES[tag]:
                    close(k)
                    break
                if own in _HOLDS[tag]:
                    break
        flush()
        top = path[-1]
        mark, region, classes = _mark(tag, m[3], top.region)
        node = Node(f"{tag}.{classes}" if classes else tag, mark, max(region, top.region))
        top.children.append(node)
        if len(path) < MAX_DEPTH:
            path.append(node)
    flush()
    _shape(root)
    return root, texts


def _shape(root: Node) -> None:
    """Hash and size of every subtree, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        node.shape = hash((node.label, *(c.shape for c in node.children)))
        node.size = 1 + sum(c.size for c in node.children)


def judge(root: Node, template: set[int] | frozenset[int] = frozenset()) -> None:
    """Set ``chrome`` of every node.  A mark holds for the whole subtree, but
    not where that has the page's main part, an article of at least the free
    text, or (soft marks) most of the text on a page without a free article.
    ``template`` are text nodes that do not count, being the wrapper's."""
    order, todo = [], [(root, 0)]
    while todo:
        node, firm = todo.pop()  # firm: the firmest mark around it
        firm = max(firm, node.mark)
        order.append((node, firm))
        todo += [(c, firm) for c in node.children]
    text: dict[int, int] = {}
    articles: dict[int, int] = {}
    main: dict[int, int] = {}
    total = free = free_articles = free_main = 0
    for node, firm in reversed(order):
        key = id(node)
        if node.text is not None:
            n = len(node.text) if node.index not in template and firm < _FIRM else 0
            text[key], articles[key], main[key] = n, n * (node.region == 2), n * (node.region > 0)
            total += n
            if not firm:
                free, free_articles, free_main = free + n, free_articles + articles[key], free_main + main[key]
        else:
            text[key], articles[key], main[key] = (sum(d[id(c)] for c in node.children) for d in (text, articles, main))
    root.chrome = False
    for node, _ in order:
        for c in node.children:
            key, lifted = id(c), False
            if c.mark and c.mark < _FIRM and text[key]:
                outside = c.region == 0 or node.region == 0
                lifted = (outside and main[key] > articles[key] and not free_main
                          or outside and articles[key] and articles[key] >= (free_main or free)
                          or c.mark == _SOFT and not free_main and 2 * text[key] >= total)
            c.chrome = node.chrome or bool(c.mark) and not lifted


class Matcher:
    """Simple tree matching of pages with one pivot."""

    def __init__(self, page: str):
        self.root, self.texts = parse(page)
        self.weights: dict[tuple[int, int], int] = {}

    def align(self, other: Node) -> list[tuple[Node, Node]]:
        """Matched text nodes (pivot's, page's)."""
        pairs, todo = [], [(self.root, other)]
        while todo:
            a, b = todo.pop()
            if a.text is not None:
                pairs.append((a, b))
                continue
            todo += self._children(a.children, b.children)
        return pairs

    def _children(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        """Matched children.  Nodes of equal shape at either end can be paired
        at once: no other partner could give them more."""
        out = []
        i = 0
        end = min(len(a), len(b))
        while i < end and a[i].shape == b[i].shape:
            out.append((a[i], b[i]))
            i += 1
        x, y = len(a), len(b)
        while x > i and y > i and a[x - 1].shape == b[y - 1].shape:
            x, y = x - 1, y - 1
            out.append((a[x], b[y]))
        if x > i and y > i:
            out += self._table(a[i:x], b[i:y])
        return out

    def weight(self, a: Node, b: Node) -> int:
        """Size of the largest matching of two subtrees."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.shape, b.shape)
        known = self.weights.get(key)
        if known is None:
            if len(self.weights) > 200_000:
                self.weights.clear()
            known = self.weights[key] = 1 + sum(self.weight(x, y) for x, y in self._children(a.children, b.children))
        return known

    def _gains(self, a: list[Node], b: list[Node]) -> np.ndarray:
        kinds: dict[int, int] = {}
        which = np.array([kinds.setdefault(y.shape, len(kinds)) for y in b])
        firsts = {}
        for y in b:
            firsts.setdefault(kinds[y.shape], y)
        rows: dict[int, np.ndarray] = {}
        for x in a:
            if x.shape not in rows:
                rows[x.shape] = np.array([self.weight(x, firsts[k]) for k in range(len(firsts))], np.int64)[which]
        return rows

    def _table(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        """Order-keeping matching of most weight; long sequences are halved
        where a forward and a backward pass meet best (linear memory)."""
        rows = self._gains(a, b)
        if len(a) > 1 and len(a) * len(b) > TABLE_CELLS:
            mid = len(a) // 2
            down, up = self._last(rows, a[:mid], len(b)), self._last({k: v[::-1] for k, v in rows.items()}, a[mid:][::-1], len(b))[::-1]
            cut = int((down + up).argmax())
            left = self._children(a[:mid], b[:cut]) if cut else []
            return left + (self._children(a[mid:], b[cut:]) if cut < len(b) else [])
        table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i, x in enumerate(a):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + rows[x.shape]))
        out, i, j = [], len(a), len(b)
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
        return out

    @staticmethod
    def _last(rows, a: list[Node], n: int) -> np.ndarray:
        row = np.zeros(n + 1, np.int64)
        for x in a:
            nxt = row.copy()
            nxt[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x.shape]))
            row = nxt
        return row


def content_key(root: Node, texts: list[Node]) -> int:
    """Hash of a page's text without its chrome: copies have the same."""
    judge(root)
    return xxhash.xxh3_64_intdigest("\n".join(t.text for t in texts if not t.chrome).encode("utf-8", "surrogatepass")) - (1 << 63)


def layout(root: Node) -> tuple[int, int]:
    """Hashes of the page's skeleton, the label paths of its containers, and of
    the upper part of it.  What an article consists of is no part of it."""
    paths, todo = set(), [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for c in node.children:
            if c.text is None and c.mark < _FIRM and c.label.partition(".")[0] not in _CONTENT:
                own = f"{path}/{_DIGITS.sub('', c.label)}"
                paths.add((depth, own))
                todo.append((c, own, depth + 1))
    form, upper = (xxhash.xxh3_64_intdigest("\n".join(sorted(p for d, p in paths if d < most)).encode("utf-8", "surrogatepass")) - (1 << 63)
                   for most in (MAX_DEPTH, 3))
    return form, upper


def votes(pivot: Matcher, page: str) -> tuple[bytes, bytes]:
    """Bits of the pivot's text nodes that a page has, and of those that say
    the same there."""
    seen, same = np.zeros((2, len(pivot.texts)), bool)
    for a, b in pivot.align(parse(page)[0]):
        seen[a.index], same[a.index] = True, a.text == b.text
    return np.packbits(seen).tobytes(), np.packbits(same).tobytes()


def main_text(page: str | None, pivot: Matcher | None = None, template: frozenset[int] = frozenset()) -> str:
    """Content blocks in page order, joined by a blank line."""
    if not page:
        return ""
    root, texts = parse(page)
    drop: set[int] = set()
    if template and pivot is not None:
        drop = {b.index for a, b in pivot.align(root) if a.text == b.text and (a.index in template or not b.region and -1 - a.index in template)}
    judge(root, drop)
    blocks = [t for t in texts if not t.chrome and t.index not in drop]
    marked = [t for t in blocks if t.region]
    # a few marked teasers beside the text do not make it less of the page
    if 2 * sum(len(t.text) for t in marked) >= sum(len(t.text) for t in blocks):
        blocks = marked
    return "\n\n".join(t.text for t in blocks)


class _Pivots:
    """Parsed pivots of a task, the most recent ones."""

    def __init__(self, most: int = 256):
        self.most, self.kept = most, {}

    def get(self, page: bytes | None) -> Matcher | None:
        if page is None:
            return None
        found = self.kept.pop(page, None) or Matcher(zlib.decompress(page).decode("utf-8", "surrogatepass"))
        self.kept[page] = found
        if len(self.kept) > self.most:
            self.kept.pop(next(iter(self.kept)))
        return found


def _batch(rows: list[tuple], **columns: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(columns.values())], names=list(columns))


def assign(hosted: DataFrame) -> DataFrame:
    """(host, h, copy, grp, pivot_h, voter): per distinct page of the hosts with
    two distinct texts its group, the group's pivot, and if it votes there."""

    def run(batches):
        for batch in text_slices(batches, "html"):
            got = []
            for host, h, page in zip(*(batch.column(c).to_pylist() for c in ("host", "h", "html"))):
                root, texts = parse(page)
                got.append((host, h, content_key(root, texts), *layout(root)))
            yield _batch(got, host=pa.string(), h=pa.int64(), copy=pa.int64(), form=pa.int64(), upper=pa.int64())

    found = hosted.mapInArrow(run, "host string, h long, copy long, form long, upper long")
    found = materialize(found.groupBy("host", "h").agg(*(F.min(c).alias(c) for c in ("copy", "form", "upper"))))
    # copies count for the layout of the one with the least hash
    texts = found.groupBy("host", "copy").agg(F.min(F.struct("h", "form", "upper")).alias("one")).select("host", "one.*")
    forms = texts.groupBy("host", "form").agg(F.min("upper").alias("upper"), F.count("*").alias("n"), F.min("h").alias("pivot_h"))
    largest = F.max(F.struct("n", "form", "pivot_h")).alias("most")
    by_upper = forms.groupBy("host", "upper").agg(largest, F.sum("n").alias("pages"))
    by_host = forms.groupBy("host").agg(largest, F.sum("n").alias("pages")).where("pages >= 2")
    own, upper = F.col("f.n") >= 2, F.col("u.pages") >= 2
    pick = lambda name: F.when(own, F.col(f"f.{name}")).when(upper, F.col(f"u.most.{name}")).otherwise(F.col(f"w.most.{name}"))
    every = found.select("host", "form", "upper").distinct()  # also layouts that only copies have
    groups = every.alias("e").join(by_host.alias("w"), "host").join(
        by_upper.alias("u"), (F.col("u.host") == F.col("e.host")) & (F.col("u.upper") == F.col("e.upper")), "left").join(
        forms.alias("f"), (F.col("f.host") == F.col("e.host")) & (F.col("f.form") == F.col("e.form")), "left")
    groups = groups.select(F.col("e.host").alias("host"), F.col("e.form").alias("form"), pick("form").alias("grp"), pick("pivot_h").alias("pivot_h"),
                           (F.coalesce(own, F.lit(False)) | (pick("n") < 2)).alias("voter"))
    return materialize(found.join(groups, ["host", "form"]).select("host", "h", "copy", "grp", "pivot_h", "voter"))


def induce(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, h, grp) of the pages, and (host, grp, pivot, template): per group
    its pivot page, packed, and the numbers of the pivot's text nodes that
    belong to the wrapper."""
    hosted = rows.where("host is not null and html is not null and html != ''").select("host", "h", "html")
    pages = assign(hosted)

    def pack(batches):
        for batch in text_slices(batches, "html"):
            got = [(host, grp, zlib.compress(page.encode("utf-8", "surrogatepass"))) for host, grp, page in zip(
                *(batch.column(c).to_pylist() for c in ("host", "grp", "html")))]
            yield _batch(got, host=pa.string(), grp=pa.int64(), pivot=pa.binary())

    chosen = pages.where("h = pivot_h").select("host", "h").distinct().join(
        pages.select("host", "grp", F.col("pivot_h").alias("h")).distinct(), ["host", "h"])
    pivots = materialize(hosted.join(_small(chosen), ["host", "h"]).mapInArrow(pack, "host string, grp long, pivot binary").groupBy(
        "host", "grp").agg(F.min("pivot").alias("pivot")))
    voters = pages.where("voter").select("host", "h", "copy", "grp")
    paired = hosted.join(_small(voters), ["host", "h"]).join(_small(pivots), ["host", "grp"])

    def run(batches):
        parsed = _Pivots()
        for batch in text_slices(batches, "html"):
            yield _batch([(host, grp, copy, h, *votes(parsed.get(pivot), page)) for host, grp, copy, h, page, pivot in zip(
                *(batch.column(c).to_pylist() for c in ("host", "grp", "copy", "h", "html", "pivot")))],
                host=pa.string(), grp=pa.int64(), copy=pa.int64(), h=pa.int64(), seen=pa.binary(), same=pa.binary())

    # one vote for each distinct text
    ballots = paired.mapInArrow(run, "host string, grp long, copy long, h long, seen binary, same binary").groupBy("host", "grp", "copy").agg(
        F.min(F.struct("h", "seen", "same")).alias("vote")).select("host", "grp", "vote.seen", "vote.same")

    def tally(batches):
        for batch in batches:
            count: dict[tuple[str, int], np.ndarray] = {}
            for host, grp, *bits in zip(*(batch.column(c).to_pylist() for c in ("host", "grp", "seen", "same"))):
                vote = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in bits]).astype(np.int64)
                count[host, grp] = count[host, grp] + vote if (host, grp) in count else vote
            yield _batch([(*key, int(k), int(c[0, k]), int(c[1, k])) for key, c in count.items() for k in np.flatnonzero(c[0])],
                         host=pa.string(), grp=pa.int64(), node=pa.int32(), seen=pa.int64(), same=pa.int64())

    voted = ballots.mapInArrow(tally, "host string, grp long, node int, seen long, same long").groupBy("host", "grp", "node").agg(
        F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    constant = voted.where((F.col("seen") >= MIN_PAGES) & (F.col("same") >= CONSTANT * F.col("seen")))
    # at most the text nodes of one page for each group; of few votes as -1 - number
    template = constant.groupBy("host", "grp").agg(F.collect_list(F.when(F.col("seen") >= MIN_MARKED, F.col("node")).otherwise(-1 - F.col("node"))).alias("template"))
    return pages.select("host", "h", "grp"), materialize(pivots.join(template, ["host", "grp"]))


def _small(rows: DataFrame) -> DataFrame:
    size = F.lit(0)
    for name, kind in rows.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.size(name) * 4 if kind.startswith("array") else F.lit(8))
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    rows = rows.withColumn("h", F.xxhash64("html"))
    grouped, wrappers = induce(rows)
    wrapped = rows.join(_small(grouped.join(wrappers.select("host", "grp"), ["host", "grp"])), ["host", "h"], "left").join(
        _small(wrappers), ["host", "grp"], "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        parsed = _Pivots()
        for batch in text_slices(batches, "html"):
            texts = []
            for page, pivot, template in zip(*(batch.column(c).to_pylist() for c in ("html", "pivot", "template"))):
                texts.append(main_text(page, parsed.get(pivot) if template else None, frozenset(template or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return wrapped.select("page_id", "url", "html", "pivot", "template").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
