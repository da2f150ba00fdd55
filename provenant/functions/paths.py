"""Path column functions (#10-#17), all built from JVM string/array functions.

A path value is the struct ``(kind, base_dir, rel)``:

* ``absolute``            -- ``rel`` starts with '/', no base;
* ``relative``            -- ``rel`` is relative to ``base_dir``;
* ``relative_incomplete`` -- relative, base not known yet;
* ``invalid``             -- empty without a base, or absolute with a base.

Equality is field-wise; nothing is resolved against a file system.
Components follow POSIX rules: repeated '/' collapse, inner '.' parts drop,
a trailing '/' is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = "absolute"
RELATIVE = "relative"
INCOMPLETE = "relative_incomplete"
INVALID = "invalid"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def components(path: str | Column) -> Column:
    """Normal components of a path: split on '/', drop '' and '.'."""
    return F.filter(F.split(_c(path), "/"), lambda x: (x != "") & (x != "."))


def path_kind(path: str | Column, base: str | Column | None = None) -> Column:
    """#10: classify a path given an optional base directory."""
    p = _c(path)
    b = F.lit(None).cast("string") if base is None else _c(base)
    is_abs = p.startswith("/")
    return (
        F.when(p.isNull(), F.lit(None))
        .when((p == "") & b.isNull(), F.lit(INVALID))
        .when(is_abs & b.isNotNull(), F.lit(INVALID))
        .when(is_abs, F.lit(ABSOLUTE))
        .when(b.isNotNull(), F.lit(RELATIVE))
        .otherwise(F.lit(INCOMPLETE))
    )


def make_path(path: str | Column, base: str | Column | None = None) -> Column:
    """Build the path struct; an empty base means the current directory."""
    b = F.lit(None).cast("string") if base is None else _c(base)
    b = F.when(b == "", F.lit("./")).otherwise(b)
    kind = path_kind(path, b)
    return F.struct(
        kind.alias("kind"),
        F.when(kind == RELATIVE, b).alias("base_dir"),
        _c(path).alias("rel"),
    )


def path_complete(p: str | Column, base: str | Column) -> Column:
    """#11: give a base only to paths that lack one."""
    p = _c(p)
    b = _c(base)
    incomplete = p["kind"] == INCOMPLETE
    return F.struct(
        F.when(incomplete, F.lit(RELATIVE)).otherwise(p["kind"]).alias("kind"),
        F.when(incomplete, b).otherwise(p["base_dir"]).alias("base_dir"),
        p["rel"].alias("rel"),
    )


def join_dir(base: str | Column, rel: str | Column) -> Column:
    """``base`` joined with a relative ``rel`` by exactly one '/'."""
    b = _c(base)
    r = _c(rel)
    return F.when(b.endswith("/"), F.concat(b, r)).otherwise(F.concat(b, F.lit("/"), r))


def path_resolve(path: str | Column) -> Column:
    """An absolute path with its '.' and '..' taken away by the text alone
    ('/..' is '/'); other paths as they are."""
    s = _c(path)
    kept = F.aggregate(
        components(s), F.array().cast("array<string>"),
        lambda acc, c: F.when(c == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(c))),
    )
    return F.when(s.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(s)


def path_full(p: str | Column) -> Column:
    """#12: the usable path: absolute as is, relative = base joined with rel.
    Null for incomplete/invalid paths."""
    p = _c(p)
    return (
        F.when(p["kind"] == ABSOLUTE, p["rel"])
        .when(p["kind"] == RELATIVE, join_dir(p["base_dir"], p["rel"]))
    )


def path_compact(p: str | Column) -> Column:
    """#13: the absolute path, or the relative part; null if incomplete."""
    p = _c(p)
    return F.when(p["kind"].isin(ABSOLUTE, RELATIVE), p["rel"])


def file_name(path: str | Column) -> Column:
    """#14 on a plain string: last normal component; null for '/', '.', '..'."""
    last = F.try_element_at(components(path), F.lit(-1))
    return F.when(last != "..", last)


def path_filename(p: str | Column) -> Column:
    """#14 on a path struct (uses the relative part for relative paths)."""
    return file_name(_c(p)["rel"])


def parent_dir(path: str | Column) -> Column:
    """Parent of an absolute path string; null for '/'."""
    comps = components(path)
    n = F.size(comps)
    return F.when(n == 0, F.lit(None)).otherwise(
        F.concat(F.lit("/"), F.array_join(F.slice(comps, 1, n - 1), "/"))
    )


def path_base_dir(p: str | Column) -> Column:
    """#15: parent of an absolute path, base of a relative one, else null."""
    p = _c(p)
    return F.when(p["kind"] == ABSOLUTE, parent_dir(p["rel"])).when(
        p["kind"] == RELATIVE, p["base_dir"]
    )


def path_normalize(path: str | Column) -> Column:
    """#17: one '/' between normal components; a leading '/' or './' kept."""
    s = _c(path)
    body = F.array_join(components(s), "/")
    lead_dot = (s == ".") | s.startswith("./")
    return (
        F.when(s.isNull(), F.lit(None))
        .when(s.startswith("/"), F.concat(F.lit("/"), body))
        .when(lead_dot & (body == ""), F.lit("."))
        .when(lead_dot, F.concat(F.lit("./"), body))
        .otherwise(body)
    )


def path_relativize(path: str | Column, directory: str | Column) -> Column:
    """#16: ``path`` written relative to ``directory`` ('..' where needed).

    Both absolute or both relative; an absolute path against a relative
    directory stays as it is, the reverse has no answer (null).  A '..'
    left in the directory after the common prefix also has no answer.
    """
    p = _c(path)
    d = _c(directory)

    def relative(x: Column) -> Column:
        pc, dc = x["p"], x["d"]
        shortest = F.least(F.size(pc), F.size(dc))
        # length of the common prefix: up to the first component that differs
        differs = F.transform(F.arrays_zip(F.slice(pc, F.lit(1), shortest).alias("p"), F.slice(dc, F.lit(1), shortest).alias("d")),
                              lambda c: c["p"] != c["d"])
        first = F.array_position(differs, True)
        common = F.when(first > 0, first - 1).otherwise(shortest).cast("int")
        up = F.size(dc) - common
        rest_dir = F.slice(dc, common + 1, F.greatest(up, F.lit(0)))
        rest = F.slice(pc, common + 1, F.greatest(F.size(pc) - common, F.lit(0)))
        return F.when(~F.array_contains(rest_dir, ".."), F.array_join(F.concat(F.array_repeat(F.lit(".."), up), rest), "/"))

    # both splits bound to a variable, so that each is made once for a row
    rel = F.get(F.transform(F.array(F.struct(components(p).alias("p"), components(d).alias("d"))), relative), F.lit(0))
    p_abs = p.startswith("/")
    d_abs = d.startswith("/")
    return (
        F.when(p.isNull() | d.isNull(), F.lit(None))
        .when(p_abs & ~d_abs, p)
        .when(~p_abs & d_abs, F.lit(None))
        .otherwise(rel)
    )
