"""Digest and identifier column functions (JVM-side, codegen'd).

Digests are lower-case hex strings.  The default algorithm is SHA-256
(``sha2``), which any SQL engine can recompute; BLAKE3, the algorithm the
reference records use, is available through an Arrow-batched UDF in
:mod:`provenant.functions.blake3`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes and digest sizes (bytes) that must match the
# reference's rendering of identifiers.
ID_PREFIXES = {"varstep": "vs", "variation": "V", "branch": "Br"}
ID_DIGEST_BYTES = 8
RECORD_DIGEST_BYTES = 32
# Fixed value: prefix of the variation keyed-set digest.
VARIATION_PREFIX = "variation"

ALGORITHMS = ("sha256", "blake3")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_digest(col: str | Column, n_bytes: int = RECORD_DIGEST_BYTES,
               algorithm: str = "sha256") -> Column:
    """Hex digest of a STRING/BINARY column, truncated to ``n_bytes``."""
    if algorithm == "sha256":
        full = F.sha2(_c(col), 256)
    elif algorithm == "blake3":
        from provenant.functions.blake3 import blake3_hex_udf

        full = blake3_hex_udf(_c(col).cast("binary"))
    else:
        raise ValueError(f"unknown digest algorithm {algorithm!r}; use one of {ALGORITHMS}")
    if n_bytes >= 32:
        return full
    return F.substring(full, 1, 2 * n_bytes)


def content_digest(col: str | Column, n_bytes: int = RECORD_DIGEST_BYTES,
                   algorithm: str = "sha256") -> Column:
    """#18: digest of every byte of the content."""
    return hex_digest(col, n_bytes, algorithm)


def string_digest(col: str | Column, n_bytes: int = ID_DIGEST_BYTES,
                  algorithm: str = "sha256") -> Column:
    """#19: digest of the UTF-8 bytes of a string."""
    return hex_digest(col, n_bytes, algorithm)


def branch_id(name: str | Column, value: str | Column, algorithm: str = "sha256",
              separator: str = "") -> Column:
    """#20: ``Br`` + digest8(name || value).  No separator by default (parity)."""
    pre = F.concat_ws(separator, _c(name), _c(value)) if separator else F.concat(_c(name), _c(value))
    return render_id("branch", string_digest(pre, ID_DIGEST_BYTES, algorithm))


def keyed_set_preimage(prefix: str | Column, name: str | Column, value: str | Column,
                       separator: str = "") -> Column:
    """Aggregate: prefix || name1 || value1 || ... with names in byte order.

    The group is one keyed set (one design row, one VarStep), so its size is
    the number of variables; input row order does not matter.  For sets of any
    size see :mod:`provenant.operators.keyed_sets`.
    """
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    pairs = F.array_sort(F.collect_list(F.struct(_c(name).alias("n"), _c(value).alias("v"))))
    body = F.array_join(F.transform(pairs, lambda x: F.concat_ws(separator, x["n"], x["v"])), separator)
    return F.concat_ws(separator, F.any_value(pre), body) if separator else F.concat(F.any_value(pre), body)


def keyed_set_digest(prefix: str | Column, name: str | Column, value: str | Column,
                     n_bytes: int = ID_DIGEST_BYTES, algorithm: str = "sha256",
                     separator: str = "") -> Column:
    """#21 aggregate: digest of the keyed-set preimage (order-insensitive).

    A ``str`` prefix is a literal; pass a Column for a per-group prefix.
    A set in which a name repeats has no id (null; see #22)."""
    names = F.collect_list(_c(name))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, hex_digest(keyed_set_preimage(prefix, name, value, separator), n_bytes, algorithm))


def metadata_digest(record_format: str | Column, generated_by: str | Column,
                    library_version: str | Column, digest_algorithm: str | Column,
                    generated_at_utc: str | Column, algorithm: str = "sha256") -> Column:
    """#24: digest of "format by version algorithm time" joined by single spaces."""
    text = F.concat_ws(
        " ",
        _c(record_format).cast("string"),
        _c(generated_by),
        _c(library_version),
        _c(digest_algorithm),
        _c(generated_at_utc),
    )
    return hex_digest(text, RECORD_DIGEST_BYTES, algorithm)


def compact_hex(col: str | Column, width: int) -> Column:
    """#25: full hex if it fits; narrower than 5 gives a plain prefix;
    else front + '...' + back with front = (width-3)//2."""
    c = _c(col)
    if width < 5:
        short = F.substring(c, 1, width)
    else:
        front = (width - 3) // 2
        back = (width - 3) - front
        short = F.concat(F.substring(c, 1, front), F.lit("..."), F.substring(c, -back, back) if back > 0 else F.lit(""))
    return F.when(F.length(c) <= width, c).otherwise(short)


def render_id(kind: str, hex_col: str | Column) -> Column:
    """#26: prefix + hex for ``varstep`` / ``variation`` / ``branch`` ids."""
    return F.concat(F.lit(ID_PREFIXES[kind]), _c(hex_col))


def check_id(kind: str, col: str | Column, n_bytes: int = ID_DIGEST_BYTES) -> Column:
    """#27: 'ok', 'missing_prefix', 'invalid_length(expected=E, actual=A)' or
    'invalid_hex', checked in that order.  Lengths count bytes; each byte is
    two characters parsed base 16 (an optional leading '+' is accepted by the
    reference's integer parser, so '+f' is a valid byte)."""
    c = _c(col)
    prefix = ID_PREFIXES[kind]
    hexpart = F.substring(c, len(prefix) + 1, 1 << 30)
    expected = 2 * n_bytes
    actual = F.octet_length(hexpart)
    return (
        F.when(c.isNull(), F.lit(None))
        .when(~c.startswith(prefix), F.lit("missing_prefix"))
        .when(actual != expected, F.format_string(f"invalid_length(expected={expected}, actual=%d)", actual))
        .when(hexpart.rlike(r"^([0-9a-fA-F]{2}|\+[0-9a-fA-F])*$"), F.lit("ok"))
        .otherwise(F.lit("invalid_hex"))
    )
