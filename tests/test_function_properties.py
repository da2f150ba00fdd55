"""Properties of column functions on random inputs (checked in one Spark
job per property against plain-Python models)."""

import os
import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.functions import paths as P
from provenant.operators import steps as S

N = int(os.environ.get("PROPERTY_EXAMPLES", "8"))

part = st.sampled_from(["a", "b", "cc", ".", ".."])
abs_path = st.lists(st.sampled_from(["a", "b", "cc"]), min_size=0, max_size=4).map(lambda xs: "/" + "/".join(xs))


@settings(max_examples=N, deadline=None)
@given(st.lists(st.tuples(abs_path, abs_path), min_size=1, max_size=20))
def test_relativize_matches_relpath(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, d string")
    got = [r.r for r in df.select(P.path_relativize("p", "d").alias("r")).collect()]
    want = []
    for p, d in pairs:
        rel = posixpath.relpath(p, d)
        want.append("" if rel == "." else rel)
    assert got == want


text = st.lists(st.one_of(st.sampled_from(["{shared}", "{outputs}", "{variables.x}", "{steps.s.inputs}"]),
                          st.text(alphabet="ab/._-", min_size=1, max_size=4)), min_size=1, max_size=6).map("".join)


@settings(max_examples=N, deadline=None)
@given(st.lists(text, min_size=1, max_size=10))
def test_tokens_reassemble_the_text(spark, args):
    df = spark.createDataFrame([("s", i, a) for i, a in enumerate(args)], "step string, arg_pos int, arg string")
    toks = S.template_tokens(df).collect()
    joined = {}
    for t in sorted(toks, key=lambda t: (t.arg_pos, t.tok_pos)):
        joined[t.arg_pos] = joined.get(t.arg_pos, "") + t.token
    assert [joined[i] for i in range(len(args))] == args
    assert S.template_faults(df).count() == 0


def _check_model(s, n=8):
    if not s.startswith("vs"):
        return "missing_prefix"
    h = s[2:]
    if len(h.encode()) != 2 * n:
        return f"invalid_length(expected={2 * n}, actual={len(h.encode())})"
    for i in range(0, len(h), 2):
        pair = h[i:i + 2]
        try:
            int(pair, 16) if not pair.startswith("+") else int(pair[1:], 16)
        except ValueError:
            return "invalid_hex"
        if pair.startswith("+") and not pair[1:]:
            return "invalid_hex"
    return "ok"


@settings(max_examples=N, deadline=None)
@given(st.lists(st.text(alphabet="vs0123456789abcdefABCDEFxz+", min_size=0, max_size=20), min_size=1, max_size=30))
def test_check_id_matches_model(spark, ids):
    from provenant.functions.digests import check_id

    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = [r.v for r in df.select(check_id("varstep", "s").alias("v")).collect()]
    assert got == [_check_model(i) for i in ids]


@settings(max_examples=N, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="0123456789abcdef", min_size=0, max_size=70),
                          st.integers(min_value=0, max_value=80)), min_size=1, max_size=20))
def test_compact_hex_matches_model(spark, cases):
    from pyspark.sql import functions as F

    from provenant.functions.digests import compact_hex

    def model(h, w):
        if len(h) <= w:
            return h
        if w < 5:
            return h[:w]
        front = (w - 3) // 2
        return h[:front] + "..." + h[len(h) - (w - 3 - front):]

    df = spark.createDataFrame(cases, "h string, w int")
    for w in sorted({w for _, w in cases}):
        got = [r.c for r in df.where(F.col("w") == w).select(compact_hex("h", w).alias("c")).collect()]
        assert got == [model(h, w) for h, ww in cases if ww == w]
