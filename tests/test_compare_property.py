"""Tiered compare against a brute-force model on random small inputs."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from provenant.operators import compare as C

SCHEMA = "entry_pos long, file string, data_digest string"


def brute(a, b):
    """The matching rules written out directly: each tier keeps only keys
    that occur exactly once on both sides; null keys are set aside."""
    def name(f):
        parts = [p for p in f.split("/") if p not in ("", ".")]
        return parts[-1] if parts and parts[-1] != ".." else None

    tiers = [lambda e: e[2], lambda e: name(e[1])]
    rest_a, rest_b, out = list(a), list(b), {}
    for t, key in enumerate(tiers):
        ka, kb = {}, {}
        for e in rest_a:
            if key(e) is not None:
                ka.setdefault(key(e), []).append(e)
        for e in rest_b:
            if key(e) is not None:
                kb.setdefault(key(e), []).append(e)
        matched_a, matched_b = set(), set()
        for k in ka:
            if len(ka[k]) == 1 and len(kb.get(k, [])) == 1:
                x, y = ka[k][0], kb[k][0]
                out[("a", x[0])] = ("same" if x[2] == y[2] else "changed", y[0], t)
                matched_a.add(x[0])
                matched_b.add(y[0])
        rest_a = [e for e in rest_a if e[0] not in matched_a]
        rest_b = [e for e in rest_b if e[0] not in matched_b]
    for e in rest_a:
        out[("a", e[0])] = ("undetermined_1", None, None)
    for e in rest_b:
        out[("b", e[0])] = ("undetermined_2", None, None)
    return out


entry = st.tuples(st.sampled_from(["x/", "y/", "", "/"]), st.sampled_from(["f1", "f2", "f3", ".."]),
                  st.sampled_from(["d1", "d2", "d3", "d4"]))


def side(draws):
    return [(i, (p + f) if p != "/" else "/", d) for i, (p, f, d) in enumerate(draws)]


@settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "8")), deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(entry, min_size=0, max_size=7), st.lists(entry, min_size=0, max_size=7))
def test_matches_brute_force(spark, da, db):
    a, b = side(da), side(db)
    want = brute(a, b)
    d = C.record_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    got = {}
    for r in d:
        if r["class"] in ("same", "changed"):
            got[("a", r.entry_pos_1)] = (r["class"], r.entry_pos_2, r.tier_idx)
        elif r["class"] == "undetermined_1":
            got[("a", r.entry_pos_1)] = (r["class"], None, None)
        else:
            got[("b", r.entry_pos_2)] = (r["class"], None, None)
    assert len(d) == len(got)  # every entry exactly once
    assert got == want
