"""Checks that may not be pruned away, values that may not depend on size."""

import hashlib
import json

import pytest

from provenant import workflows as W
from provenant.operators import records as R
from provenant.operators import status as ST
from provenant.operators import steps as S
from provenant.sources import bundle as B
from provenant.sources import files as FS
from provenant.sources import records as RS


def _raises(df):
    with pytest.raises(Exception, match="missing file|bad "):
        df.collect()


@pytest.mark.parametrize("n", [1024, 1025, 5000])
def test_rollup_has_one_rule_for_every_size(spark, n):
    rows = [("r", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, entry_pos long, data_digest string").repartition(7)
    got = R.rollup_digest(df).first()
    assert (got.n_entries, got.digest) == (n, hashlib.sha256(b"".join(bytes.fromhex(r[2]) for r in rows)).hexdigest())


def test_streamed_rollup_groups_and_nulls(spark):
    d = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    rows = [("a", 1, d[1]), ("a", 0, d[0]), ("b", 0, None), ("b", 1, d[2]), (None, 0, d[3])]
    df = spark.createDataFrame(rows, "record_id string, entry_pos long, data_digest string")
    got = {r.record_id: (r.n_entries, r.digest) for r in R._streamed_rollup(df, ["record_id"], "entry_pos", "data_digest").collect()}
    assert got == {"a": (2, hashlib.sha256(bytes.fromhex(d[0] + d[1])).hexdigest()), "b": (2, None),
                   None: (1, hashlib.sha256(bytes.fromhex(d[3])).hexdigest())}


def test_deep_chain_closure_is_whole(spark):
    names = [f"s{i:02d}" for i in range(14)]
    steps = spark.createDataFrame([(n,) for n in names], "step string")
    edges = spark.createDataFrame(list(zip(names[1:], names)), "step string, depends_on string")
    assert S.step_closure(steps, edges).count() == 14 * 15 // 2


def test_record_checks_survive_pruning(spark, tmp_path):
    def write(name, **change):
        doc = {"metadata": {"record_format": 1, "digest_algorithm": "SHA-256"},
               "record_entries": [{"file": "a", "data_digest": "0" * 64}], "digest": "0" * 64} | change
        (tmp_path / name).write_text(json.dumps(doc))
        return str(tmp_path / name)

    bad = RS.scan_records(spark, write("x.json", record_entries=[{"file": "a", "data_digest": "zz"}]))
    _raises(bad["entries"].select("file", "data_digest"))
    _raises(RS.scan_records(spark, write("y.json", digest="xx"))["records"].select("digest"))
    good = RS.scan_records(spark, write("z.json"))
    assert W._algorithm(good["records"]) == "sha256"


def test_missing_files_fail_in_every_column(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    asked = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path / "gone"),)], "path string")
    for c in ("length", "content", "present"):
        _raises(FS.scan_contents(spark, str(tmp_path), asked).select(c))
    inc = spark.createDataFrame([(0, "a"), (1, "gone")], "entry_pos long, file string")
    contents = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    _raises(B.bundle_plan(inc, contents)["manifest"].select("data_digest"))


def test_stray_status_files_are_no_markers(spark):
    vs = spark.createDataFrame([("v1", "s"), ("v2", "s")], "vs_id string, step string")
    marks = spark.createDataFrame([("v1", "log"), ("v2", "finished"), ("v2", "bak")], "vs_id string, marker string")
    got = {r.vs_id: (r.status, r.n_markers) for r in ST.resolve_status(vs, marks).collect()}
    assert got == {"v1": (ST.NOT_INITIALIZED, 0), "v2": ("Finished", 1)}
