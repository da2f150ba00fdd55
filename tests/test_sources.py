"""Sources and sinks with files in a fresh scratch folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from provenant.operators import records as R
from provenant.sources import bundle as B
from provenant.sources import design as DS
from provenant.sources import files as FS
from provenant.sources import records as RS

FOO_DIGEST = "9b61116853b99ee97b0ed5d499da7e486d77db52fbc60a2357e5cbf6183d418c"
FOO2_DIGEST = "99ff9c6740efe27e636aa330624a28f19ee96f5f844d1eee0192590d07e6c245"


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="provenant-test-")


def write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_includes_scan_keeps_order_and_drops_comments(spark, tmp):
    write(f"{tmp}/inc/record.includes", "# header\nb.txt  # second thought\n\n   \na.txt\n\t c/d.txt \r\n")
    got = FS.scan_includes(spark, f"{tmp}/inc").orderBy("entry_pos").collect()
    assert [(r.entry_pos, r.file) for r in got] == [(0, "b.txt"), (1, "a.txt"), (2, "c/d.txt")]
    assert got[2].full_path == f"{tmp}/inc/c/d.txt"


def test_path_lists(spark, tmp):
    write(f"{tmp}/nl/list.txt", "x/1\ny/2\n")
    write(f"{tmp}/nul/list.txt", "x/1\0\0y/2\0")
    assert [r.path for r in FS.scan_path_list(spark, f"{tmp}/nl").orderBy("entry_pos").collect()] == ["x/1", "y/2"]
    assert [r.path for r in FS.scan_path_list(spark, f"{tmp}/nul", "\0").orderBy("entry_pos").collect()] == ["x/1", "y/2"]
    write(f"{tmp}/bad/list.txt", "x/1\0y\n")
    with pytest.raises(Exception):
        FS.scan_path_list(spark, f"{tmp}/bad").collect()


def test_content_scan_missing_file(spark, tmp):
    write(f"{tmp}/c/a.txt", "hello")
    asked = spark.createDataFrame([(f"{tmp}/c/a.txt",), (f"{tmp}/c/gone.txt",)], "path string")
    got = {r.path: r.present for r in FS.scan_contents(spark, f"{tmp}/c", asked, strict=False).collect()}
    assert got == {f"{tmp}/c/a.txt": True, f"{tmp}/c/gone.txt": False}
    with pytest.raises(Exception):
        FS.scan_contents(spark, f"{tmp}/c", asked, strict=True).collect()


def test_status_scan(spark, tmp):
    for vs, m in [("vs01", "finished"), ("vs02", "running"), ("vs02", "error")]:
        write(f"{tmp}/run/{vs}/status.{m}", "")
    write(f"{tmp}/run/vs03/other.txt", "x")
    got = sorted(tuple(r) for r in FS.scan_status(spark, f"{tmp}/run").collect())
    assert got == [("vs01", "finished"), ("vs02", "error"), ("vs02", "running")]
    vs = spark.createDataFrame([("vs01",), ("vs02",), ("vs03",), ("vs04",)], "vs_id string")
    probed = sorted(tuple(r) for r in FS.probe_status(vs, f"{tmp}/run").collect())
    assert probed == got


def test_record_json_reference_layout(spark, tmp):
    doc = {"metadata": {"record_format": 1, "generated_by": "x", "library_version": "0.3.0",
                        "digest_algorithm": "BLAKE3", "generated_at_utc": "t", "meta_digest": FOO_DIGEST},
           "record_entries": [{"file": "foo.bar", "data_digest": FOO_DIGEST},
                              {"file": "/abs/foo2.bar", "data_digest": FOO2_DIGEST}],
           "digest": FOO_DIGEST}
    write(f"{tmp}/rec/a/record.json", json.dumps(doc, indent=2))
    out = RS.scan_records(spark, f"{tmp}/rec")
    ents = out["entries"].orderBy("entry_pos").collect()
    assert [(e.entry_pos, e.full_path, e.data_digest) for e in ents] == [
        (0, f"{tmp}/rec/a/foo.bar", FOO_DIGEST), (1, "/abs/foo2.bar", FOO2_DIGEST)]
    assert out["records"].first().n_entries == 2


def test_record_json_older_layout_rejected(spark, tmp):
    doc = {"metadata": {"generated_by": "x"}, "record_entries": [{"file": "a", "digest": FOO_DIGEST}],
           "digest": FOO_DIGEST}
    write(f"{tmp}/old/record.json", json.dumps(doc))
    with pytest.raises(Exception):
        RS.scan_records(spark, f"{tmp}/old")["entries"].collect()
    lax = RS.scan_records(spark, f"{tmp}/old", strict=False)["entries"].first()
    assert lax.digest_ok is False


def test_record_sink_round_trip(spark, tmp):
    e = spark.createDataFrame([("r1", 0, "/data/a.txt", FOO_DIGEST), ("r1", 1, "/data/b.txt", FOO2_DIGEST)],
                              "record_id string, entry_pos long, file string, data_digest string")
    recs = R.build_records(e)
    RS.write_records(e, recs, f"{tmp}/out", generated_at_utc="t0")
    back = RS.scan_records(spark, f"{tmp}/out")
    assert back["records"].first().digest == recs.first().digest
    got = [(r.file, r.full_path) for r in back["entries"].orderBy("entry_pos").collect()]
    assert got[0][0] == "../../data/a.txt".replace("../../", "../" * (len(f"{tmp}/out/record_id=r1".strip("/").split("/"))))
    assert got[0][1].endswith("/data/a.txt")


def test_design_scan(spark, tmp):
    write(f"{tmp}/d/design.csv", "sleep_time,Variation_UID,unused\n10,a,x\n1.5,b,y\n1.2,c,z\n")
    got = DS.scan_design(spark, f"{tmp}/d", ["sleep_time"]).orderBy("variation_pos").collect()
    assert [(r.variation_pos, r.sleep_time) for r in got] == [(0, "10"), (1, "1.5"), (2, "1.2")]
    with pytest.raises(ValueError):
        DS.scan_design(spark, f"{tmp}/d", ["missing"])


def test_bundle_collisions(spark, tmp):
    inc = spark.createDataFrame([(0, "a/x.txt"), (1, "b/x.txt"), (2, "b/y.txt")], "entry_pos long, file string")
    con = spark.createDataFrame([("a/x.txt", b"1"), ("b/x.txt", b"2"), ("b/y.txt", b"3")], "path string, content binary")
    plan = B.bundle_plan(inc, con)
    assert [tuple(r) for r in plan["collisions"].collect()] == [("x.txt", 2)]
    assert [r.file_name for r in plan["manifest"].collect()] == ["y.txt"]
    with pytest.raises(ValueError):
        B.write_bundle(inc, con, f"{tmp}/bundle")


@pytest.mark.parametrize("line,path", [
    ("runs/7/mesh.vtk", "runs/7/mesh.vtk"), ("", None), ("#runs/8/log", None), ("runs/9/out.csv# kept for the audit", "runs/9/out.csv"),
    ("   ", None), ("  a/b.txt\t", "a/b.txt"),
])
def test_include_line(spark, line, path):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(FS.parse_include_line("l").alias("p")).first().p == path
