"""record -> verify -> change a file -> verify -> compare, on files on disk."""

import os
import tempfile

from provenant import workflows as W
from provenant.functions.paths import path_resolve
from provenant.sources.file_digests import file_digests
from provenant.sources.records import scan_records, write_records

FOO = b"# dummy file file testing\nfoo.bar"
FOO_DIGEST = "9b61116853b99ee97b0ed5d499da7e486d77db52fbc60a2357e5cbf6183d418c"


def test_record_verify_compare(spark):
    tmp = tempfile.mkdtemp(prefix="provenant-wf-")
    os.makedirs(f"{tmp}/data")
    with open(f"{tmp}/data/foo.bar", "wb") as f:
        f.write(FOO)
    with open(f"{tmp}/data/other.txt", "wb") as f:
        f.write(b"x" * 5000)
    with open(f"{tmp}/data/run.includes", "w") as f:
        f.write("# evidence\nfoo.bar\nother.txt  # big\n")
    recs = W.record(spark, f"{tmp}/data/run.includes", f"{tmp}/rec1").collect()
    assert [(r.record_id, r.n_entries) for r in recs] == [("run", 2)]
    v = W.verify(spark, f"{tmp}/rec1")
    assert sorted(r.status for r in v["entries"].collect()) == ["VERIFIED", "VERIFIED"]
    assert v["records"].first().status == "VERIFIED"
    same = W.compare(spark, f"{tmp}/rec1", f"{tmp}/rec1")["summary"].first()
    assert (same.same, same.changed) == (2, 0)
    # change one file: verification fails for it and for the Record
    with open(f"{tmp}/data/other.txt", "wb") as f:
        f.write(b"y" * 5000)
    v2 = W.verify(spark, f"{tmp}/rec1")
    got = {os.path.basename(r.file): r.status for r in v2["entries"].collect()}
    assert got == {"foo.bar": "VERIFIED", "other.txt": "FAILED"}
    assert v2["records"].first().status == "FAILED"
    W.record(spark, f"{tmp}/data/run.includes", f"{tmp}/rec2")
    s = W.compare(spark, f"{tmp}/rec1", f"{tmp}/rec2")["summary"].first()
    assert (s.same, s.changed, s.undetermined_1, s.undetermined_2) == (1, 1, 0, 0)
    entries = {os.path.basename(r.file_1): r.digest_1 for r in W.compare(spark, f"{tmp}/rec1", f"{tmp}/rec2")["diff"]
               .collect()}
    assert entries["foo.bar"] == FOO_DIGEST


def test_files_are_digested_once(spark):
    tmp = tempfile.mkdtemp(prefix="provenant-wf-")
    with open(f"{tmp}/foo.bar", "wb") as f:
        f.write(FOO)
    for algorithm in ("sha256", "blake3"):
        paths = spark.createDataFrame([(f"{tmp}/foo.bar",)], "path string")
        found = file_digests(paths, algorithm)
        before = found.first().data_digest
        with open(f"{tmp}/foo.bar", "ab") as f:
            f.write(b"later")
        assert found.first().data_digest == before  # not read again


def test_bundle_has_its_list_and_record(spark):
    tmp = tempfile.mkdtemp(prefix="provenant-wf-")
    os.makedirs(f"{tmp}/data/sub")
    for name, data in (("foo.bar", FOO), ("sub/b.txt", b"b")):
        with open(f"{tmp}/data/{name}", "wb") as f:
            f.write(data)
    with open(f"{tmp}/data/run.includes", "w") as f:
        f.write("sub/b.txt\nfoo.bar\n")
    out = f"{tmp}/out"
    manifest = W.bundle(spark, f"{tmp}/data/run.includes", f"{tmp}/data", out)
    assert [r.file_name for r in manifest.orderBy("entry_pos").collect()] == ["b.txt", "foo.bar"]
    assert sorted(r.file_name for r in spark.read.parquet(f"{out}/files").collect()) == ["b.txt", "foo.bar"]
    assert sorted(r.value for r in spark.read.text(f"{out}/includes").collect()) == ["b.txt", "foo.bar"]
    entries = scan_records(spark, f"{out}/record")["entries"].orderBy("entry_pos").collect()
    assert [r.full_path for r in entries] == [f"{out}/files/b.txt", f"{out}/files/foo.bar"]


def test_sunk_records_find_their_files_again(spark):
    tmp = tempfile.mkdtemp(prefix="provenant-wf-")
    df = spark.createDataFrame([("r", 0, f"{tmp}/data/a/x", "0" * 64)], "record_id string, entry_pos long, file string, data_digest string")
    records = spark.createDataFrame([("r", 1, "1" * 64)], "record_id string, n_entries long, digest string")
    write_records(df, records, f"{tmp}/rec")
    row = scan_records(spark, f"{tmp}/rec")["entries"].first()
    assert row.file.startswith("../") and row.full_path == f"{tmp}/data/a/x"
    cases = [("/a/../b", "/b"), ("/..", "/"), ("/a/./b/../../c", "/c"), ("a/../b", "a/../b"), ("/a//b", "/a/b"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "p string").select(path_resolve("p").alias("r")).collect()
    assert [r.r for r in got] == [b for _, b in cases]
