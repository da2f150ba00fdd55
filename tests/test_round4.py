"""Many small files: written, listed and read by the executors."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from provenant.functions import blake3 as B3
from provenant.plans.catalog import QUERIES
from provenant.sources import file_digests as FD
from provenant.sources import files as FS
from provenant.sources import records as RS


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("query", ["content_scan", "file_digests", "file_digests_blake3"])
def test_documents_as_files(spark, tmp_path, query):
    texts = {7: "seven", -8: "minus eight", 9: "two\nlines", None: "no id", 10: "", 11: None, 12: "\u00e9" * 3000}
    sf = _documents(spark, tmp_path, [(k, "s", t) for k, t in texts.items()])
    digest = (lambda b: B3.blake3_hex([b])[0]) if query.endswith("blake3") else (lambda b: hashlib.sha256(b).hexdigest())
    want = {k: ((t or "") + "\n").encode() for k, t in texts.items()}
    got = {r.doc_id: (r.length, r.data_digest) for r in QUERIES[query](spark, sf).collect()}
    assert got == {k: (len(b), digest(b)) for k, b in want.items()}


def test_scan_of_a_folder_is_listed_by_tasks(spark, tmp_path):
    for name in ("a.txt", "deep/er/b.txt", "deep/c.dat", "_hidden/d.txt", "deep/.e.txt", "k=1/_x=2.txt", "deep/empty.txt"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("" if "empty" in name else name)
    found = FS.scan_contents(spark, f"file:{tmp_path}", glob="*.{txt,t[a-z]t}")
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    rel = lambda p: os.path.relpath(p, tmp_path)
    got = {rel(r.path): (r.length, bytes(r.content).decode()) for r in found.collect()}
    assert got == {n: (len(n), n) for n in ("a.txt", "deep/er/b.txt", "k=1/_x=2.txt")}
    every = {rel(r.path): r.size for r in FS.list_files(spark, str(tmp_path)).collect()}
    assert every == {"a.txt": 5, "deep/er/b.txt": 13, "deep/c.dat": 10, "k=1/_x=2.txt": 12, "deep/empty.txt": 0}
    with pytest.raises(Exception, match="missing"):
        FS.scan_contents(spark, f"{tmp_path}/none").collect()


def test_files_of_a_task_lie_in_bounded_folders(spark, tmp_path):
    rows = spark.range(0, 2500, 1, 1).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("line"))
    FS.write_files(rows, str(tmp_path / "out"), "name", "line", spread=True)
    assert sorted(len(os.listdir(tmp_path / "out" / "task=0" / d)) for d in os.listdir(tmp_path / "out" / "task=0")) == [500, 1000, 1000]
    FS.write_files(rows.limit(0), str(tmp_path / "none"), "name", "line")
    assert FS.list_files(spark, str(tmp_path / "none")).count() == 0


def test_segments_of_small_files_are_compressed_together(monkeypatch):
    passes = []
    compress = B3.compress
    monkeypatch.setattr(B3, "compress", lambda *a: passes.append(1) or compress(*a))
    data = [bytes([i % 251]) * (i * 13) for i in range(300)]
    got = FD._segment_nodes([(d, 0, True) for d in data])
    assert len(passes) <= 20
    assert got == B3.blake3_hex(data)


def test_parts_are_named_by_no_driver(spark, tmp_path):
    """Many parts of Records with odd names; a folder pattern; documents in an array."""
    e = spark.range(60).select(F.concat(F.lit("a:b c%"), F.col("id") % 2).alias("record_id"), F.floor(F.col("id") / 2).alias("entry_pos"),
                               F.concat(F.lit("/data/"), "id").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("data_digest"))
    records = e.groupBy("record_id").agg(F.count("*").alias("n_entries"), F.lit("0" * 64).alias("digest"))
    out = str(tmp_path / "out")
    RS.write_records(e, records, out, inline_entries=5, part_entries=4, generated_at_utc="t")
    names = os.listdir(f"{out}/record_id=a%3Ab c%251")
    assert sorted(x for x in names if "=" in x) == [f"part={k}" for k in range(8)]
    for at in (out, f"{out}/record_id=*"):
        back = RS.scan_records(spark, at)
        assert "FileScan json" not in back["entries"]._jdf.queryExecution().executedPlan().toString()
        rows = back["entries"].join(back["records"].select("record_path", "n_entries"), "record_path").collect()
        assert sorted((r.entry_pos, r.full_path, r.n_entries) for r in rows) == sorted((i // 2, f"/data/{i}", 30) for i in range(60))
    one = '{"record_entries": [{"file": "x", "data_digest": "%s"}], "digest": "%s"}' % ("1" * 64, "2" * 64)
    (tmp_path / "two.json").write_text(f"[{one},\n{one}]")
    assert RS.scan_records(spark, str(tmp_path / "two.json"))["records"].count() == 2
