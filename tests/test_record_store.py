"""Records of any size, positions that name one entry, lists as input."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from provenant import workflows as W
from provenant.operators import compare as C
from provenant.operators import records as R
from provenant.sources import records as RS

ENTRIES = "record_id string, entry_pos long, file string, data_digest string"


def _entries(spark, n, record_id="r", base="/data"):
    return spark.range(n).select(
        F.lit(record_id).alias("record_id"), F.col("id").alias("entry_pos"),
        F.concat(F.lit(f"{base}/"), F.col("id") % 1000, F.lit("/"), F.col("id"), F.lit(".dat")).alias("file"),
        F.sha2(F.col("id").cast("string"), 256).alias("data_digest"))


def test_three_million_entries_round_trip(spark, tmp_path):
    e = _entries(spark, 3_000_000)
    records = R.build_records(e)
    RS.write_records(e, records, f"{tmp_path}/out")
    back = RS.scan_records(spark, f"{tmp_path}/out")
    head = back["records"].first()
    assert (head.record_id, head.n_entries, head.digest) == ("r", 3_000_000, records.first().digest)
    assert len(glob.glob(f"{tmp_path}/out/record_id=r/part=*")) == 30
    own = back["entries"].select(F.lit("r").alias("record_id"), "entry_pos", F.col("full_path").alias("file"), "data_digest")
    assert R.build_records(own).first().digest == head.digest  # every entry, in order
    some = own.where("entry_pos % 300007 = 5").select("entry_pos", "file").collect()
    assert sorted(map(tuple, some)) == [(i, f"/data/{i % 1000}/{i}.dat") for i in range(5, 3_000_000, 300007)]


def test_small_and_large_records_side_by_side(spark, tmp_path):
    e = _entries(spark, 23, "big").unionByName(_entries(spark, 4, "small"))
    e = e.withColumn("entry_pos", F.col("entry_pos") * 3 + 5)  # gaps: a Record counts from 0
    records = R.build_records(e)
    out = f"{tmp_path}/out"
    RS.write_records(e, records, out, inline_entries=10, part_entries=6, generated_at_utc="t")
    back = RS.scan_records(spark, out)
    assert sorted((r.record_id, r.n_entries) for r in back["records"].collect()) == [("big", 23), ("small", 4)]
    rows = back["entries"].join(back["records"].select("record_path", "record_id"), "record_path")
    got = sorted((r.record_id, r.entry_pos, r.full_path) for r in rows.collect())
    assert got == [(k, i, f"/data/{i}/{i}.dat") for k, n in (("big", 23), ("small", 4)) for i in range(n)]
    # a part lost, doubled, or broken
    part = glob.glob(f"{out}/record_id=big/part=1/*.txt")[0]
    text = open(part).read()
    for change in (text.split("\n", 1)[1], text + text, ""):
        with open(part, "w") as f:
            f.write(change)
        for crc in glob.glob(f"{out}/record_id=big/part=1/.*.crc"):
            os.remove(crc)
        with pytest.raises(ValueError, match="bad parts"):
            RS.scan_records(spark, out)
    with open(part, "w") as f:
        f.write(text.replace("data_digest", "digest", 1))
    with pytest.raises(Exception, match="bad data_digest"):
        RS.scan_records(spark, out)["entries"].collect()
    assert RS.scan_records(spark, out, strict=False)["entries"].where("not digest_ok").count() == 1


def test_a_record_needs_its_digest_and_entries(spark, tmp_path):
    def write(name, doc):
        (tmp_path / name).write_text(json.dumps(doc))
        return RS.scan_records(spark, str(tmp_path / name))

    entries = [{"file": "a", "data_digest": "0" * 64}]
    with pytest.raises(Exception, match="bad digest"):
        write("a.json", {"record_entries": entries})["records"].select("digest").collect()
    with pytest.raises(Exception, match="bad record_entries"):
        write("b.json", {"digest": "0" * 64})["records"].select("n_entries").collect()
    assert write("c.json", {"digest": "0" * 64, "record_entries": []})["records"].first().n_entries == 0


def test_repeated_positions_raise(spark):
    e = spark.createDataFrame([("r", 0, "a", "0" * 64), ("r", 0, "b", "1" * 64)], ENTRIES)
    one = e.limit(1)
    for a, b in ((e, one), (one, e)):
        with pytest.raises(ValueError, match="entry_pos must name one entry"):
            C.match_tiers(a, b)
    with pytest.raises(ValueError, match="entry_pos"):
        C.record_diff(one, one.withColumn("entry_pos", F.lit(None).cast("long")))


def test_tiers_move_only_matched_positions(spark):
    e = _entries(spark, 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rest = C.match_tiers(e, e)["rest_1"]
        plan = rest._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # entries are scanned from the stored frame into the join: only hits are dealt by position
    by_position = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(side" in line]
    assert len(by_position) == 1, "\n".join(plan)
    below = "\n".join(plan[by_position[0]:])
    assert "_pa" in below and rest.count() == 0


def test_compare_folders_of_records(spark, tmp_path):
    for side in ("one", "two"):
        for r in ("x", "y"):
            folder = tmp_path / side / r
            folder.mkdir(parents=True)
            entries = [{"file": f"{r}{i}", "data_digest": f"{ord(r):02x}{i:02x}" * 16} for i in range(2)]
            (folder / "record.json").write_text(json.dumps({"record_entries": entries, "digest": "0" * 64}))
    s = W.compare(spark, f"{tmp_path}/one", f"{tmp_path}/two")["summary"].first()
    assert (s.same, s.changed, s.undetermined_1, s.undetermined_2) == (4, 0, 0, 0)


def test_lists_as_input(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    (tmp_path / "files.lines").write_text(f"a\n{tmp_path}/b\n")
    (tmp_path / "files.nul").write_text("b\0a\0\0")
    for listing, order in (("lines", ["a", "b"]), ("nul", ["b", "a"])):
        out = f"{tmp_path}/out-{listing}"
        assert W.record(spark, f"{tmp_path}/files.{listing}", out, listing=listing).first().n_entries == 2
        rows = RS.scan_records(spark, out)["entries"].orderBy("entry_pos").collect()
        assert [os.path.basename(r.full_path) for r in rows] == order
        assert W.verify(spark, out)["records"].first().status == "VERIFIED"
    with pytest.raises(ValueError, match="unknown listing"):
        W.record(spark, f"{tmp_path}/files.nul", f"{tmp_path}/x", listing="csv")


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "data").write_text("x")
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "none.includes").write_text("# nothing\n\n   \n")
    with pytest.raises(ValueError, match="no files to record.*none.includes"):
        W.record(spark, str(lists), f"{tmp_path}/out")
    (lists / "some.includes").write_text(f"{tmp_path}/data\n")
    with pytest.raises(ValueError, match="no files to record.*none.includes"):
        W.record(spark, str(lists), f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
