"""The reference's verify goldens end to end: files on disk, a Record JSON,
scan, BLAKE3 digests, verification and the one-line report."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from provenant.operators import records as R
from provenant.sources import files as FS
from provenant.sources import records as RS

# Fixture contents and expected report lines of the reference.
FOO = b"# dummy file file testing\nfoo.bar"
FOO2 = b"# dummy file #2\nanother file with different contents for testing"
FOO_DIGEST = "9b61116853b99ee97b0ed5d499da7e486d77db52fbc60a2357e5cbf6183d418c"
FOO2_DIGEST = "99ff9c6740efe27e636aa330624a28f19ee96f5f844d1eee0192590d07e6c245"
RECORD_DIGEST = "c4f70b77e72ef1d87998a172b426336c82f5a9b80cc4869b19e29dae6647c737"
LABEL = "evidence/records/foo_foo2_record.json"  # longer than 32: cut in the report
LINE_2 = "evidence/records/foo_foo2_record VERIFIED c4f70b77e72ef1...9e29dae6647c737"


def test_verify_long_and_compact(spark):
    tmp = tempfile.mkdtemp(prefix="provenant-verify-")
    with open(f"{tmp}/foo.bar", "wb") as f:
        f.write(FOO)
    with open(f"{tmp}/foo2.bar", "wb") as f:
        f.write(FOO2)
    os.makedirs(f"{tmp}/rec")
    doc = {"metadata": None, "digest": RECORD_DIGEST,
           "record_entries": [{"file": "../foo.bar", "data_digest": FOO_DIGEST},
                              {"file": "../foo2.bar", "data_digest": FOO2_DIGEST}]}
    with open(f"{tmp}/rec/record.json", "w") as f:
        json.dump(doc, f)
    scanned = RS.scan_records(spark, f"{tmp}/rec")
    entries = scanned["entries"].select(
        F.lit(LABEL).alias("record_id"), "entry_pos",
        F.col("full_path").alias("file"), "data_digest")
    records = scanned["records"].select(F.lit(LABEL).alias("record_id"), "digest")
    contents = FS.scan_contents(spark, tmp, glob="*.bar")
    checked = R.verify_entries(entries, contents, algorithm="blake3")
    assert sorted(r.status for r in checked.collect()) == ["VERIFIED", "VERIFIED"]
    verified = R.verify_record(checked, records, algorithm="blake3")
    v = verified.first()
    assert (v.status, v.actual) == ("VERIFIED", RECORD_DIGEST)
    line = R.report_verify_compact(verified).first().line
    assert line == LINE_2
    assert verified.count() == 1


def test_compare_golden(spark):
    """The reference's compare golden: two Record documents, one entry same
    by digest, one left undetermined after the file-name tier."""
    tmp = tempfile.mkdtemp(prefix="provenant-compare-")
    r1 = {"metadata": None, "digest": RECORD_DIGEST,
          "record_entries": [{"file": "data/foo.bar", "data_digest": FOO_DIGEST},
                             {"file": "data/foo2.bar", "data_digest": FOO2_DIGEST}]}
    r2 = {"metadata": None, "digest": "2ecb34d99efafac8531a93575adf640155b5c4650d7f530e669a59f146b252c0",
          "record_entries": [{"file": "../foo.bar", "data_digest": FOO_DIGEST}]}
    for name, doc in (("one", r1), ("two", r2)):
        os.makedirs(f"{tmp}/{name}")
        with open(f"{tmp}/{name}/record.json", "w") as f:
            json.dump(doc, f)
    from provenant.operators import compare as C

    e1 = RS.scan_records(spark, f"{tmp}/one")["entries"]
    e2 = RS.scan_records(spark, f"{tmp}/two")["entries"]
    labels = C.diff_labels(C.diff_report_rows(C.record_diff(e1, e2))).orderBy("class", "row_num").collect()
    got = [(r["class"], r.number_label, r.key_label, r.path_1, r.path_2, r.digest_label) for r in labels]
    assert got == [
        ("same", "[0000]", f"(Hash)  {FOO_DIGEST}", "data/foo.bar", "../foo.bar", FOO_DIGEST),
        ("undetermined_1", "[0000]", "(FileName)  foo2.bar", "data/foo2.bar", None, FOO2_DIGEST),
    ]
