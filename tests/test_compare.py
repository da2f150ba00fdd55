"""Tiered compare: reference unit cases, properties, fixture counts."""

from pyspark.sql import functions as F

from provenant.operators import compare as C
from provenant.plans.fixtures import entries_a, entries_b

from conftest import SF_MID

SCHEMA = "entry_pos long, file string, data_digest string"


def classes(spark, a, b):
    d = C.record_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    return sorted((r["class"], r.entry_pos_1, r.entry_pos_2, r.tier) for r in d.collect())


def test_same_changed_added_removed(spark):
    a = [(0, "x/same.txt", "d1"), (1, "x/changed.txt", "d2"), (2, "x/removed.txt", "d3")]
    b = [(0, "y/same.txt", "d1"), (1, "x/changed.txt", "d9"), (2, "x/added.txt", "d4")]
    assert classes(spark, a, b) == [
        ("changed", 1, 1, "FileName"),
        ("same", 0, 0, "Hash"),
        ("undetermined_1", 2, None, "FileName"),
        ("undetermined_2", None, 2, "FileName"),
    ]


def test_duplicate_digest_falls_to_name_tier(spark):
    a = [(0, "a/one.txt", "d"), (1, "a/two.txt", "d")]
    b = [(0, "b/one.txt", "d"), (1, "b/two.txt", "d")]
    got = classes(spark, a, b)
    assert got == [("same", 0, 0, "FileName"), ("same", 1, 1, "FileName")]


def test_n_to_m_stays_undetermined(spark):
    a = [(0, "a/x.txt", "d1"), (1, "b/x.txt", "d2")]
    b = [(0, "c/x.txt", "d3")]
    got = classes(spark, a, b)
    assert [g[0] for g in got] == ["undetermined_1", "undetermined_1", "undetermined_2"]


def test_null_key_is_set_aside(spark):
    a = [(0, "/", "d1")]
    b = [(0, "/", "d2")]
    d = C.record_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    assert sorted(r["class"] for r in d) == ["undetermined_1", "undetermined_2"]
    assert all(r.tier == "Hash" for r in d)  # the name tier found no key: no attempt


def test_fixture_counts_and_properties(spark):
    a, b = entries_a(spark, SF_MID), entries_b(spark, SF_MID)
    d = C.record_diff(a, b).cache()
    s = C.diff_summary(d).first()
    assert (s.same, s.changed, s.undetermined_1, s.undetermined_2) == (775, 119, 106, 69)
    by_tier = {(r.tier, r["class"]): r["count"] for r in d.where(F.col("tier_idx").isNotNull())
               .groupBy("tier", "class").count().collect()}
    assert by_tier == {("Hash", "same"): 676, ("FileName", "same"): 99, ("FileName", "changed"): 119}
    # every entry of each side in exactly one row
    assert d.where(F.col("entry_pos_1").isNotNull()).select("entry_pos_1").distinct().count() == a.count()
    assert d.where(F.col("entry_pos_2").isNotNull()).select("entry_pos_2").distinct().count() == b.count()
    # compare(A, A) has nothing changed; matching mirrors when sides swap
    aa = C.diff_summary(C.record_diff(a, a)).first()
    assert aa.changed == 0
    ba = C.diff_summary(C.record_diff(b, a)).first()
    assert (ba.same, ba.changed, ba.undetermined_1, ba.undetermined_2) == (775, 119, 69, 106)


def test_report_numbering(spark):
    a = [(5, "x/a.txt", "d1"), (3, "x/b.txt", "d2"), (9, "x/c.txt", "d3")]
    b = [(1, "y/q.txt", "e1")]
    d = C.record_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    rows = C.diff_report_rows(d).where(F.col("class") == "undetermined_1").orderBy("row_num").collect()
    assert [(r.row_num, r.match_key) for r in rows] == [(0, "a.txt"), (1, "b.txt"), (2, "c.txt")]


def test_group_by_filename(spark):
    a = spark.createDataFrame([(0, "x/one.txt", "d1"), (1, "y/two.txt", "d2")], SCHEMA)
    g = {r.group_key: r.n_entries for r in C.group_by_key(a, C.filename_tier()[1]).collect()}
    assert g == {"one.txt": 1, "two.txt": 1}
    b = spark.createDataFrame([(0, "x/same.txt", "d1"), (1, "y/same.txt", "d2")], SCHEMA)
    g = {r.group_key: r.n_entries for r in C.group_by_key(b, C.filename_tier()[1]).collect()}
    assert g == {"same.txt": 2}


def test_three_tiers_custom_key(spark):
    """A user tier after the two built-in ones: the parent folder name."""
    folder = ("Folder", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    tiers = C.default_tiers() + [folder]
    a = [(0, "p/one.txt", "d1"), (1, "q/two.txt", "d2"), (2, "r/x.txt", "d3"), (3, "s/y.txt", "d4")]
    b = [(0, "p/uno.txt", "e1"), (1, "q/zwei.txt", "e2"), (2, "r/x.txt", "e3"), (3, "t/z.txt", "e4")]
    d = C.record_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), tiers)
    got = sorted((r["class"], r.tier, r.entry_pos_1, r.entry_pos_2) for r in d.collect())
    assert got == [
        ("changed", "FileName", 2, 2),
        ("changed", "Folder", 0, 0),
        ("changed", "Folder", 1, 1),
        ("undetermined_1", "Folder", 3, None),
        ("undetermined_2", "Folder", None, 3),
    ]
    rows = C.diff_report_rows(d).where(F.col("class") == "changed").orderBy("row_num").collect()
    assert [(r.tier, r.match_key) for r in rows] == [("FileName", "x.txt"), ("Folder", "p"), ("Folder", "q")]
