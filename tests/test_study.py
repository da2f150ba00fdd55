"""Design expansion and status on the FIXTURES study over ``part``."""

from pyspark.sql import functions as F

from provenant.operators import status as STS
from provenant.operators import study as ST
from provenant.plans.study_fixtures import markers, study_model

from conftest import SF_MID


def test_expansion_counts(spark):
    m = study_model(spark, SF_MID)
    assert m["vids"].count() == 2000
    assert ST.variations(m["vids"]).count() == 1745
    per_step = {r.step: r.n_varsteps for r in ST.varstep_sharing(m["links"]).collect()}
    assert per_step == {"prep": 25, "solve": 988, "post": 988, "audit": 1745, "init": 1}


def test_varstep_ids_order_insensitive(spark):
    m = study_model(spark, SF_MID)
    shuffled = m["melted"].orderBy(F.rand(7))
    again = ST.varstep_links(shuffled, m["uvars"], m["names"])
    diff = again.exceptAll(m["links"]).count() + m["links"].exceptAll(again).count()
    assert diff == 0


def test_readiness_rules(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "vs_id string, dep_vs_id string")
    st = spark.createDataFrame([("a", "s", "Finished"), ("b", "s", "Running"), ("c", "s", "Not-Initialized")],
                               "vs_id string, step string, status string")
    got = {r.vs_id: r.ready for r in STS.readiness(deps, st).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_transitions(spark):
    log = spark.createDataFrame(
        [("u", 1, "Not-Running"), ("u", 2, "Running"), ("u", 3, "Running"), ("u", 4, "Not-Initialized"),
         ("v", 1, "Running")], "vs_id string, ts long, status string")
    got = [(r.vs_id, r.ts, r.verdict) for r in STS.check_transitions(log).orderBy("vs_id", "ts").collect()]
    assert got == [("u", 1, "ok"), ("u", 2, "ok"), ("u", 3, "bad_start"), ("u", 4, "to_uninitialized"),
                   ("v", 1, "bad_start")]


def test_multiple_markers(spark):
    vs = spark.createDataFrame([("vs30", "s"), ("vs11", "s"), ("vs00", "s")], "vs_id string, step string")
    got = {r.vs_id: r.status for r in STS.resolve_status(vs, markers(vs)).collect()}
    assert got == {"vs30": "Multiple-Statuses", "vs11": "Not-Running", "vs00": "Not-Initialized"}


def test_wide_pass_equals_join_plans(spark):
    """The one-pass (configuration compiled into expressions) operators give
    the same rows as the join-based ones."""
    m = study_model(spark, SF_MID)

    def same(a, b):
        return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

    assert same(ST.varstep_deps_wide(m["design"], m["config"]), ST.varstep_deps(m["links"], m["edges"]))
    assert same(ST.varstep_branches_wide(m["design"], m["config"]),
                ST.varstep_branches(m["links"], m["melted"], m["svars"]))
    assert same(ST.realize_args_wide(m["design"], m["config"], "/s", "/r"),
                ST.realize_args(m["tokens"], m["links"], m["melted"], "/s", "/r"))
    generic_ids = ST.variation_ids(m["melted"])
    assert same(m["vids"], generic_ids)
