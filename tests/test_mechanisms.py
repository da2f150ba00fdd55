"""Closure by doubling, lag with carried rows, steps as a table, keyed sets of
any size, contents by path, and faulty templates."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from provenant.operators import step_table, steps as S, study as ST
from provenant.operators.keyed_sets import keyed_set_digests
from provenant.operators.numbering import with_previous
from provenant.sources import bundle as B
from provenant.sources import files as FS
from provenant.sources import filesystems as FX


def test_long_chain_closure(spark, monkeypatch):
    rounds = []
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: rounds.append(1) or plain(df))
    n = 300
    names = [f"s{i:04d}" for i in range(n)]
    steps = spark.createDataFrame([(x,) for x in names], "step string")
    edges = spark.createDataFrame(list(zip(names[1:], names)), "step string, depends_on string")
    closure = S.step_closure(steps, edges)
    assert closure.count() == n * (n + 1) // 2
    assert closure.where("depth != int(substring(step, 2)) - int(substring(upstream, 2))").isEmpty()
    assert len(rounds) <= 2 * 9 + 1  # two tables a round, 2^9 > 300


def test_closure_of_random_graphs(spark):
    for seed in range(2):
        rnd = random.Random(seed)
        n = 12
        pairs = [(i, j) for i in range(n) for j in range(i) if rnd.random() < 0.25] + [(3, 99)]  # 99 is no step
        depth = {(i, i): 0 for i in range(n)}
        changed = True
        while changed:
            changed = False
            for i, j in pairs:
                for (a, b), d in list(depth.items()) + [((j, j), 0)]:
                    if a == j and depth.get((i, b), -1) < d + 1:
                        depth[i, b], changed = d + 1, True
        steps = spark.createDataFrame([(f"s{i}",) for i in range(n)], "step string")
        edges = spark.createDataFrame([(f"s{i}", f"s{j}") for i, j in pairs], "step string, depends_on string")
        got = {(r.step, r.upstream): r.depth for r in S.step_closure(steps, edges).collect()}
        assert got == {(f"s{a}", f"s{b}"): d for (a, b), d in depth.items()}
    loop = spark.createDataFrame([("s1", "s2"), ("s2", "s3"), ("s3", "s1")], "step string, depends_on string")
    with pytest.raises(ValueError, match="cycle"):
        S.step_closure(steps, loop)


def test_lag_carries_rows_over_tasks(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice(["x", "y", None])) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "unit string, at long, status string").repartition(13)
    got = sorted((r.at, r.prev_status, r.prev_at) for r in with_previous(df, ["unit"], ["at"], ["status", "at"]).collect())
    last, want = {}, []
    for u, i, s in sorted(rows, key=lambda r: r[1]):
        want.append((i, *(last.get(u) or (None, None))))
        last[u] = (s, i)
    assert got == want
    assert with_previous(df.limit(0), ["unit"], ["at"], ["status"]).count() == 0
    plan = with_previous(df, ["unit"], ["at"], ["status"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def _study(spark, groups):
    """Groups of four steps each: a chain of three and one beside it."""
    args = []
    for k in range(groups):
        a, b, c, d = (f"g{k:05d}_{x}" for x in "abcd")
        args += [(a, 0, "{shared}/run.sh"), (a, 1, "{variables.v%d}" % (k % 4)), (b, 0, "{steps.%s.outputs}/m" % a),
                 (b, 1, "x{variables.v%d}y" % ((k + 1) % 4)), (c, 0, "{steps.%s.inputs}/n{outputs}" % b), (d, 0, "plain")]
    steps = spark.createDataFrame(args, "step string, arg_pos int, arg string")
    tokens = S.classify_tokens(S.template_tokens(steps, faults=True))
    names = steps.select("step").distinct()
    edges, svars = S.step_edges(tokens), S.step_variables(tokens)
    uvars = S.upstream_variables(S.step_closure(names, edges), svars)
    return ST.StudyConfig(tokens, edges, svars, uvars, names)


def _design(spark, n):
    return spark.range(n).select(F.col("id").alias("variation_pos"), *[(F.col("id") % (k + 2)).cast("string").alias(f"v{k}") for k in range(4)])


def test_step_table_equals_compiled_steps(spark):
    cfg, design = _study(spark, 3), _design(spark, 30)
    assert not cfg.as_table("sha256")
    pairs = [
        (ST.study_links(design, cfg), step_table.links(design, cfg)),
        (ST.varstep_deps_wide(design, cfg), step_table.deps(design, cfg)),
        (ST.varstep_branches_wide(design, cfg), step_table.direct_branches(design, cfg)),
        (ST.realize_args_wide(design, cfg, "/shared", "/run/"), step_table.realized(design, cfg, "/shared", "/run/")),
    ]
    for compiled, table in pairs:
        assert compiled.columns == table.columns
        a, b = sorted(map(tuple, compiled.collect())), sorted(map(tuple, table.collect()))
        assert a == b and len(a) > 5
    null = design.withColumn("v1", F.when(F.col("variation_pos") != 3, F.col("v1")))
    with pytest.raises(Exception, match="null design value in column v1"):
        step_table.links(null, cfg).collect()


def test_thousands_of_steps(spark):
    cfg, design = _study(spark, 1250), _design(spark, 5)
    assert len(cfg.steps) == 5000 and cfg.as_table("sha256")
    start = time.time()
    frames = [ST.study_links(design, cfg), ST.varstep_deps_wide(design, cfg), ST.varstep_branches_wide(design, cfg),
              ST.realize_args_wide(design, cfg, "/shared", "/run")]
    for f in frames:
        f._jdf.queryExecution().executedPlan()
    assert time.time() - start < 60  # to plan; the compiled form takes far longer
    assert frames[0].count() == 25_000
    step = cfg.steps[5]
    want = ST.varstep_links_wide(design, cfg.upstream, [step]).collect()
    got = frames[0].where(F.col("step") == step).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("arg,fault", [("res}/x", "unopened_close"), ("{variables.v0", "unclosed_open"), ("{a{b}}", "nested_open"),
                                       ("{variable.v0}", None)])
def test_faulty_arguments_are_not_realised(spark, arg, fault):
    steps = spark.createDataFrame([("s", 0, "ok/{variables.v0}"), ("s", 1, arg)], "step string, arg_pos int, arg string")
    tokens = S.classify_tokens(S.template_tokens(steps, faults=True))
    names, edges, svars = steps.select("step").distinct(), S.step_edges(tokens), S.step_variables(tokens)
    uvars = S.upstream_variables(S.step_closure(names, edges), svars)
    cfg, design = ST.StudyConfig(tokens, edges, svars, uvars, names), _design(spark, 2)
    melted = ST.melt_design(design, ["v0"])
    links = ST.study_links(design, cfg)
    forms = [lambda strict: ST.realize_args_wide(design, cfg, "/s", "/r", strict=strict),
             lambda strict: step_table.realized(design, cfg, "/s", "/r", strict),
             lambda strict: ST.realize_args(tokens, links, melted, "/s", "/r", strict)]
    for form in forms:
        with pytest.raises(Exception, match="faulty argument 1|cannot realise token"):
            form(True).select("arg").collect()
        assert {(r.arg_pos, r.arg) for r in form(False).collect()} == {(0, "ok/0"), (0, "ok/1"), (1, None)}
    columns = spark.createDataFrame([("v0",)], "variable string")
    plain = S.check_config(names, edges, svars, columns).first()
    told = S.check_config(names, edges, svars, columns, S.template_faults(steps)).first()
    assert plain.status == "PASS" and told.status == "FAIL"
    assert (fault or "unknown_word {variable.v0}") in told.failures


def test_keyed_sets_of_any_size(spark):
    n = 300_000
    big = spark.range(n).select(F.lit("big").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") * 7).alias("value"))
    rows = [("small", "b", 2), ("small", "a", 1), ("twice", "a", 1), ("twice", "a", 2), (None, "z", None)]
    df = big.unionByName(spark.createDataFrame(rows, "k string, name string, value long")).repartition(9)
    body = "".join(f"{name}{v}" for name, v in sorted((f"n{i}", i * 7) for i in range(n)))
    want = {"big": (n, hashlib.sha256(b"p" + body.encode()).hexdigest()[:16]), "small": (2, hashlib.sha256(b"pa1b2").hexdigest()[:16]),
            "twice": (2, None), None: (1, hashlib.sha256(b"pz").hexdigest()[:16])}
    for in_row in (10_000, 1, 1_000_000):
        got = {r.k: (r.n_items, r.set_digest) for r in keyed_set_digests(df, ["k"], "p", "name", "value", in_row=in_row).collect()}
        assert got == want
        df = df if in_row != 1 else df.where("k != 'big' or k is null")
        want = want if in_row != 1 else {k: v for k, v in want.items() if k != "big"}


def test_contents_are_read_by_path(spark, tmp_path, monkeypatch):
    for name in ("a b%20.txt", "c.txt", "unasked.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").write_text("")
    names = ["a b%20.txt", "c.txt", "empty", "gone"]
    asked = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names] + [("/etc/hostname",), (None,)], "path string")
    before = os.stat(tmp_path / "unasked.txt").st_atime_ns
    got = FS.scan_contents(spark, str(tmp_path), asked, strict=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "binaryFile" not in plan
    rows = {r.path: (r.content, r.present) for r in got.collect()}
    assert rows == {f"{tmp_path}/a b%20.txt": (b"a b%20.txt", True), f"{tmp_path}/c.txt": (b"c.txt", True), f"{tmp_path}/empty": (b"", True),
                    f"{tmp_path}/gone": (None, False), "/etc/hostname": (None, False), None: (None, False)}
    assert os.stat(tmp_path / "unasked.txt").st_atime_ns == before
    root = FX.default_root(spark)
    assert root == FX.LOCAL and FX.open_path("file:///x/y z", root)[1] == FX.open_path("/x/y z", root)[1] == "/x/y z"
    monkeypatch.setitem(FX._CACHE, "hdfs://nn:8020", ("fs", "/"))
    assert FX.open_path("/data/x", "hdfs://nn:8020") == ("fs", "/data/x")  # no scheme: the default file system
    monkeypatch.setitem(FX._CACHE, "s3://bucket", ("s3", "bucket"))
    assert FX.open_path("s3://bucket/k/x", "hdfs://nn:8020") == ("s3", "bucket/k/x")


def test_bundle_moves_no_bytes(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for name in ("x", "y"):
        (data / name).write_text(name * 10)
    (tmp_path / "outside").write_text("o")
    inc = spark.createDataFrame([(0, f"{data}/y"), (1, f"{data}/x")], "entry_pos long, file string")
    manifest = B.write_bundle_files(inc, f"{tmp_path}/out", under=str(data))
    assert [(r.entry_pos, r.file_name) for r in manifest.orderBy("entry_pos").collect()] == [(0, "y"), (1, "x")]
    assert {r.file_name: bytes(r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"x": b"x" * 10, "y": b"y" * 10}
    more = inc.unionByName(spark.createDataFrame([(2, f"{tmp_path}/outside")], inc.schema))
    with pytest.raises(Exception, match="missing file"):
        B.write_bundle_files(more, f"{tmp_path}/out2", under=str(data)).collect()
    (data / "sub").mkdir()
    (data / "sub" / "x").write_text("other")
    same = inc.unionByName(spark.createDataFrame([(2, f"{data}/sub/x")], inc.schema))
    with pytest.raises(ValueError, match="equal base names"):
        B.write_bundle_files(same, f"{tmp_path}/out3", under=str(data))
