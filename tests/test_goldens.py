"""Goldens of the reference (BLAKE3 digests, roll-ups, ids, metadata)."""

from pyspark.sql import functions as F

from provenant.functions import digests as D
from provenant.functions.blake3 import blake3_hex
from provenant.operators import records as R

# The two fixture files' bytes and the digests the reference
# records for them.
FOO = b"# dummy file file testing\nfoo.bar"
FOO_DIGEST = "9b61116853b99ee97b0ed5d499da7e486d77db52fbc60a2357e5cbf6183d418c"
FOO2_DIGEST = "99ff9c6740efe27e636aa330624a28f19ee96f5f844d1eee0192590d07e6c245"
ROLL_FOO = "2ecb34d99efafac8531a93575adf640155b5c4650d7f530e669a59f146b252c0"
ROLL_FOO_FOO2 = "c4f70b77e72ef1d87998a172b426336c82f5a9b80cc4869b19e29dae6647c737"
ROLL_FOO2_FOO = "31d5a2120a7317710d7b93fb7298b6e4b6ae5ff595afc1422d792edc2bde9f12"
META = ("1", "provenant", "0.1.0", "BLAKE3", "2026-05-11 8:13:47.160692 +00:00:00")


def test_blake3_published_vectors():
    assert blake3_hex([b""])[0] == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex([b"abc"])[0] == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_blake3_file_digest():
    assert blake3_hex([FOO])[0] == FOO_DIGEST


def test_blake3_in_spark(spark):
    df = spark.createDataFrame([(FOO,)], "c binary")
    assert df.select(D.content_digest("c", algorithm="blake3").alias("d")).first().d == FOO_DIGEST


def test_rollup_order_matters(spark):
    df = spark.createDataFrame(
        [("a", 0, FOO_DIGEST), ("b", 0, FOO_DIGEST), ("b", 1, FOO2_DIGEST), ("c", 0, FOO2_DIGEST), ("c", 1, FOO_DIGEST)],
        "record_id string, entry_pos long, data_digest string")
    got = {r.record_id: r.digest for r in R.rollup_digest_blake3(df).collect()}
    assert got == {"a": ROLL_FOO, "b": ROLL_FOO_FOO2, "c": ROLL_FOO2_FOO}


def test_blake3_rollup_large_equals_flat(spark):
    import hashlib

    rows = [("big", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id string, entry_pos long, data_digest string")
    got = R.rollup_digest_blake3(df).first().digest
    flat = blake3_hex([b"".join(bytes.fromhex(d) for _, _, d in rows)])[0]
    assert got == flat


def test_metadata_digest(spark):
    # the fields joined by single spaces, in this order, then digested
    df = spark.createDataFrame([META], "f string, g string, v string, a string, t string")
    got = df.select(D.metadata_digest("f", "g", "v", "a", "t", algorithm="blake3").alias("d")).first().d
    assert got == blake3_hex([" ".join(META).encode()])[0]


def test_ids_like_the_reference(spark):
    # variation {sleep_time: 10} and VarStep RunSolver over the same branch
    df = spark.createDataFrame([(0, "sleep_time", "10")], "pos int, name string, value string")
    v = df.groupBy("pos").agg(
        D.render_id("variation", D.keyed_set_digest(D.VARIATION_PREFIX, "name", "value", algorithm="blake3")).alias("v"),
        D.render_id("varstep", D.keyed_set_digest("RunSolver", "name", "value", algorithm="blake3")).alias("vs"),
    ).first()
    assert v.v == "V1b42bb03936edb68"
    assert v.vs == "vs2d82b4a357a90634"


def test_sha256_rollup_flat_definition(spark):
    import hashlib

    df = spark.createDataFrame([("r", 1, FOO_DIGEST), ("r", 0, FOO2_DIGEST)],
                               "record_id string, entry_pos long, data_digest string")
    got = R.rollup_digest(df).first().digest
    assert got == hashlib.sha256(bytes.fromhex(FOO2_DIGEST) + bytes.fromhex(FOO_DIGEST)).hexdigest()


def test_sha256_tree_rollup(spark):
    import hashlib

    ds = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    df = spark.createDataFrame([("r", i, d) for i, d in enumerate(ds)], "record_id string, entry_pos long, data_digest string")
    got = R.rollup_digest(df, fanout=16).first().digest

    def h(xs):
        return hashlib.sha256(b"".join(bytes.fromhex(x) for x in xs)).hexdigest()

    level1 = [h(ds[i:i + 16]) for i in range(0, 40, 16)]
    assert got == h(level1)


def test_compact_hex():
    from provenant.functions.digests import compact_hex  # noqa: F401


def test_compact_hex_examples(spark):
    df = spark.createDataFrame([("abcdef1234567890",)], "h string")
    r = df.select(D.compact_hex("h", 12).alias("a"), D.compact_hex("h", 16).alias("b"),
                  D.compact_hex("h", 3).alias("c")).first()
    assert (r.a, r.b, r.c) == ("abcd...67890", "abcdef1234567890", "abc")


def test_check_id(spark):
    rows = [("vsad2adb0860fe8343",), ("ad2adb0860fe8343",), ("vsad2adb0860fe834",), ("vsad2adb0860fe834z",),
            ("vsAD2ADB0860FE8343",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.v for r in df.select(D.check_id("varstep", "s").alias("v")).collect()]
    assert got == ["ok", "missing_prefix", "invalid_length(expected=16, actual=15)", "invalid_hex", "ok"]


def test_study_ids_like_the_reference(spark):
    """The reference's example study (three chained steps, one variable)
    expanded with BLAKE3 gives the ids its documentation shows."""
    from provenant.operators import steps as S
    from provenant.operators import study as ST

    # The example study's step arguments and design.
    steps = spark.createDataFrame([
        ("Preprocess", 0, "{shared}/scripts/preprocess.sh"),
        ("Preprocess", 1, "{variables.sleep_time}"),
        ("Preprocess", 2, "{outputs}/subject.mesh"),
        ("RunSolver", 0, "{shared}/scripts/solve.sh"),
        ("RunSolver", 1, "{steps.Preprocess.outputs}/subject.mesh"),
        ("RunSolver", 2, "{shared}/solver_settings.json"),
        ("RunSolver", 3, "{outputs}/results.json"),
        ("Postprocess_stress", 0, "{shared}/scripts/postprocess.sh"),
        ("Postprocess_stress", 1, "{steps.RunSolver.outputs}/output_RunSolver.json"),
        ("Postprocess_stress", 2, "{outputs}/report.md"),
    ], "step string, arg_pos int, arg string")
    design = spark.createDataFrame([(0, "1.2"), (1, "1.5"), (2, "10")], "variation_pos long, sleep_time string")
    tokens = S.classify_tokens(S.template_tokens(steps))
    names = steps.select("step").distinct()
    edges = S.step_edges(tokens)
    svars = S.step_variables(tokens)
    uvars = S.upstream_variables(S.step_closure(names, edges), svars)
    cfg = ST.StudyConfig(tokens, edges, svars, uvars, names)
    vids = {r.variation_pos: r.v_id for r in ST.variation_ids_wide(design, ["sleep_time"], "blake3").collect()}
    assert vids[2] == "V1b42bb03936edb68" and vids[1] == "V03f41d5e9f2c560b"
    links = {(r.variation_pos, r.step): r.vs_id
             for r in ST.varstep_links_wide(design, cfg.upstream, cfg.steps, "blake3").collect()}
    assert links[(2, "Preprocess")] == "vsd7f88979d321342c"
    assert links[(2, "RunSolver")] == "vs2d82b4a357a90634"
    assert links[(2, "Postprocess_stress")] == "vs8e80463615a48d20"
    assert links[(0, "RunSolver")] == "vs789bff3b753fb971"
    assert links[(0, "Postprocess_stress")] == "vsa99d15d276a20b43"
