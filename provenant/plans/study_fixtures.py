"""Study inputs: step tables, the design from ``part``, markers and a log.

Two step tables:

* ``study_steps`` -- the small study of FIXTURES C (a diamond plus a step
  without variables), expanded over the design taken from ``part``: the
  design is what grows;
* ``graph_steps`` -- a step graph derived from ``region`` / ``nation`` /
  ``supplier`` (one step per row, dependencies along the foreign keys), so
  the template and graph queries grow with the data too.  Some supplier
  steps carry a faulty argument, chosen by key, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import steps as S
from provenant.operators import study as ST
from provenant.plans.fixtures import table

SHARED_DIR = "/study/shared"
RUN_DIR = "/study/run"

STUDY_STEPS = [
    ("prep", 0, "{shared}/prep.sh"),
    ("prep", 1, "{variables.brand}"),
    ("prep", 2, "{outputs}/mesh"),
    ("solve", 0, "{steps.prep.outputs}/mesh"),
    ("solve", 1, "{variables.size}"),
    ("solve", 2, "{outputs}/res"),
    ("post", 0, "{steps.solve.outputs}/res"),
    ("post", 1, "{outputs}/rep"),
    ("audit", 0, "{steps.prep.outputs}/mesh"),
    ("audit", 1, "{steps.solve.outputs}/res"),
    ("audit", 2, "{variables.type}"),
    ("init", 0, "{shared}/init.sh"),
]


def study_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STUDY_STEPS, "step string, arg_pos int, arg string")


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(variation_pos, brand, type, size)`` from ``part``, all strings."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("variation_pos"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").cast("string").alias("size"),
    )


def design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [c for c in design(spark, sf_dir).columns if c != "variation_pos"]
    return spark.createDataFrame([(c,) for c in cols], "variable string")


def graph_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(step, arg_pos, arg)``: region -> nation -> supplier steps."""
    def args(df: DataFrame, step: F.Column, items: list[F.Column]) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(i).alias("arg_pos"), a.alias("arg")) for i, a in enumerate(items)])
        return df.select(step.alias("step"), F.explode(arr).alias("a")).select("step", "a.arg_pos", "a.arg")

    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier")
    region = args(r, F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")),
                  [F.lit("{shared}/prep.sh"), F.lit("{variables.brand}"), F.lit("{outputs}/mesh")])
    nation = args(n, F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")),
                  [F.concat(F.lit("{steps.region_"), F.col("n_regionkey").cast("string"), F.lit(".outputs}/mesh")),
                   F.lit("{variables.size}"), F.lit("{outputs}/res")])
    sk = F.col("s_suppkey").cast("string")
    nk = F.col("s_nationkey").cast("string")
    odd = (
        F.when(F.col("s_suppkey") % 10 == 1, F.concat(F.lit("{steps.nation_"), nk, F.lit(".outputs/res")))
        .when(F.col("s_suppkey") % 10 == 2, F.lit("res}/x"))
        .when(F.col("s_suppkey") % 10 == 3, F.lit("{a{b}}"))
        .when(F.col("s_suppkey") % 10 == 4, F.lit("{variable.size}"))
        .when(F.col("s_suppkey") % 10 == 5, F.concat(F.lit("{steps.missing_"), sk, F.lit(".outputs}/in")))
        .when(F.col("s_suppkey") % 10 == 6, F.lit("{variables.colour}"))
        .otherwise(F.lit("{inputs}/log"))
    )
    supplier = args(s, F.concat(F.lit("supplier_"), sk),
                    [F.concat(F.lit("{steps.nation_"), nk, F.lit(".outputs}/res")),
                     F.lit("{variables.type}"), F.lit("{outputs}/rep"), odd])
    return region.unionByName(nation).unionByName(supplier)


def graph_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    steps = graph_steps(spark, sf_dir)
    tokens = S.classify_tokens(S.template_tokens(steps))
    names = steps.select("step").distinct()
    edges = S.step_edges(tokens)
    return {"steps": steps, "tokens": tokens, "names": names, "edges": edges,
            "variables": S.step_variables(tokens)}


def study_model(spark: SparkSession, sf_dir: str, algorithm: str = "sha256") -> dict[str, DataFrame]:
    """Everything the study queries use, as lazy plans (the closure of the
    small step table is computed once, eagerly)."""
    steps = study_steps(spark)
    tokens = S.classify_tokens(S.template_tokens(steps, faults=True))
    names = steps.select("step").distinct()
    edges = S.step_edges(tokens)
    svars = S.step_variables(tokens)
    closure = S.step_closure(names, edges)
    uvars = S.upstream_variables(closure, svars)
    cfg = ST.StudyConfig(tokens, edges, svars, uvars, names)  # one small collect
    used = cfg.input_variables()
    d = design(spark, sf_dir)
    melted = ST.melt_design(d, used)
    # ids as projections of the wide design row: the step configuration is
    # small (checked) and known to the driver, so nothing is grouped; the
    # links are a projection too -- cheaper to recompute than to store
    links = ST.study_links(d, cfg, algorithm)
    vids = ST.variation_ids_wide(d, used, algorithm)
    return {"steps": steps, "tokens": tokens, "names": names, "edges": edges, "svars": svars,
            "closure": closure, "uvars": uvars, "melted": melted, "links": links, "vids": vids,
            "levels": S.step_levels(closure), "design": d, "config": cfg}


def markers(vsteps: DataFrame) -> DataFrame:
    """``(vs_id, marker)``: one marker from the first hex digit of the id
    (0 none, 1 notrunning, 2 running, 3 finished, 4 error, modulo 5) and a
    second, conflicting one where the last hex digit is 0."""
    code = (F.instr(F.lit("0123456789abcdef"), F.substring("vs_id", 3, 1)) - 1) % 5
    first = F.when(code == 1, "notrunning").when(code == 2, "running").when(code == 3, "finished").when(
        code == 4, "error")
    second = F.when(F.substring("vs_id", -1, 1) == "0",
                    F.when(first == "notrunning", F.lit("running")).otherwise(F.lit("notrunning")))
    m = vsteps.select("vs_id", F.array(first, F.when(first.isNotNull(), second)).alias("ms"))
    return m.select("vs_id", F.explode("ms").alias("marker")).where(F.col("marker").isNotNull())


# The event types of ``events`` read as status changes.
EVENT_STATUS = {
    "signup": "Not-Running",
    "view": "Running",
    "purchase": "Finished",
    "error": "Error",
    "click": "Not-Initialized",
}


def transition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, user_id, ts, status)`` from ``events``."""
    ev = table(spark, sf_dir, "events")
    st = F.lit(None).cast("string")
    for k, v in EVENT_STATUS.items():
        st = F.when(F.col("event_type") == k, F.lit(v)).otherwise(st)
    return ev.select("event_id", "user_id", "ts", st.alias("status"))
