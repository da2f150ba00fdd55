"""Templates and the step graph (#47-#55).

A study's steps arrive as a table ``steps(step, arg_pos, arg)``: one row per
templated run argument.  Template text is split with regular expressions
(no character parser): ``{...}`` tokens and literal runs between them.

Token grammar (what may stand between braces):

* ``inputs`` / ``outputs``            -- the step's own folders
* ``shared``                          -- the study's shared folder
* ``variables.<name>``                -- a design column
* ``steps.<step>.inputs|outputs``     -- another step's folders
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.session import materialize

# The words of the template grammar.
LOC_WORDS = ("inputs", "outputs")
SHARED_WORD = "shared"
VARIABLES_WORD = "variables"
STEPS_WORD = "steps"

TOKEN_PATTERN = r"(\{[^{}]*\}|[^{}]+)"

# Fault kinds, in the order a left-to-right scan meets them.
UNOPENED, NESTED, UNCLOSED, UNKNOWN = "unopened_close", "nested_open", "unclosed_open", "unknown_word"

MAX_BROADCAST_EDGES = 1_000_000
# closure rounds of paths up to this length are cached, longer ones written
WRITTEN_FROM = 16
# a step's failures are listed up to this many; all are counted
MAX_LISTED_FAILURES = 10_000


def brace_fault(arg: str | Column) -> Column:
    """What is wrong with an argument's braces; null if nothing is.

    Told by the brace skeleton: after removing leading ``{}`` pairs, a ``}``
    first is a close without an open, ``{{`` an open inside an open, a lone
    ``{`` an open never closed."""
    c = F.col(arg) if isinstance(arg, str) else arg
    rest = F.regexp_replace(F.regexp_replace(c, r"[^{}]", ""), r"^(\{\})*", "")
    return (
        F.when(rest == "", F.lit(None))
        .when(rest.startswith("}"), F.lit(UNOPENED))
        .when(rest.startswith("{{"), F.lit(NESTED))
        .otherwise(F.lit(UNCLOSED))
    )


def template_tokens(steps: DataFrame, faults: bool = False) -> DataFrame:
    """#47: ``(step, arg_pos, tok_pos, token, is_template, body)`` in order.

    With ``faults`` also ``arg_fault``, the whole argument's brace fault: its
    tokens are what the pattern finds, but it must not be realised (#66)."""
    extra = [brace_fault("arg").alias("arg_fault")] if faults else []
    toks = steps.select(
        "step", "arg_pos", *extra,
        F.posexplode(F.regexp_extract_all(F.col("arg"), F.lit(TOKEN_PATTERN), 1)).alias("tok_pos", "token"),
    )
    is_t = F.col("token").startswith("{")
    return toks.select(
        "step", "arg_pos", F.col("tok_pos").cast("int").alias("tok_pos"), "token",
        is_t.alias("is_template"),
        F.when(is_t, F.expr("substring(token, 2, length(token) - 2)")).alias("body"), *(["arg_fault"] if faults else []),
    )


def classify_tokens(tokens: DataFrame) -> DataFrame:
    """#48: add ``kind`` (literal/shared/variable/step/unknown), ``name`` and
    ``loc``; local ``{inputs}``/``{outputs}`` get the own step's name."""
    parts = F.split(F.col("body"), r"\.")
    n = F.size(parts)
    p1, p2, p3 = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    local = (n == 1) & p1.isin(*LOC_WORDS)
    shared = (n == 1) & (p1 == SHARED_WORD)
    var = (n == 2) & (p1 == VARIABLES_WORD)
    other = (n == 3) & (p1 == STEPS_WORD) & p3.isin(*LOC_WORDS)
    lit = ~F.col("is_template")
    kind = (
        F.when(lit, F.lit("literal"))
        .when(local | other, F.lit("step"))
        .when(shared, F.lit("shared"))
        .when(var, F.lit("variable"))
        .otherwise(F.lit("unknown"))
    )
    name = F.when(local, F.col("step")).when(other, p2).when(var, p2)
    loc = F.when(local, p1).when(other, p3)
    return tokens.select("*", kind.alias("kind"), name.alias("name"), loc.alias("loc"))


def template_faults(steps: DataFrame) -> DataFrame:
    """#49: per faulty argument ``(step, arg_pos, fault, detail)``: its brace
    fault (:func:`brace_fault`), and a row for each word between braces that
    is outside the grammar (``unknown_word``).
    """
    bf = steps.select("step", "arg_pos", brace_fault("arg").alias("fault"), F.lit(None).cast("string").alias("detail")).where(
        F.col("fault").isNotNull()
    )
    words = classify_tokens(template_tokens(steps)).where(F.col("kind") == "unknown").select(
        "step", "arg_pos", F.lit(UNKNOWN).alias("fault"), F.col("body").alias("detail")
    )
    return bf.unionByName(words)


def step_edges(tokens: DataFrame) -> DataFrame:
    """#50: ``(step, depends_on)``: other steps named in a step's arguments."""
    t = tokens if "kind" in tokens.columns else classify_tokens(tokens)
    return (
        t.where((F.col("kind") == "step") & (F.col("name") != F.col("step")))
        .select("step", F.col("name").alias("depends_on"))
        .distinct()
    )


def step_variables(tokens: DataFrame) -> DataFrame:
    """#51: ``(step, variable)`` used directly by each step."""
    t = tokens if "kind" in tokens.columns else classify_tokens(tokens)
    return t.where(F.col("kind") == "variable").select("step", F.col("name").alias("variable")).distinct()


def input_variables(tokens: DataFrame) -> DataFrame:
    """#51: every design column some step uses."""
    return step_variables(tokens).select("variable").distinct()


def step_closure(step_names: DataFrame, edges: DataFrame) -> DataFrame:
    """#52: ``(step, upstream, depth)`` -- every step reachable through
    dependencies, the step itself included (depth 0); ``depth`` is the
    longest path.

    Path doubling: round k has the pairs joined by a path of fewer than 2^k
    edges, with their longest such path (``reach``), and the pairs joined by a
    path of exactly 2^k edges (``power``).  A longer path is one of exactly
    2^k edges and a shorter rest, so one join of the two doubles the length:
    a chain of n steps takes about log2(n) rounds, and no pair is listed more
    often than there are middle steps 2^k edges away.  One job a round gives
    its size and whether a step reached itself, a cycle, which raises.  The
    first rounds are cached (most step graphs need no more), later ones written.
    """
    cached: list[DataFrame] = []

    def store(df: DataFrame) -> DataFrame:
        if length >= WRITTEN_FROM:
            return materialize(df)
        cached.append(df.persist())
        return cached[-1]

    length = 1
    reach = step_names.select("step", F.col("step").alias("upstream"), F.lit(0).alias("depth")).distinct()
    power = store(edges.select("step", F.col("depends_on").alias("upstream")).distinct())
    n = power.count()
    while n:
        hop = power.select("step", F.col("upstream").alias("_mid"))
        hop = F.broadcast(hop) if n <= MAX_BROADCAST_EDGES else hop
        on = lambda df: df.select(F.col("step").alias("_mid"), *[c for c in df.columns if c != "step"])
        # a dependency that is no step has no row in ``reach``, but is reached
        ends = power.select("step", "upstream", F.lit(length).alias("depth"))
        further = on(reach.where("depth > 0")).join(hop, "_mid").select("step", "upstream", (F.col("depth") + length).alias("depth"))
        reach = store(reach.unionByName(ends).unionByName(further).groupBy("step", "upstream").agg(F.max("depth").alias("depth")))
        power = store(on(power).join(hop, "_mid").select("step", "upstream").distinct())
        length *= 2
        told = power.select(F.lit(False).alias("loop")).unionByName(
            reach.where("step = upstream and depth > 0").select(F.lit(True).alias("loop")))
        n, loops = told.agg(F.count_if(~F.col("loop")), F.count_if("loop")).first()
        if loops:
            raise ValueError("step graph has a cycle")
    closure = materialize(reach)
    for c in cached:
        c.unpersist(blocking=False)
    return closure


def upstream_variables(closure: DataFrame, variables: DataFrame) -> DataFrame:
    """#53: ``(step, variable)``: variables of a step and all it depends on."""
    return (
        closure.join(variables.withColumnRenamed("step", "upstream"), "upstream")
        .select("step", "variable")
        .distinct()
    )


def check_config(step_names: DataFrame, edges: DataFrame, variables: DataFrame,
                 design_columns: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """#54: per step PASS/FAIL with its failures: a dependency that is not a
    step, a variable that is not a design column and, given the ``faults`` of
    :func:`template_faults`, an argument that is no sound template.

    ``n_failures`` counts them all; ``failures`` lists the first
    ``MAX_LISTED_FAILURES`` in order, so that no step's list is unbounded."""
    missing_step = edges.join(step_names.select(F.col("step").alias("depends_on")), "depends_on", "left_anti").select(
        "step", F.concat(F.lit("missing step: "), "depends_on").alias("failure")
    )
    missing_var = variables.join(design_columns.select("variable"), "variable", "left_anti").select(
        "step", F.concat(F.lit("missing variable: "), "variable").alias("failure")
    )
    failed = missing_step.unionByName(missing_var)
    if faults is not None:
        failed = failed.unionByName(faults.select("step", F.concat(
            F.lit("faulty argument "), F.col("arg_pos").cast("string"), F.lit(": "), "fault",
            F.when(F.col("detail").isNotNull(), F.concat(F.lit(" {"), "detail", F.lit("}"))).otherwise("")).alias("failure")))
    counts = failed.groupBy("step").agg(F.count(F.lit(1)).alias("n_failures"))
    order = Window.partitionBy("step").orderBy("failure")
    listed = failed.distinct().withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= MAX_LISTED_FAILURES)
    listed = listed.groupBy("step").agg(F.array_join(F.array_sort(F.collect_list("failure")), "; ").alias("failures"))
    return step_names.select("step").join(counts, "step", "left").join(listed, "step", "left").select(
        "step",
        F.when(F.col("n_failures").isNull(), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.coalesce("n_failures", F.lit(0)).cast("bigint").alias("n_failures"),
        "failures",
    )


def step_levels(closure: DataFrame) -> DataFrame:
    """``(step, level)``: the longest dependency path below the step."""
    return closure.groupBy("step").agg(F.max("depth").alias("level"))


def root_steps(step_names: DataFrame, edges: DataFrame) -> DataFrame:
    """#55: steps without dependencies."""
    return step_names.select("step").join(edges.select("step"), "step", "left_anti").distinct()
