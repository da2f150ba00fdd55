"""Design expansion (#56-#67): variations, VarSteps, dependencies, arguments.

The design is a DataFrame, one row per variation, all STRING columns, plus a
``variation_pos`` (input order).  Only the columns some step uses count.

A VarStep is a step with the design values its results depend on: its id is
a keyed-set digest with the step's name as prefix over its *upstream*
branches (the step's own variables and those of every step it depends on,
transitively).  Variations that agree on those values share the VarStep.

Scale notes: the design is the big input.  The step tables (steps, upstream
variables, edges) are study configuration; they are broadcast only after a
size check (``MAX_CONFIG_ROWS``), so design rows never shuffle by variable
name (a handful of hot keys).  The keyed sets group by (variation, step):
bounded by the number of variables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.digests import (
    ID_DIGEST_BYTES,
    VARIATION_PREFIX,
    branch_id,
    keyed_set_digest,
    render_id,
    string_digest,
)
from provenant.operators import step_table

MAX_CONFIG_ROWS = 1_000_000
#: configurations of more tokens, edges and variables than this are evaluated as
#: a table (:mod:`provenant.operators.step_table`), not compiled into the plan
COMPILED_ROWS = 500


def _config(df: DataFrame, what: str) -> DataFrame:
    """Broadcast a configuration table after checking it is bounded."""
    n = df.count()
    if n > MAX_CONFIG_ROWS:
        raise ValueError(f"{what} has {n} rows; more than {MAX_CONFIG_ROWS} is not a study configuration")
    return F.broadcast(df)


def _config_rows(df: DataFrame, what: str) -> list:
    """Collect a small configuration table, refusing one that is not small."""
    rows = df.limit(MAX_CONFIG_ROWS + 1).collect()
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"{what} has more than {MAX_CONFIG_ROWS} rows; not a study configuration")
    return rows


def melt_design(design: DataFrame, variables: list[str], strict: bool = True) -> DataFrame:
    """#56: ``(variation_pos, variable, value)``, one row per used column.

    ``strict`` rejects nulls in used columns (a value is needed to realise
    arguments); otherwise they stay null.
    """
    missing = [v for v in variables if v not in design.columns]
    if missing:
        raise ValueError(f"design lacks columns {missing}")
    cols = sorted(set(variables))
    d = design.select("variation_pos", *[F.col(c).cast("string").alias(c) for c in cols])
    m = d.unpivot(["variation_pos"], cols, "variable", "value")
    if strict:
        m = m.withColumn(
            "value",
            F.when(F.col("value").isNull(),
                   F.raise_error(F.concat(F.lit("null design value in column "), F.col("variable"))))
            .otherwise(F.col("value")),
        )
    return m


def branches(melted: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """#57: distinct ``(variable, value)`` with their ``Br`` id."""
    return melted.select("variable", "value").distinct().withColumn(
        "br_id", branch_id("variable", "value", algorithm)
    )


def variation_ids(melted: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """#58: ``(variation_pos, v_id)``: keyed set with prefix ``variation``."""
    return melted.groupBy("variation_pos").agg(
        render_id("variation", keyed_set_digest(VARIATION_PREFIX, "variable", "value", ID_DIGEST_BYTES, algorithm))
        .alias("v_id")
    )


def variations(vids: DataFrame) -> DataFrame:
    """#59: distinct variations; equal rows fold, first position kept."""
    return vids.groupBy("v_id").agg(
        F.min("variation_pos").alias("first_pos"), F.count(F.lit(1)).alias("n_rows")
    )


def upstream_branches(melted: DataFrame, upstream_vars: DataFrame) -> DataFrame:
    """#60: ``(variation_pos, step, variable, value)`` for each step's
    upstream variables (config side broadcast after a size check)."""
    return melted.join(_config(upstream_vars, "upstream variables"), "variable").select(
        "variation_pos", "step", "variable", "value"
    )


def varstep_links(melted: DataFrame, upstream_vars: DataFrame, step_names: DataFrame,
                  algorithm: str = "sha256") -> DataFrame:
    """#61/#65: ``(variation_pos, step, vs_id)`` for every variation and step.

    Steps with upstream variables: keyed set over the upstream branches with
    the step name as prefix.  Steps without any: the digest of the name
    alone, the same VarStep for every variation.
    """
    ub = upstream_branches(melted, upstream_vars)
    with_vars = ub.groupBy("variation_pos", "step").agg(
        render_id("varstep", keyed_set_digest(F.col("step"), "variable", "value", ID_DIGEST_BYTES, algorithm))
        .alias("vs_id")
    )
    plain = step_names.select("step").join(upstream_vars.select("step"), "step", "left_anti").distinct()
    positions = melted.select("variation_pos").distinct()
    plain_steps = [r["step"] for r in _config_rows(plain, "steps")]
    if not plain_steps:
        return with_vars
    no_vars = positions.select(
        "variation_pos", F.explode(F.array(*[F.lit(s) for s in plain_steps])).alias("step")
    ).withColumn("vs_id", render_id("varstep", string_digest(F.col("step"), ID_DIGEST_BYTES, algorithm)))
    return with_vars.unionByName(no_vars)


def varsteps(links: DataFrame) -> DataFrame:
    """#62: distinct VarSteps ``(vs_id, step)``."""
    return links.select("vs_id", "step").distinct()


def varstep_sharing(links: DataFrame) -> DataFrame:
    """#62: per step the number of design rows and of distinct VarSteps."""
    return links.groupBy("step").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("vs_id").alias("n_varsteps")
    )


def varstep_branches(links: DataFrame, melted: DataFrame, step_vars: DataFrame,
                     algorithm: str = "sha256") -> DataFrame:
    """#63: direct branches of each VarStep (its own step's variables)."""
    direct = links.join(_config(step_vars, "step variables"), "step")
    return (
        direct.join(melted, ["variation_pos", "variable"])
        .select("vs_id", "step", "variable", "value")
        .distinct()
        .withColumn("br_id", branch_id("variable", "value", algorithm))
    )


def varstep_deps(links: DataFrame, edges: DataFrame) -> DataFrame:
    """#64: ``(vs_id, dep_vs_id)``: within one variation, the VarStep of each
    step a VarStep's step depends on."""
    e = _config(edges, "step edges")
    need = links.join(e, "step").select("variation_pos", "vs_id", F.col("depends_on").alias("dep_step"))
    dep = links.select("variation_pos", F.col("step").alias("dep_step"), F.col("vs_id").alias("dep_vs_id"))
    return need.join(dep, ["variation_pos", "dep_step"]).select("vs_id", "dep_step", "dep_vs_id").distinct()


def varsteps_by_variation(links: DataFrame, vids: DataFrame) -> DataFrame:
    """#65: ``(v_id, step, vs_id)`` link table over distinct variations."""
    return links.join(vids, "variation_pos").select("v_id", "step", "vs_id").distinct()


def representatives(links: DataFrame) -> DataFrame:
    """One design row per VarStep (the first); all rows sharing a VarStep
    agree on everything its arguments can name."""
    return links.groupBy("vs_id", "step").agg(F.min("variation_pos").alias("variation_pos"))


def realize_args(tokens: DataFrame, links: DataFrame, melted: DataFrame, shared_dir: str,
                 run_dir: str, strict: bool = True) -> DataFrame:
    """#66: ``(vs_id, step, arg_pos, arg)`` with every token replaced.

    ``{shared}`` -> the shared folder; ``{inputs}``/``{outputs}`` and
    ``{steps.s.inputs|outputs}`` -> ``<run_dir>/<VarStep of s>/<loc>``;
    ``{variables.x}`` -> the design value.  An unknown token, or an argument
    whose braces are faulty (tokens with ``arg_fault``), fails the job
    (``strict``) or leaves the argument null.
    """
    reps = representatives(links)
    t = reps.join(_config(tokens, "templates"), "step")
    step_ref = links.select(
        "variation_pos", F.col("step").alias("name"), F.col("vs_id").alias("ref_vs_id")
    )
    var_ref = melted.select("variation_pos", F.col("variable").alias("name"), F.col("value").alias("var_value"))
    t = t.join(step_ref, ["variation_pos", "name"], "left").join(var_ref, ["variation_pos", "name"], "left")
    run = run_dir.rstrip("/")
    text = (
        F.when(F.col("kind") == "literal", F.col("token"))
        .when(F.col("kind") == "shared", F.lit(shared_dir))
        .when((F.col("kind") == "step") & F.col("ref_vs_id").isNotNull(),
              F.concat(F.lit(run + "/"), F.col("ref_vs_id"), F.lit("/"), F.col("loc")))
        .when(F.col("kind") == "variable", F.col("var_value"))
    )
    if "arg_fault" in tokens.columns:
        text = F.when(F.col("arg_fault").isNull(), text)
    if strict:
        text = F.when(text.isNull(), F.raise_error(F.concat(F.lit("cannot realise token "), F.col("token")))).otherwise(text)
    t = t.select("vs_id", "step", "arg_pos", "tok_pos", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("tok_pos", "text")))
    return t.groupBy("vs_id", "step", "arg_pos").agg(
        F.when(F.count("text") == F.count(F.lit(1)), F.array_join(F.transform(parts, lambda x: x["text"]), ""))
        .alias("arg")
    )


def evidence_includes(args: DataFrame, files: DataFrame) -> DataFrame:
    """#67: the realised arguments of each VarStep that exist as files."""
    from provenant.operators.skew import hot_split_join

    # a shared script named by every VarStep is a hot key of the arguments
    return hot_split_join(args, files.select(F.col("path").alias("arg")).distinct(), "arg", "left_semi")


def config_variables(upstream_vars: DataFrame) -> dict[str, list[str]]:
    """``{step: sorted upstream variables}`` from the (checked-small) config."""
    out: dict[str, list[str]] = {}
    for r in _config_rows(upstream_vars.select("step", "variable"), "upstream variables"):
        out.setdefault(r["step"], []).append(r["variable"])
    return {k: sorted(v) for k, v in out.items()}


def _row_keyed_digest(prefix: str, variables: list[str], algorithm: str) -> F.Column:
    """Keyed-set digest of one design row over known variables: the same
    preimage as :func:`keyed_set_digest` (names in byte order), built as a
    projection -- no grouping, no shuffle."""
    parts = [F.lit(prefix)]
    for v in sorted(variables):
        parts += [F.lit(v), F.col(v)]
    return string_digest(F.concat(*parts), ID_DIGEST_BYTES, algorithm)


def _strict_values(design: DataFrame, variables: list[str]) -> DataFrame:
    cols = []
    for v in variables:
        c = F.col(v).cast("string")
        cols.append(F.when(c.isNull(), F.raise_error(F.lit(f"null design value in column {v}"))).otherwise(c).alias(v))
    return design.select("variation_pos", *cols)


def variation_ids_wide(design: DataFrame, variables: list[str], algorithm: str = "sha256") -> DataFrame:
    """#58 as a projection of the design row (same ids as :func:`variation_ids`)."""
    d = _strict_values(design, sorted(set(variables)))
    return d.select("variation_pos",
                    render_id("variation", _row_keyed_digest(VARIATION_PREFIX, sorted(set(variables)), algorithm))
                    .alias("v_id"))


def varstep_links_wide(design: DataFrame, step_vars: dict[str, list[str]], step_names: list[str],
                       algorithm: str = "sha256") -> DataFrame:
    """#61/#65 as a projection: every design row yields one
    ``(variation_pos, step, vs_id)`` per step, the id computed from the row's
    own values of the step's upstream variables (config known to the driver).
    Same ids as :func:`varstep_links`; the design is scanned once and never
    shuffled."""
    used = sorted({v for vs in step_vars.values() for v in vs})
    d = _strict_values(design, used)
    items = [
        F.struct(F.lit(s).alias("step"),
                 render_id("varstep", _row_keyed_digest(s, step_vars.get(s, []), algorithm)).alias("vs_id"))
        for s in sorted(step_names)
    ]
    return d.select("variation_pos", F.explode(F.array(*items)).alias("x")).select(
        "variation_pos", "x.step", "x.vs_id")


# --- the step configuration compiled into column expressions -----------------
#
# A study's configuration (steps, their arguments, dependencies, variables) is
# small and checked; the design is what grows.  Compiling the configuration
# into expressions over one design row lets every per-(row, step) result be
# computed in a single pass over the design -- no join between design-sized
# tables -- followed by one ``distinct`` that combines map-side (a VarStep
# shared by every row collapses before any shuffle).


class StudyConfig:
    """The configuration a design pass needs, collected once in one job
    (bounded by ``MAX_CONFIG_ROWS``)."""

    def __init__(self, tokens: DataFrame, edges: DataFrame, step_vars: DataFrame, upstream_vars: DataFrame,
                 step_names: DataFrame):
        fault = F.col("arg_fault") if "arg_fault" in tokens.columns else F.lit(None).cast("string")
        parts = [
            tokens.select(F.lit("token").alias("part"), "step", "arg_pos", "tok_pos", "kind", "name", "loc", "token",
                          fault.alias("arg_fault")),
            edges.select(F.lit("edge").alias("part"), "step", F.col("depends_on").alias("name")),
            step_vars.select(F.lit("direct").alias("part"), "step", F.col("variable").alias("name")),
            upstream_vars.select(F.lit("upstream").alias("part"), "step", F.col("variable").alias("name")),
            step_names.select(F.lit("step").alias("part"), "step"),
        ]
        combined = parts[0]
        for p in parts[1:]:
            combined = combined.unionByName(p, allowMissingColumns=True)
        rows = _config_rows(combined, "study configuration")
        by_part: dict[str, list] = {}
        for r in rows:
            by_part.setdefault(r["part"], []).append(r)
        self.steps = sorted(r["step"] for r in by_part.get("step", []))
        self.upstream: dict[str, list[str]] = {}
        for r in by_part.get("upstream", []):
            self.upstream.setdefault(r["step"], []).append(r["name"])
        self.upstream = {k: sorted(v) for k, v in self.upstream.items()}
        self.direct: dict[str, list[str]] = {}
        for r in by_part.get("direct", []):
            self.direct.setdefault(r["step"], []).append(r["name"])
        self.deps: dict[str, list[str]] = {}
        for r in by_part.get("edge", []):
            self.deps.setdefault(r["step"], []).append(r["name"])
        self.args: dict[tuple[str, int], list] = {}
        for r in sorted(by_part.get("token", []), key=lambda r: (r["step"], r["arg_pos"], r["tok_pos"])):
            self.args.setdefault((r["step"], r["arg_pos"]), []).append(r)

        self.rows = len(rows)

    def as_table(self, algorithm: str) -> bool:
        """Too large to compile.  (BLAKE3 ids come from a UDF, which no
        higher-order function can call: they are always compiled.)"""
        return self.rows > COMPILED_ROWS and algorithm == "sha256"

    def variables(self) -> list[str]:
        return sorted({v for vs in self.upstream.values() for v in vs})

    def input_variables(self) -> list[str]:
        return sorted({v for vs in self.direct.values() for v in vs})

    def vs_id(self, step: str, algorithm: str = "sha256") -> F.Column:
        return render_id("varstep", _row_keyed_digest(step, self.upstream.get(step, []), algorithm))


def study_links(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """#61/#65 for a collected configuration of any size."""
    if cfg.as_table(algorithm):
        return step_table.links(design, cfg)
    return varstep_links_wide(design, cfg.upstream, cfg.steps, algorithm)


def varstep_deps_wide(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """#64 in one design pass: per row, each step's VarStep and the VarStep
    of each step it depends on (same row), then ``distinct``."""
    if cfg.as_table(algorithm):
        return step_table.deps(design, cfg)
    d = _strict_values(design, cfg.variables())
    items = [
        F.struct(cfg.vs_id(s, algorithm).alias("vs_id"), F.lit(dep).alias("dep_step"),
                 cfg.vs_id(dep, algorithm).alias("dep_vs_id"))
        for s in cfg.steps for dep in sorted(set(cfg.deps.get(s, []))) if dep in cfg.steps
    ]
    if not items:
        return design.sparkSession.createDataFrame([], "vs_id string, dep_step string, dep_vs_id string")
    return d.select(F.explode(F.array(*items)).alias("x")).select("x.*").distinct()


def varstep_branches_wide(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """#63 in one design pass: the branches a VarStep's own step uses."""
    if cfg.as_table(algorithm):
        return step_table.direct_branches(design, cfg)
    d = _strict_values(design, cfg.variables())
    items = [
        F.struct(cfg.vs_id(s, algorithm).alias("vs_id"), F.lit(s).alias("step"), F.lit(v).alias("variable"),
                 F.col(v).alias("value"))
        for s in cfg.steps for v in sorted(set(cfg.direct.get(s, [])))
    ]
    out = d.select(F.explode(F.array(*items)).alias("x")).select("x.*").distinct()
    return out.withColumn("br_id", branch_id("variable", "value", algorithm))


def realize_args_wide(design: DataFrame, cfg: StudyConfig, shared_dir: str, run_dir: str,
                      algorithm: str = "sha256", strict: bool = True) -> DataFrame:
    """#66 in one design pass: every argument of every step realised from the
    row's own values and the row's VarStep ids, then ``distinct`` (rows that
    share a VarStep realise identical arguments)."""
    if cfg.as_table(algorithm):
        return step_table.realized(design, cfg, shared_dir, run_dir, strict)
    d = _strict_values(design, cfg.variables())
    run = run_dir.rstrip("/")
    cols = set(design.columns)

    def token(t) -> F.Column:
        if t["arg_fault"] is not None:
            return F.raise_error(F.lit(f"faulty argument {t['arg_pos']} of {t['step']}: {t['arg_fault']}")).cast("string") if strict \
                else F.lit(None).cast("string")
        if t["kind"] == "literal":
            return F.lit(t["token"])
        if t["kind"] == "shared":
            return F.lit(shared_dir)
        if t["kind"] == "step" and t["name"] in cfg.steps:
            return F.concat(F.lit(run + "/"), cfg.vs_id(t["name"], algorithm), F.lit("/" + t["loc"]))
        if t["kind"] == "variable" and t["name"] in cols:
            return F.col(t["name"]).cast("string")
        bad = F.lit(None).cast("string")
        return F.raise_error(F.lit(f"cannot realise token {t['token']}")).cast("string") if strict else bad

    items = [
        F.struct(cfg.vs_id(s, algorithm).alias("vs_id"), F.lit(s).alias("step"), F.lit(pos).alias("arg_pos"),
                 F.concat(*[token(t) for t in toks]).alias("arg"))
        for (s, pos), toks in sorted(cfg.args.items())
    ]
    extra = [v for v in {t["name"] for toks in cfg.args.values() for t in toks if t["kind"] == "variable"}
             if v in cols and v not in cfg.variables()]
    d = d.join(design.select("variation_pos", *extra), "variation_pos") if extra else d
    return d.select(F.explode(F.array(*items)).alias("x")).select("x.*").distinct()


def _variations_once(design: DataFrame, cfg: StudyConfig, algorithm: str) -> DataFrame:
    """One row per distinct variation: ``v_id`` and the used variables, on
    which all its design rows agree (map-side combined)."""
    used = cfg.input_variables()
    d = _strict_values(design, cfg.variables()).select(F.lit(1).alias("_one"), *used).distinct()
    return d.withColumn("v_id", render_id("variation", _row_keyed_digest(VARIATION_PREFIX, used, algorithm)))


def varsteps_by_variation_wide(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """#65 in one design pass, without a join: the VarStep ids are computed
    from the variation's own values."""
    items = [F.struct(F.lit(s).alias("step"), cfg.vs_id(s, algorithm).alias("vs_id")) for s in cfg.steps]
    return _variations_once(design, cfg, algorithm).select("v_id", F.explode(F.array(*items)).alias("x")).select(
        "v_id", "x.step", "x.vs_id")


def variation_branches_wide(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """``(v_id, variable, value)`` of each distinct variation, in one pass."""
    items = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in cfg.input_variables()]
    if not items:
        return design.sparkSession.createDataFrame([], "v_id string, variable string, value string")
    return _variations_once(design, cfg, algorithm).select("v_id", F.explode(F.array(*items)).alias("x")).select(
        "v_id", "x.variable", "x.value")


def varstep_upstream_wide(design: DataFrame, cfg: StudyConfig, algorithm: str = "sha256") -> DataFrame:
    """``(vs_id, variable, value)``: all upstream branches of each VarStep
    (#60 by VarStep), in one design pass."""
    items = [
        F.struct(cfg.vs_id(s, algorithm).alias("vs_id"), F.lit(v).alias("variable"), F.col(v).alias("value"))
        for s in cfg.steps for v in cfg.upstream.get(s, [])
    ]
    if not items:
        return design.sparkSession.createDataFrame([], "vs_id string, variable string, value string")
    d = _strict_values(design, cfg.variables())
    return d.select(F.explode(F.array(*items)).alias("x")).select("x.*").distinct()
