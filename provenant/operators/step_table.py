"""Design expansion driven by a table of steps (#61, #63, #64, #66).

``operators.study`` compiles a small configuration into one column expression
per (step, argument), which Spark turns into code.  A configuration of
thousands of steps would make a plan of that size.  Here it is data instead:
one row with an array of steps (upstream, direct and dependency numbers,
arguments as arrays of tokens), broadcast to the design's tasks and evaluated
there by higher-order functions over the row's values.  The plan has the same
size for any number of steps, and the ids are the same.

The array is one row of configuration, bounded by ``MAX_CONFIG_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.digests import ID_DIGEST_BYTES, branch_id, render_id, string_digest

LITERAL, STEP_DIR, VALUE, FAULT = 0, 1, 2, 3
STEPS = (
    "array<struct<step:string,up:array<int>,direct:array<int>,deps:array<int>,"
    "args:array<struct<arg_pos:int,tokens:array<struct<kind:int,ref:int,text:string>>>>>>"
)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _steps(cfg, shared_dir: str = "") -> tuple[list[str], list[tuple]]:
    """The names of the design's variables, and the steps by number."""
    variables = sorted(set(cfg.variables()) | set(cfg.input_variables()))
    place = {v: i for i, v in enumerate(variables)}
    number = {s: i for i, s in enumerate(cfg.steps)}

    def token(t) -> tuple:
        if t["arg_fault"] is not None:
            return (FAULT, None, f"faulty argument {t['arg_pos']} of {t['step']}: {t['arg_fault']}")
        if t["kind"] == "literal":
            return (LITERAL, None, t["token"])
        if t["kind"] == "shared":
            return (LITERAL, None, shared_dir)
        if t["kind"] == "step" and t["name"] in number:
            return (STEP_DIR, number[t["name"]], "/" + t["loc"])
        if t["kind"] == "variable" and t["name"] in place:
            return (VALUE, place[t["name"]], None)
        return (FAULT, None, f"cannot realise token {t['token']}")

    args: dict[str, list] = {}
    for (step, pos), tokens in sorted(cfg.args.items()):
        args.setdefault(step, []).append((pos, [token(t) for t in tokens]))
    return variables, [
        (s, [place[v] for v in sorted(cfg.upstream.get(s, []))], [place[v] for v in sorted(set(cfg.direct.get(s, [])))],
         [number[d] for d in sorted(set(cfg.deps.get(s, []))) if d in number], args.get(s, []))
        for s in cfg.steps
    ]


def _rows(design: DataFrame, cfg, shared_dir: str = "") -> DataFrame:
    """Design rows with ``vals``, ``vars``, ``steps`` and each step's ``ids``."""
    variables, steps = _steps(cfg, shared_dir)
    value = [F.col(v).cast("string") for v in variables]
    checked = [F.when(c.isNull(), F.raise_error(F.lit(f"null design value in column {v}"))).otherwise(c) for v, c in zip(variables, value)]
    wide = design.select("variation_pos", F.array(*checked).cast("array<string>").alias("vals"), F.lit(1).alias("_one"))
    table = design.sparkSession.createDataFrame([(1, variables, steps)], f"_one int, vars array<string>, steps {STEPS}")
    # one row of bounded size meets every design row by a hash join on a constant
    rows = wide.join(F.broadcast(table), "_one").drop("_one")

    def vs_id(s: Column) -> Column:
        body = F.array_join(F.transform(s["up"], lambda i: F.concat(F.get("vars", i), F.get("vals", i))), "")
        return render_id("varstep", string_digest(F.concat(s["step"], body), ID_DIGEST_BYTES))

    return rows.withColumn("ids", F.transform("steps", vs_id))


def links(design: DataFrame, cfg) -> DataFrame:
    """#61/#65: ``(variation_pos, step, vs_id)``."""
    rows = _rows(design, cfg)
    pairs = F.arrays_zip(F.col("steps.step").alias("step"), F.col("ids").alias("vs_id"))
    return rows.select("variation_pos", F.explode(pairs).alias("x")).select("variation_pos", "x.step", "x.vs_id")


def _each(design: DataFrame, cfg, item, shared_dir: str = "") -> DataFrame:
    """Distinct ``item(step, its id, all ids)`` structs of all steps."""
    rows = _rows(design, cfg, shared_dir)
    items = _let(F.col("ids"), lambda ids: F.flatten(F.transform("steps", lambda s, i: item(s, F.get(ids, i), ids))))
    return rows.select(F.explode(items).alias("x")).select("x.*").distinct()


def deps(design: DataFrame, cfg) -> DataFrame:
    """#64: ``(vs_id, dep_step, dep_vs_id)``."""
    return _each(design, cfg, lambda s, own, ids: F.transform(s["deps"], lambda j: F.struct(
        own.alias("vs_id"), F.get(F.col("steps"), j)["step"].alias("dep_step"), F.get(ids, j).alias("dep_vs_id"))))


def direct_branches(design: DataFrame, cfg) -> DataFrame:
    """#63: ``(vs_id, step, variable, value, br_id)``."""
    out = _each(design, cfg, lambda s, own, ids: F.transform(s["direct"], lambda k: F.struct(
        own.alias("vs_id"), s["step"].alias("step"), F.get("vars", k).alias("variable"), F.get("vals", k).alias("value"))))
    return out.withColumn("br_id", branch_id("variable", "value"))


def realized(design: DataFrame, cfg, shared_dir: str, run_dir: str, strict: bool = True) -> DataFrame:
    """#66: ``(vs_id, step, arg_pos, arg)``; an argument that cannot be
    realised fails the job (``strict``) or is null."""
    run = run_dir.rstrip("/") + "/"

    def text(t: Column, ids: Column) -> Column:
        known = (
            F.when(t["kind"] == LITERAL, t["text"])
            .when(t["kind"] == STEP_DIR, F.concat(F.lit(run), F.get(ids, t["ref"]), t["text"]))
            .when(t["kind"] == VALUE, F.get("vals", t["ref"]))
        )
        return F.when(t["kind"] == FAULT, F.raise_error(t["text"]).cast("string")).otherwise(known) if strict else known

    def arg(a: Column, ids: Column) -> Column:
        parts = F.transform(a["tokens"], lambda t: text(t, ids))
        return _let(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, "")))

    return _each(design, cfg, lambda s, own, ids: F.transform(s["args"], lambda a: F.struct(
        own.alias("vs_id"), s["step"].alias("step"), a["arg_pos"].alias("arg_pos"), arg(a, ids).alias("arg"))), shared_dir)
