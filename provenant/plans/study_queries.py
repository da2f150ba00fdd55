"""Registered queries: templates and graph (#47-#55), design expansion
(#56-#67), status (#68-#77)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import status as STS
from provenant.operators import steps as S
from provenant.operators import study as ST
from provenant.plans.registry import register
from provenant.plans.study_fixtures import (
    RUN_DIR,
    SHARED_DIR,
    design_columns,
    graph_model,
    markers,
    study_model,
    transition_log,
)
from provenant.plans.study_sql import GRAPH_CTE, STUDY_CTE, TRANSITIONS_SQL
from provenant.session import materialize

# --- templates and the step graph (derived graph steps) --------------------


@register("template_tokens", f"{GRAPH_CTE} select step, arg_pos, tok_pos, token, is_template, body from ctoks")
def q_template_tokens(spark, sf_dir):
    """#47: ordered literal and {...} tokens of every argument."""
    return S.template_tokens(graph_model(spark, sf_dir)["steps"])


@register("token_kinds", f"{GRAPH_CTE} select step, arg_pos, tok_pos, kind, name, loc from ctoks")
def q_token_kinds(spark, sf_dir):
    """#48: token classes; local folders get the own step's name."""
    return graph_model(spark, sf_dir)["tokens"].select("step", "arg_pos", "tok_pos", "kind", "name", "loc")


@register("template_faults", GRAPH_CTE + r"""
select step, arg_pos, fault, detail from (
  select step, arg_pos,
         case when r = '' then null when starts_with(r, '}') then 'unopened_close'
              when starts_with(r, '{{') then 'nested_open' else 'unclosed_open' end as fault,
         cast(null as varchar) as detail
  from (select step, arg_pos, regexp_replace(regexp_replace(arg, '[^{}]', '', 'g'), '^(\{\})*', '') as r
        from steps) x) y
where fault is not null
union all
select step, arg_pos, 'unknown_word', body from ctoks where kind = 'unknown'""")
def q_template_faults(spark, sf_dir):
    """#49: unopened '}', nested '{', unclosed '{', unknown words."""
    return S.template_faults(graph_model(spark, sf_dir)["steps"])


@register("step_edges", f"{GRAPH_CTE} select step, depends_on from edges")
def q_step_edges(spark, sf_dir):
    """#50: step -> other step named in its arguments."""
    return graph_model(spark, sf_dir)["edges"]


@register("step_variables", f"{GRAPH_CTE} select step, variable from svars")
def q_step_variables(spark, sf_dir):
    """#51: variables used directly per step."""
    return graph_model(spark, sf_dir)["variables"]


@register("input_variables", f"{GRAPH_CTE} select distinct variable from svars")
def q_input_variables(spark, sf_dir):
    """#51: all variables any step uses."""
    return graph_model(spark, sf_dir)["variables"].select("variable").distinct()


@register("step_closure", f"{GRAPH_CTE} select step, upstream, depth from clo")
def q_step_closure(spark, sf_dir):
    """#52: transitive closure including the step itself, longest depth."""
    g = graph_model(spark, sf_dir)
    return S.step_closure(g["names"], g["edges"])


@register("upstream_variables", f"{GRAPH_CTE} select step, variable from uvars")
def q_upstream_variables(spark, sf_dir):
    """#53: variables of a step and of everything upstream."""
    g = graph_model(spark, sf_dir)
    return S.upstream_variables(S.step_closure(g["names"], g["edges"]), g["variables"])


@register("config_check", GRAPH_CTE + """,
fails as (
  select step, 'missing step: ' || depends_on as failure from edges
  where depends_on not in (select step from snames)
  union all
  select step, 'missing variable: ' || variable from svars where variable not in ('brand', 'size', 'type')),
agg as (select step, array_to_string(list_sort(list_distinct(list(failure))), '; ') as failures,
               count(*) as n from fails group by step)
select s.step, case when a.n is null then 'PASS' else 'FAIL' end as status,
       cast(coalesce(a.n, 0) as bigint) as n_failures, a.failures
from snames s left join agg a on a.step = s.step""")
def q_config_check(spark, sf_dir):
    """#54: PASS/FAIL per step: missing dependent steps and variables."""
    g = graph_model(spark, sf_dir)
    return S.check_config(g["names"], g["edges"], g["variables"], design_columns(spark, sf_dir))


@register("config_check_faults", GRAPH_CTE + r""",
faulty as (
  select step, arg_pos, case when r = '' then null when starts_with(r, '}') then 'unopened_close'
              when starts_with(r, '{{') then 'nested_open' else 'unclosed_open' end as fault
  from (select step, arg_pos, regexp_replace(regexp_replace(arg, '[^{}]', '', 'g'), '^(\{\})*', '') as r from steps) x),
fails as (
  select step, 'missing step: ' || depends_on as failure from edges
  where depends_on not in (select step from snames)
  union all
  select step, 'missing variable: ' || variable from svars where variable not in ('brand', 'size', 'type')
  union all
  select step, 'faulty argument ' || arg_pos || ': ' || fault from faulty where fault is not null
  union all
  select step, 'faulty argument ' || arg_pos || ': unknown_word {' || body || '}' from ctoks where kind = 'unknown'),
agg as (select step, array_to_string(list_sort(list_distinct(list(failure))), '; ') as failures,
               count(*) as n from fails group by step)
select s.step, case when a.n is null then 'PASS' else 'FAIL' end as status,
       cast(coalesce(a.n, 0) as bigint) as n_failures, a.failures
from snames s left join agg a on a.step = s.step""")
def q_config_check_faults(spark, sf_dir):
    """#54 with #49: PASS/FAIL per step, faulty templates included."""
    g = graph_model(spark, sf_dir)
    return S.check_config(g["names"], g["edges"], g["variables"], design_columns(spark, sf_dir), S.template_faults(g["steps"]))


@register("root_steps", f"{GRAPH_CTE} select step from snames where step not in (select step from edges)")
def q_root_steps(spark, sf_dir):
    """#55: steps without dependencies."""
    g = graph_model(spark, sf_dir)
    return S.root_steps(g["names"], g["edges"])


@register("step_levels", f"{GRAPH_CTE} select step, level from levels")
def q_step_levels(spark, sf_dir):
    """#55: longest dependency path per step (parents have lower levels)."""
    g = graph_model(spark, sf_dir)
    return S.step_levels(S.step_closure(g["names"], g["edges"]))


# --- design expansion (study steps x design from part) ---------------------


@register("melt_design", f"{STUDY_CTE} select variation_pos, variable, value from melted")
def q_melt_design(spark, sf_dir):
    """#56: design rows melted to (variable, value) branches."""
    return study_model(spark, sf_dir)["melted"]


@register("branches", f"""{STUDY_CTE}
select distinct variable, value, 'Br' || substr(sha256(variable || value), 1, 16) as br_id from melted""")
def q_branches(spark, sf_dir):
    """#57: distinct branches with their Br id."""
    return ST.branches(study_model(spark, sf_dir)["melted"])


@register("variation_ids", f"{STUDY_CTE} select variation_pos, v_id from vids")
def q_variation_ids(spark, sf_dir):
    """#58: keyed-set id per design row."""
    return study_model(spark, sf_dir)["vids"]


@register("variations", f"""{STUDY_CTE}
select v_id, min(variation_pos) as first_pos, count(*) as n_rows from vids group by v_id""")
def q_variations(spark, sf_dir):
    """#59: distinct variations, first row and fold count."""
    return ST.variations(study_model(spark, sf_dir)["vids"])


@register("upstream_branches", f"{STUDY_CTE} select variation_pos, step, variable, value from ub")
def q_upstream_branches(spark, sf_dir):
    """#60: upstream branches per (design row, step)."""
    m = study_model(spark, sf_dir)
    return ST.upstream_branches(m["melted"], m["uvars"])


@register("varstep_ids", f"{STUDY_CTE} select variation_pos, step, vs_id from links")
def q_varstep_ids(spark, sf_dir):
    """#61: VarStep id per (design row, step), steps without variables too."""
    return study_model(spark, sf_dir)["links"]


@register("varsteps", f"{STUDY_CTE} select vs_id, step from vsteps")
def q_varsteps(spark, sf_dir):
    """#62: distinct VarSteps."""
    return ST.varsteps(study_model(spark, sf_dir)["links"])


@register("varstep_sharing", f"""{STUDY_CTE}
select step, count(*) as n_rows, count(distinct vs_id) as n_varsteps from links group by step""")
def q_varstep_sharing(spark, sf_dir):
    """#62: how many design rows share each step's VarSteps."""
    return ST.varstep_sharing(study_model(spark, sf_dir)["links"])


@register("varstep_branches", f"""{STUDY_CTE}
select distinct l.vs_id, l.step, m.variable, m.value, 'Br' || substr(sha256(m.variable || m.value), 1, 16) as br_id
from links l join svars s on s.step = l.step
join melted m on m.variation_pos = l.variation_pos and m.variable = s.variable""")
def q_varstep_branches(spark, sf_dir):
    """#63: the branches a VarStep uses directly."""
    m = study_model(spark, sf_dir)
    return ST.varstep_branches_wide(m["design"], m["config"])


@register("varstep_deps", f"{STUDY_CTE} select vs_id, dep_step, dep_vs_id from deps")
def q_varstep_deps(spark, sf_dir):
    """#64: direct VarStep dependencies, found within a variation."""
    m = study_model(spark, sf_dir)
    return ST.varstep_deps_wide(m["design"], m["config"])


@register("varsteps_by_variation", f"""{STUDY_CTE}
select distinct v.v_id, l.step, l.vs_id from links l join vids v on v.variation_pos = l.variation_pos""")
def q_varsteps_by_variation(spark, sf_dir):
    """#65: VarSteps of each variation."""
    m = study_model(spark, sf_dir)
    return ST.varsteps_by_variation_wide(m["design"], m["config"])


def _args(spark, sf_dir):
    m = study_model(spark, sf_dir)
    return m, ST.realize_args_wide(m["design"], m["config"], SHARED_DIR, RUN_DIR)


@register("realize_args", f"{STUDY_CTE} select vs_id, step, arg_pos, arg from args")
def q_realize_args(spark, sf_dir):
    """#66: run arguments with every token replaced."""
    return _args(spark, sf_dir)[1]


def _status(m):
    # stored once: markers, states and what is joined to them start from the
    # distinct VarSteps, not from the design
    vs = materialize(ST.varsteps(m["links"]))
    return STS.resolve_status(vs, markers(vs))


@register("evidence_includes", f"""{STUDY_CTE},
files as (
  select distinct arg as path from args where starts_with(arg, '{SHARED_DIR}/')
  union
  select distinct a.arg from args a join status s on s.vs_id = a.vs_id
  where s.status = 'Finished' and starts_with(a.arg, '{RUN_DIR}/' || a.vs_id || '/outputs/'))
select vs_id, step, arg_pos, arg from args where arg in (select path from files)""")
def q_evidence_includes(spark, sf_dir):
    """#67: realised arguments that exist: shared scripts, and outputs of
    VarSteps whose marker says Finished."""
    m, args = _args(spark, sf_dir)
    st = _status(m)
    shared = args.where(F.col("arg").startswith(SHARED_DIR + "/")).select(F.col("arg").alias("path"))
    produced = args.join(st.where(F.col("status") == STS.FINISHED).select("vs_id"), "vs_id").where(
        F.col("arg").startswith(F.concat(F.lit(RUN_DIR + "/"), F.col("vs_id"), F.lit("/outputs/")))
    ).select(F.col("arg").alias("path"))
    return ST.evidence_includes(args, shared.unionByName(produced).distinct()).select("vs_id", "step", "arg_pos", "arg")


# --- status -----------------------------------------------------------------


@register("status_markers", f"{STUDY_CTE} select vs_id, marker from markers")
def q_status_markers(spark, sf_dir):
    """Marker table derived from the VarStep ids (FIXTURES E)."""
    return markers(ST.varsteps(study_model(spark, sf_dir)["links"]))


@register("resolve_status", f"{STUDY_CTE} select vs_id, step, status, n_markers from status")
def q_resolve_status(spark, sf_dir):
    """#68: markers to one state per VarStep."""
    return _status(study_model(spark, sf_dir))


def _ready(m):
    deps = materialize(ST.varstep_deps_wide(m["design"], m["config"]))  # read by several jobs
    return STS.readiness(deps, _status(m))


@register("readiness", f"{STUDY_CTE} select * from ready")
def q_readiness(spark, sf_dir):
    """#69: ready when every direct dependency is Finished."""
    return _ready(study_model(spark, sf_dir))


@register("run_order", f"{STUDY_CTE} select order_pos, vs_id, step, first_pos, level from rorder")
def q_run_order(spark, sf_dir):
    """#55: VarSteps parents first (level, first design row, step, id)."""
    m = study_model(spark, sf_dir)
    return STS.run_order(m["links"], m["levels"]).select("order_pos", "vs_id", "step", "first_pos", "level")


@register("ready_set", f"{STUDY_CTE} select * from readyset")
def q_ready_set(spark, sf_dir):
    """#71: everything that can start now, in run order."""
    m = study_model(spark, sf_dir)
    return STS.ready_set(STS.run_order(m["links"], m["levels"]), _ready(m))


@register("next_step", f"{STUDY_CTE} select * from readyset order by order_pos limit 1")
def q_next_step(spark, sf_dir):
    """#70: the first VarStep in run order that can start."""
    m = study_model(spark, sf_dir)
    return STS.next_step(STS.run_order(m["links"], m["levels"]), _ready(m))


@register("pending_count", f"""{STUDY_CTE}
select count(*) filter (where status in ('Not-Initialized', 'Not-Running')) as n_pending, count(*) as n_total
from status""")
def q_pending_count(spark, sf_dir):
    """#72: VarSteps still to run."""
    return STS.pending_count(_status(study_model(spark, sf_dir)))


@register("check_transitions", TRANSITIONS_SQL)
def q_check_transitions(spark, sf_dir):
    """#73: status changes from ``events`` judged against the previous one."""
    log = transition_log(spark, sf_dir)
    return STS.check_transitions(log, unit="user_id", order_by=("ts", "event_id")).select(
        "event_id", "user_id", "ts", "status", "prev_status", "verdict")


@register("transition_summary", f"""select verdict, count(*) as n_events from ({TRANSITIONS_SQL}) t group by verdict""")
def q_transition_summary(spark, sf_dir):
    """#73 summary: ok / bad_start / to_uninitialized counts."""
    return q_check_transitions(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_events"))


@register("status_step", f"""{STUDY_CTE},
up as (select distinct l.vs_id, b.variable, b.value from links l
       join ub b on b.variation_pos = l.variation_pos and b.step = l.step),
items as (
  select vs_id, 'branch' as item, variable as name, value from up
  union all
  select d.vs_id, 'dependency', s.step || ' ' || d.dep_vs_id, s.status
  from deps d join status s on s.vs_id = d.dep_vs_id)
select s.vs_id, s.step, s.status, i.item, i.name, i.value
from status s left join items i on i.vs_id = s.vs_id""")
def q_status_step(spark, sf_dir):
    """#74: per VarStep its upstream branches and dependencies' states."""
    m = study_model(spark, sf_dir)
    up = ST.varstep_upstream_wide(m["design"], m["config"])
    deps = materialize(ST.varstep_deps_wide(m["design"], m["config"]))  # read by several jobs
    return STS.status_step(_status(m), up, deps)


@register("status_list", f"""{STUDY_CTE}
select vs_id, step, status, '  ' || vs_id || ' ' || rpad(left(step, 14), 14, ' ') || ' ' || status as line
from status""")
def q_status_list(spark, sf_dir):
    """#75: compact line per VarStep."""
    return STS.status_list(_status(study_model(spark, sf_dir)))


@register("status_variation", f"""{STUDY_CTE},
first as (select v_id, min(variation_pos) as variation_pos from vids group by v_id)
select f.v_id, 'branch' as item, m.variable as name, m.value
from first f join melted m on m.variation_pos = f.variation_pos
union all
select f.v_id, 'varstep', l.step || ' ' || l.vs_id, s.status
from first f join links l on l.variation_pos = f.variation_pos join status s on s.vs_id = l.vs_id""")
def q_status_variation(spark, sf_dir):
    """#76: per variation its branches and VarSteps with states."""
    m = study_model(spark, sf_dir)
    d, cfg = m["design"], m["config"]
    return STS.status_variation(ST.variation_branches_wide(d, cfg), ST.varsteps_by_variation_wide(d, cfg), _status(m))


@register("status_study", f"""{STUDY_CTE}
select step, status, count(*) as n_varsteps from status group by step, status""")
def q_status_study(spark, sf_dir):
    """#77: VarStep counts per step and state."""
    return STS.status_study(_status(study_model(spark, sf_dir)))
