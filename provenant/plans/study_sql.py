"""DuckDB text of the study derivations (the oracle side)."""

from __future__ import annotations

from provenant.plans.study_fixtures import EVENT_STATUS, RUN_DIR, SHARED_DIR, STUDY_STEPS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STUDY_STEPS_SQL = "select * from (values " + ", ".join(
    f"({_q(s)}, {p}, {_q(a)})" for s, p, a in STUDY_STEPS) + ") t(step, arg_pos, arg)"

GRAPH_STEPS_SQL = """
select 'region_' || r_regionkey as step, 0 as arg_pos, '{shared}/prep.sh' as arg from region
union all select 'region_' || r_regionkey, 1, '{variables.brand}' from region
union all select 'region_' || r_regionkey, 2, '{outputs}/mesh' from region
union all select 'nation_' || n_nationkey, 0, '{steps.region_' || n_regionkey || '.outputs}/mesh' from nation
union all select 'nation_' || n_nationkey, 1, '{variables.size}' from nation
union all select 'nation_' || n_nationkey, 2, '{outputs}/res' from nation
union all select 'supplier_' || s_suppkey, 0, '{steps.nation_' || s_nationkey || '.outputs}/res' from supplier
union all select 'supplier_' || s_suppkey, 1, '{variables.type}' from supplier
union all select 'supplier_' || s_suppkey, 2, '{outputs}/rep' from supplier
union all select 'supplier_' || s_suppkey, 3,
  case s_suppkey % 10
    when 1 then '{steps.nation_' || s_nationkey || '.outputs/res'
    when 2 then 'res}/x'
    when 3 then '{a{b}}'
    when 4 then '{variable.size}'
    when 5 then '{steps.missing_' || s_suppkey || '.outputs}/in'
    when 6 then '{variables.colour}'
    else '{inputs}/log' end
from supplier"""

TOKEN_PATTERN_SQL = r"'(\{[^{}]*\}|[^{}]+)'"


def steps_cte(steps_sql: str) -> str:
    """CTEs: steps, toks, ctoks (classified), edges, svars, snames, clo, levels."""
    return f"""
steps as ({steps_sql}),
toks as (
  select step, arg_pos, cast(u.ord - 1 as integer) as tok_pos, u.token
  from steps, unnest(regexp_extract_all(arg, {TOKEN_PATTERN_SQL}, 1)) with ordinality as u(token, ord)),
ptoks as (
  select *, starts_with(token, '{{') as is_template,
         case when starts_with(token, '{{') then substr(token, 2, length(token) - 2) end as body,
         string_split(case when starts_with(token, '{{') then substr(token, 2, length(token) - 2) end, '.') as p
  from toks),
ctoks as (
  select step, arg_pos, tok_pos, token, is_template, body,
    case when not is_template then 'literal'
         when (len(p) = 1 and p[1] in ('inputs', 'outputs'))
           or (len(p) = 3 and p[1] = 'steps' and p[3] in ('inputs', 'outputs')) then 'step'
         when len(p) = 1 and p[1] = 'shared' then 'shared'
         when len(p) = 2 and p[1] = 'variables' then 'variable'
         else 'unknown' end as kind,
    case when is_template and len(p) = 1 and p[1] in ('inputs', 'outputs') then step
         when is_template and len(p) = 3 and p[1] = 'steps' and p[3] in ('inputs', 'outputs') then p[2]
         when is_template and len(p) = 2 and p[1] = 'variables' then p[2] end as name,
    case when is_template and len(p) = 1 and p[1] in ('inputs', 'outputs') then p[1]
         when is_template and len(p) = 3 and p[1] = 'steps' and p[3] in ('inputs', 'outputs') then p[3] end as loc
  from ptoks),
edges as (select distinct step, name as depends_on from ctoks where kind = 'step' and name <> step),
svars as (select distinct step, name as variable from ctoks where kind = 'variable'),
snames as (select distinct step from steps),
clo0(step, upstream, depth) as (
  select step, step, 0 from snames
  union all
  select c.step, e.depends_on, c.depth + 1 from clo0 c join edges e on e.step = c.upstream),
clo as (select step, upstream, max(depth) as depth from clo0 group by step, upstream),
levels as (select step, max(depth) as level from clo group by step),
uvars as (select distinct c.step, v.variable from clo c join svars v on v.step = c.upstream)"""


STUDY_CTE = "with recursive " + steps_cte(STUDY_STEPS_SQL) + f""",
design as (select p_partkey as variation_pos, p_brand as brand, p_type as type,
                  cast(p_size as varchar) as size from part),
melted as (
  select variation_pos, 'brand' as variable, brand as value from design
  union all select variation_pos, 'size', size from design
  union all select variation_pos, 'type', type from design),
vids as (
  select variation_pos,
         'V' || substr(sha256('variation' || string_agg(variable || value, '' order by variable)), 1, 16) as v_id
  from melted group by variation_pos),
ub as (select m.variation_pos, u.step, m.variable, m.value from melted m join uvars u on u.variable = m.variable),
links as (
  select variation_pos, step,
         'vs' || substr(sha256(step || string_agg(variable || value, '' order by variable)), 1, 16) as vs_id
  from ub group by variation_pos, step
  union all
  select d.variation_pos, s.step, 'vs' || substr(sha256(s.step), 1, 16)
  from (select distinct variation_pos from melted) d
  join (select step from snames where step not in (select step from uvars)) s on true),
vsteps as (select distinct vs_id, step from links),
deps as (
  select distinct l.vs_id, e.depends_on as dep_step, d.vs_id as dep_vs_id
  from links l join edges e on e.step = l.step
  join links d on d.variation_pos = l.variation_pos and d.step = e.depends_on),
reps as (select vs_id, step, min(variation_pos) as variation_pos from links group by vs_id, step),
rtoks as (
  select r.vs_id, r.step, t.arg_pos, t.tok_pos,
         case when t.kind = 'literal' then t.token
              when t.kind = 'shared' then {_q(SHARED_DIR)}
              when t.kind = 'step' and sr.vs_id is not null then {_q(RUN_DIR + '/')} || sr.vs_id || '/' || t.loc
              when t.kind = 'variable' then m.value end as text
  from reps r join ctoks t on t.step = r.step
  left join links sr on sr.variation_pos = r.variation_pos and sr.step = t.name
  left join melted m on m.variation_pos = r.variation_pos and m.variable = t.name),
args as (
  select vs_id, step, arg_pos,
         case when count(text) = count(*) then string_agg(text, '' order by tok_pos) end as arg
  from rtoks group by vs_id, step, arg_pos),
mk0 as (
  select vs_id,
         case (instr('0123456789abcdef', substr(vs_id, 3, 1)) - 1) % 5
           when 1 then 'notrunning' when 2 then 'running' when 3 then 'finished' when 4 then 'error' end as m1,
         right(vs_id, 1) = '0' as twice
  from vsteps),
markers as (
  select vs_id, m1 as marker from mk0 where m1 is not null
  union all
  select vs_id, case when m1 = 'notrunning' then 'running' else 'notrunning' end from mk0
  where m1 is not null and twice),
status as (
  select v.vs_id, v.step,
         case when k.n is null then 'Not-Initialized' when k.n > 1 then 'Multiple-Statuses'
              when k.m = 'notrunning' then 'Not-Running' when k.m = 'running' then 'Running'
              when k.m = 'finished' then 'Finished' when k.m = 'error' then 'Error' end as status,
         cast(coalesce(k.n, 0) as bigint) as n_markers
  from vsteps v left join (select vs_id, count(*) as n, min(marker) as m from markers group by vs_id) k
  on k.vs_id = v.vs_id),
ready as (
  select s.vs_id, s.step, s.status, cast(coalesce(d.n, 0) as bigint) as n_deps,
         cast(coalesce(d.f, 0) as bigint) as n_deps_finished, coalesce(d.n, 0) = coalesce(d.f, 0) as ready
  from status s left join (
    select x.vs_id, count(*) as n, count(*) filter (where y.status = 'Finished') as f
    from deps x left join status y on y.vs_id = x.dep_vs_id group by x.vs_id) d on d.vs_id = s.vs_id),
rorder as (
  select o.*, row_number() over (order by level, first_pos, step, vs_id) - 1 as order_pos
  from (select l.vs_id, l.step, min(l.variation_pos) as first_pos, coalesce(any_value(v.level), 0) as level
        from links l left join levels v on v.step = l.step group by l.vs_id, l.step) o),
readyset as (
  select o.order_pos, o.vs_id, o.step, o.level, r.status
  from rorder o join ready r on r.vs_id = o.vs_id
  where r.ready and r.status in ('Not-Initialized', 'Not-Running'))"""

GRAPH_CTE = "with recursive " + steps_cte(GRAPH_STEPS_SQL)

_EV = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in EVENT_STATUS.items())
TRANSITIONS_SQL = f"""
with log as (select event_id, user_id, ts, case event_type {_EV} end as status from events),
lagged as (select *, lag(status) over (partition by user_id order by ts, event_id) as prev_status from log)
select event_id, user_id, ts, status, prev_status,
       case when status = 'Not-Initialized' then 'to_uninitialized'
            when status = 'Running' and (prev_status is null or prev_status <> 'Not-Running') then 'bad_start'
            else 'ok' end as verdict
from lagged"""
