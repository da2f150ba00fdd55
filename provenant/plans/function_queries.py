"""Registered queries for column functions: digests and ids (#18-#27) and
paths (#10-#17), each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import digests as D
from provenant.functions import paths as P
from provenant.plans.fixtures import table
from provenant.operators.keyed_sets import keyed_set_digests
from provenant.plans.registry import register

# --- digests and identifiers -------------------------------------------------


@register("content_digest", "select page_id, sha256(html) as data_digest from pages")
def q_content_digest(spark, sf_dir):
    """#18: digest of every byte of each page."""
    return table(spark, sf_dir, "pages").select("page_id", D.content_digest("html").alias("data_digest"))


@register("string_digest", "select doc_id, substr(sha256(text), 1, 16) as digest8 from documents")
def q_string_digest(spark, sf_dir):
    """#19: 8-byte digest of each document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", D.string_digest("text", 8).alias("digest8"))


@register("branch_id", """select c_custkey, 'Br' || substr(sha256(c_mktsegment || c_name), 1, 16) as br_id
from customer""")
def q_branch_id(spark, sf_dir):
    """#20: Br id of (name, value) = (market segment, customer name)."""
    return table(spark, sf_dir, "customer").select("c_custkey", D.branch_id("c_mktsegment", "c_name").alias("br_id"))


@register("keyed_set_digest", """select l_orderkey, count(*) as n_items,
  case when count(distinct l_linenumber) = count(*) then
  substr(sha256('order' || string_agg(cast(l_linenumber as varchar) || cast(l_partkey as varchar), ''
                                      order by cast(l_linenumber as varchar))), 1, 16) end as set_digest
from lineitem group by l_orderkey""")
def q_keyed_set_digest(spark, sf_dir):
    """#21: keyed-set digest per order over (line number -> part); orders
    whose line numbers repeat get none."""
    li = table(spark, sf_dir, "lineitem")
    return keyed_set_digests(li, ["l_orderkey"], "order", "l_linenumber", "l_partkey")


@register("keyed_set_violations", """select o_custkey as set_key, o_orderstatus as name, count(*) as n_copies
from orders group by o_custkey, o_orderstatus having count(*) > 1""")
def q_keyed_set_violations(spark, sf_dir):
    """#22: names that occur more than once in a keyed set (customer ->
    order status): such a set has no id."""
    o = table(spark, sf_dir, "orders")
    return (
        o.groupBy(F.col("o_custkey").alias("set_key"), F.col("o_orderstatus").alias("name"))
        .agg(F.count(F.lit(1)).alias("n_copies"))
        .where(F.col("n_copies") > 1)
    )


@register("metadata_digest", """select event_id,
  sha256('1 provenant 0.1.0 SHA-256 ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) as meta_digest from events""")
def q_metadata_digest(spark, sf_dir):
    """#24: metadata digest for a Record generated at each event's time."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        D.metadata_digest(F.lit(1), F.lit("provenant"), F.lit("0.1.0"), F.lit("SHA-256"),
                          F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("meta_digest"),
    )


def _sql_compact(col: str, w: int) -> str:
    if w < 5:
        short = f"left({col}, {w})"
    else:
        front = (w - 3) // 2
        short = f"concat(left({col}, {front}), '...', right({col}, {w - 3 - front}))"
    return f"(case when length({col}) <= {w} then {col} else {short} end)"


@register("compact_hex", f"""select doc_id, {_sql_compact('d', 4)} as w4, {_sql_compact('d', 14)} as w14,
  {_sql_compact('d', 32)} as w32, {_sql_compact('d', 70)} as w70
from (select doc_id, sha256(text) as d from documents)""")
def q_compact_hex(spark, sf_dir):
    """#25: digests shortened to 4, 14, 32 and 70 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return d.select("doc_id", *[D.compact_hex("d", w).alias(f"w{w}") for w in (4, 14, 32, 70)])


@register("render_id", """select doc_id, 'vs' || substr(d, 1, 16) as vs_id, 'V' || substr(d, 17, 16) as v_id,
  'Br' || substr(d, 33, 16) as br_id
from (select doc_id, sha256(text) as d from documents)""")
def q_render_id(spark, sf_dir):
    """#26: prefix + hex for the three id kinds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return d.select(
        "doc_id",
        D.render_id("varstep", F.substring("d", 1, 16)).alias("vs_id"),
        D.render_id("variation", F.substring("d", 17, 16)).alias("v_id"),
        D.render_id("branch", F.substring("d", 33, 16)).alias("br_id"),
    )


_CANDIDATE_SQL = """case doc_id % 6
    when 0 then 'vs' || substr(d, 1, 16)
    when 1 then substr(d, 1, 16)
    when 2 then 'vs' || substr(d, 1, 15)
    when 3 then 'vs' || substr(d, 1, 14) || 'zz'
    when 4 then 'vs+' || substr(d, 1, 15)
    else 'vs' || upper(substr(d, 1, 16)) end"""


@register("check_id", f"""select doc_id, candidate,
  case when not starts_with(candidate, 'vs') then 'missing_prefix'
       when strlen(substr(candidate, 3)) <> 16
         then 'invalid_length(expected=16, actual=' || strlen(substr(candidate, 3)) || ')'
       when regexp_full_match(substr(candidate, 3), '([0-9a-fA-F]{{2}}|\\+[0-9a-fA-F])*') then 'ok'
       else 'invalid_hex' end as verdict
from (select doc_id, {_CANDIDATE_SQL} as candidate from (select doc_id, sha256(text) as d from documents))""")
def q_check_id(spark, sf_dir):
    """#27: id texts checked in order prefix, length, hex."""
    d = F.sha2("text", 256)
    m = F.col("doc_id") % 6
    cand = (
        F.when(m == 0, F.concat(F.lit("vs"), F.substring(d, 1, 16)))
        .when(m == 1, F.substring(d, 1, 16))
        .when(m == 2, F.concat(F.lit("vs"), F.substring(d, 1, 15)))
        .when(m == 3, F.concat(F.lit("vs"), F.substring(d, 1, 14), F.lit("zz")))
        .when(m == 4, F.concat(F.lit("vs+"), F.substring(d, 1, 15)))
        .otherwise(F.concat(F.lit("vs"), F.upper(F.substring(d, 1, 16))))
    )
    c = table(spark, sf_dir, "documents").select("doc_id", cand.alias("candidate"))
    return c.select("doc_id", "candidate", D.check_id("varstep", "candidate").alias("verdict"))


# --- paths -------------------------------------------------------------------

_PATH_SQL = """case doc_id % 8
    when 0 then '/data/' || source || '/' || doc_id || '.txt'
    when 1 then 'docs/' || source || '/' || doc_id || '.txt'
    when 2 then './docs//' || source || '/./' || doc_id || '.txt'
    when 3 then '/data/' || source || '/'
    when 4 then 'docs/../' || doc_id || '.txt'
    when 5 then '/'
    when 6 then ''
    else 'docs/' || source || '/..' end"""
_BASE_SQL = "case doc_id % 3 when 0 then null when 1 then '/base/' || lang else '' end"
_DIR_SQL = "case doc_id % 4 when 0 then '/data' when 1 then 'docs' when 2 then '/data/' || source else 'docs/x/y' end"
_PATHS_SQL = f"select doc_id, {_PATH_SQL} as path, {_BASE_SQL} as base, {_DIR_SQL} as dir from documents"


def _paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k8, k3, k4 = F.col("doc_id") % 8, F.col("doc_id") % 3, F.col("doc_id") % 4
    i, s = F.col("doc_id").cast("string"), F.col("source")
    path = (
        F.when(k8 == 0, F.concat(F.lit("/data/"), s, F.lit("/"), i, F.lit(".txt")))
        .when(k8 == 1, F.concat(F.lit("docs/"), s, F.lit("/"), i, F.lit(".txt")))
        .when(k8 == 2, F.concat(F.lit("./docs//"), s, F.lit("/./"), i, F.lit(".txt")))
        .when(k8 == 3, F.concat(F.lit("/data/"), s, F.lit("/")))
        .when(k8 == 4, F.concat(F.lit("docs/../"), i, F.lit(".txt")))
        .when(k8 == 5, F.lit("/"))
        .when(k8 == 6, F.lit(""))
        .otherwise(F.concat(F.lit("docs/"), s, F.lit("/..")))
    )
    base = F.when(k3 == 1, F.concat(F.lit("/base/"), F.col("lang"))).when(k3 == 2, F.lit(""))
    dir_ = (
        F.when(k4 == 0, F.lit("/data")).when(k4 == 1, F.lit("docs"))
        .when(k4 == 2, F.concat(F.lit("/data/"), s)).otherwise(F.lit("docs/x/y"))
    )
    return d.select("doc_id", path.alias("path"), base.alias("base"), dir_.alias("dir"))


_COMPS = "list_filter(string_split({p}, '/'), lambda x: x <> '' and x <> '.')"
_KIND = """(case when {p} is null then null when {p} = '' and {b} is null then 'invalid'
  when starts_with({p}, '/') and {b} is not null then 'invalid' when starts_with({p}, '/') then 'absolute'
  when {b} is not null then 'relative' else 'relative_incomplete' end)"""
_B2 = "(case when base = '' then './' else base end)"


def _sql(select: str) -> str:
    return f"select doc_id, {select} from ({_PATHS_SQL})"


@register("path_kind", _sql(f"path, base, {_KIND.format(p='path', b='base')} as kind"))
def q_path_kind(spark, sf_dir):
    """#10: absolute / relative / relative_incomplete / invalid."""
    return _paths(spark, sf_dir).select("doc_id", "path", "base", P.path_kind("path", "base").alias("kind"))


@register("path_complete", _sql(f"""
  case when {_KIND.format(p='path', b='null')} = 'relative_incomplete' then 'relative'
       else {_KIND.format(p='path', b='null')} end as kind,
  case when {_KIND.format(p='path', b='null')} = 'relative_incomplete' then base end as base_dir,
  path as rel"""))
def q_path_complete(spark, sf_dir):
    """#11: a base filled in only where it is missing."""
    p = P.path_complete(P.make_path("path"), F.col("base"))
    return _paths(spark, sf_dir).select("doc_id", p["kind"].alias("kind"), p["base_dir"].alias("base_dir"),
                                        p["rel"].alias("rel"))


@register("path_full", _sql(f"""case {_KIND.format(p='path', b=_B2)}
    when 'absolute' then path
    when 'relative' then (case when ends_with({_B2}, '/') then {_B2} || path else {_B2} || '/' || path end)
  end as full_path"""))
def q_path_full(spark, sf_dir):
    """#12: base joined with the relative part."""
    return _paths(spark, sf_dir).select("doc_id", P.path_full(P.make_path("path", "base")).alias("full_path"))


@register("path_compact", _sql(f"""case when {_KIND.format(p='path', b=_B2)} in ('absolute', 'relative')
  then path end as compact_path"""))
def q_path_compact(spark, sf_dir):
    """#13: absolute path, or the relative part."""
    return _paths(spark, sf_dir).select("doc_id", P.path_compact(P.make_path("path", "base")).alias("compact_path"))


@register("path_filename", _sql(f"""case when {_COMPS.format(p='path')}[-1] <> '..'
  then {_COMPS.format(p='path')}[-1] end as file_name"""))
def q_path_filename(spark, sf_dir):
    """#14: last component; null for '/', '.' and '..'."""
    return _paths(spark, sf_dir).select("doc_id", P.path_filename(P.make_path("path", "base")).alias("file_name"))


@register("path_base_dir", _sql(f"""case {_KIND.format(p='path', b=_B2)}
    when 'absolute' then (case when len({_COMPS.format(p='path')}) = 0 then null
        else '/' || array_to_string({_COMPS.format(p='path')}[1:len({_COMPS.format(p='path')}) - 1], '/') end)
    when 'relative' then {_B2} end as base_dir"""))
def q_path_base_dir(spark, sf_dir):
    """#15: parent of an absolute path, base of a relative one."""
    return _paths(spark, sf_dir).select("doc_id", P.path_base_dir(P.make_path("path", "base")).alias("base_dir"))


_BODY = f"array_to_string({_COMPS.format(p='path')}, '/')"


@register("path_normalize", _sql(f"""case when path is null then null
    when starts_with(path, '/') then '/' || {_BODY}
    when (path = '.' or starts_with(path, './')) and {_BODY} = '' then '.'
    when path = '.' or starts_with(path, './') then './' || {_BODY}
    else {_BODY} end as normal_path"""))
def q_path_normalize(spark, sf_dir):
    """#17: one '/' between normal components."""
    return _paths(spark, sf_dir).select("doc_id", P.path_normalize("path").alias("normal_path"))


@register("path_relativize", f"""with x as (
  select doc_id, path, dir, {_COMPS.format(p='path')} as pc, {_COMPS.format(p='dir')} as dc
  from ({_PATHS_SQL})),
y as (select *, len(list_filter(generate_series(1, least(len(pc), len(dc))),
                                lambda i: pc[1:i] = dc[1:i])) as common from x),
z as (select *, len(dc) - common as up from y)
select doc_id, case when path is null or dir is null then null
    when starts_with(path, '/') and not starts_with(dir, '/') then path
    when not starts_with(path, '/') and starts_with(dir, '/') then null
    when up > 0 and list_contains(dc[common + 1:], '..') then null
    else array_to_string(list_concat(list_transform(generate_series(1, up), lambda i: '..'), pc[common + 1:]), '/')
  end as rel_path
from z""")
def q_path_relativize(spark, sf_dir):
    """#16: each path written relative to a directory."""
    return _paths(spark, sf_dir).select("doc_id", P.path_relativize("path", "dir").alias("rel_path"))
