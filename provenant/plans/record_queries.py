"""Registered queries for Records (#23, #28-#35): one Record per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions.digests import content_digest
from provenant.operators import records as R
from provenant.plans.fixtures import (
    SQL_PRESENT_NOW,
    SQL_RECORD_ENTRIES,
    contents_now,
    contents_then,
    record_includes,
    sql_rollup,
    table,
)
from provenant.plans.registry import register
from provenant.session import cut_lineage, materialize

F_REC = None  # flat: one rule for every size
F_SMALL = 16  # fan-in of the tree check: exercises 2-3 levels on the test data

_CHECKED = f"""
ent as ({SQL_RECORD_ENTRIES}),
now as ({SQL_PRESENT_NOW}),
chk as (
  select e.record_id, e.entry_pos, e.file,
         case when n.present_digest is null then 'MISSING'
              when n.present_digest = e.data_digest then 'VERIFIED' else 'FAILED' end as status,
         e.data_digest as expected, n.present_digest as actual
  from ent e left join now n on n.file = e.file),
{sql_rollup('ent', 'record_id', 'entry_pos', 'data_digest', F_REC, name='rec')},
{sql_rollup('chk', 'record_id', 'entry_pos', 'actual', F_REC, name='newr')},
vrec as (
  select r.record_id,
         case when n.digest is null then 'MISSING' when n.digest = r.digest then 'VERIFIED'
              else 'FAILED' end as status,
         r.digest as expected, n.digest as actual
  from rec r left join newr n on n.record_id = r.record_id),
vsum as (
  select record_id, count(*) filter (where status = 'VERIFIED') as n_verified,
         count(*) filter (where status = 'FAILED') as n_failed,
         count(*) filter (where status = 'MISSING') as n_missing, count(*) as n_total
  from chk group by record_id)"""


def _compact(col: str, w: int) -> str:
    front = (w - 3) // 2
    back = (w - 3) - front
    return f"(case when {col} is null then null when length({col}) <= {w} then {col} else concat(left({col}, {front}), '...', right({col}, {back})) end)"


def _entries(spark, sf_dir):
    # materialised: several consumers, and each would re-digest all contents
    return cut_lineage(R.build_record_entries(record_includes(spark, sf_dir), contents_then(spark, sf_dir)))


def _checked(spark, sf_dir):
    return R.verify_entries(_entries(spark, sf_dir), contents_now(spark, sf_dir))


def _verified(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return R.verify_record(R.verify_entries(entries, contents_now(spark, sf_dir)), R.build_records(entries))


@register("record_build_entries", f"select * from ({SQL_RECORD_ENTRIES})")
def q_record_build_entries(spark, sf_dir):
    """#28: listed files joined to present contents and digested."""
    return _entries(spark, sf_dir)


@register("record_build", f"with {sql_rollup(f'({SQL_RECORD_ENTRIES})', 'record_id', 'entry_pos', 'data_digest', F_REC)} select * from roll")
def q_record_build(spark, sf_dir):
    """#28: one Record per source with its roll-up digest."""
    return R.build_records(_entries(spark, sf_dir))


_LANG_ENTRIES = "(select lang, doc_id, sha256(text) as data_digest from documents)"


@register("rollup_digest", f"with {sql_rollup(_LANG_ENTRIES, 'lang', 'doc_id', 'data_digest', F_REC)} select * from roll")
def q_rollup_digest(spark, sf_dir):
    """#23: roll-up per language of document digests in doc_id order."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("data_digest"))
    return R.rollup_digest(d, ["lang"], "doc_id", "data_digest")


@register("rollup_tree", f"with {sql_rollup(_LANG_ENTRIES, 'lang', 'doc_id', 'data_digest', F_SMALL)} select * from roll")
def q_rollup_tree(spark, sf_dir):
    """#23 for groups larger than the fan-in: the bounded tree roll-up."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("data_digest"))
    return R.rollup_digest(d, ["lang"], "doc_id", "data_digest", fanout=F_SMALL)


@register("record_recalculate", f"""with ent as ({SQL_RECORD_ENTRIES}), now as ({SQL_PRESENT_NOW}),
re as (select e.record_id, e.entry_pos, e.file, n.present_digest as data_digest
       from ent e left join now n on n.file = e.file),
{sql_rollup('re', 'record_id', 'entry_pos', 'data_digest', F_REC)}
select * from roll""")
def q_record_recalculate(spark, sf_dir):
    """#29: the Records' paths digested again from the present contents
    (digest null where a file is gone)."""
    again = R.recalculate_record(_entries(spark, sf_dir), contents_now(spark, sf_dir), strict=False)
    return R.build_records(again)


@register("verify_entries", f"with {_CHECKED} select * from chk")
def q_verify_entries(spark, sf_dir):
    """#30: VERIFIED / FAILED / MISSING per entry."""
    return _checked(spark, sf_dir)


@register("verify_record", f"with {_CHECKED} select * from vrec")
def q_verify_record(spark, sf_dir):
    """#31: present digests rolled up against the stored Record digest."""
    return _verified(spark, sf_dir)


@register("verify_summary", f"with {_CHECKED} select * from vsum")
def q_verify_summary(spark, sf_dir):
    """#32: counts per Record."""
    return R.verify_summary(_checked(spark, sf_dir))


@register("verify_many", f"with {_CHECKED} select v.*, s.n_verified, s.n_failed, s.n_missing, s.n_total "
                         f"from vrec v left join vsum s on s.record_id = v.record_id")
def q_verify_many(spark, sf_dir):
    """#33: all Records in one job, one line each."""
    entries = _entries(spark, sf_dir)
    checked = R.verify_entries(entries, contents_now(spark, sf_dir))
    return R.verify_many(checked, R.build_records(entries))


@register("report_verify_compact", f"""with {_CHECKED}
select record_id, status,
       concat(rpad(left(record_id, 32), 32, ' '), ' ',
              case when status = 'VERIFIED' then concat('VERIFIED ', rpad({_compact('actual', 32)}, 32, ' '))
                   else concat('FAILED   ', rpad({_compact('expected', 14)}, 14, ' '), ' -> ',
                               rpad(coalesce({_compact('actual', 14)}, ''), 14, ' ')) end) as line
from vrec""")
def q_report_verify_compact(spark, sf_dir):
    """#34: the one-line verify report per Record."""
    return R.report_verify_compact(_verified(spark, sf_dir))


@register("verify_report_rows", f"""with {_CHECKED}
select c.record_id, row_number() over (partition by c.record_id order by c.entry_pos) - 1 as row_num,
       c.file, c.status, c.expected, c.actual,
       v.status as record_status, v.expected as record_expected, v.actual as record_actual
from chk c left join vrec v on v.record_id = c.record_id""")
def q_verify_report_rows(spark, sf_dir):
    """#35: per entry in Record order, beside the Record's own result."""
    entries = _entries(spark, sf_dir)
    # stored once: the rows are numbered and rolled up, the contents read one time
    checked = materialize(R.verify_entries(entries, contents_now(spark, sf_dir)))
    verified = R.verify_record(checked, R.build_records(entries))
    return R.verify_report_rows(checked, verified)


@register("content_digest_blake3")
def q_content_digest_blake3(spark, sf_dir):
    """#18 with BLAKE3 (Arrow-batched UDF): no SQL engine here has BLAKE3,
    so rows only; values are checked against goldens in the tests."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", content_digest("text", algorithm="blake3").alias("data_digest"))


@register("record_build_blake3")
def q_record_build_blake3(spark, sf_dir):
    """#23/#28 with BLAKE3: entries digested with BLAKE3, rolled up through
    BLAKE3's own tree, distributed (exact for Records of any size)."""
    inc = record_includes(spark, sf_dir)
    entries = cut_lineage(R.build_record_entries(inc, contents_then(spark, sf_dir), algorithm="blake3"))
    return R.rollup_digest_blake3(entries)
