"""Registered queries for record comparison (#36-#46) on two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions.paths import file_name
from provenant.operators import compare as C
from provenant.plans.fixtures import SQL_ENTRIES_A, SQL_ENTRIES_B, entries_a, entries_b, sql_file_name
from provenant.plans.registry import register

_FN = sql_file_name("file")

_UNIQUE = """(select {k} as k, min(entry_pos) as p from {t} where {k} is not null
             group by {k} having count(*) = 1)"""

COMPARE_CTE = f"""
with a as ({SQL_ENTRIES_A}),
b as ({SQL_ENTRIES_B}),
a1 as (select *, data_digest as k1 from a),
b1 as (select *, data_digest as k1 from b),
m1 as (select x.k as k, x.p as pa, y.p as pb
       from {_UNIQUE.format(k='k1', t='a1')} x join {_UNIQUE.format(k='k1', t='b1')} y on x.k = y.k),
a2 as (select *, {_FN} as k2 from a1 where entry_pos not in (select pa from m1)),
b2 as (select *, {_FN} as k2 from b1 where entry_pos not in (select pb from m1)),
m2 as (select x.k as k, x.p as pa, y.p as pb
       from {_UNIQUE.format(k='k2', t='a2')} x join {_UNIQUE.format(k='k2', t='b2')} y on x.k = y.k),
ra as (select * from a2 where entry_pos not in (select pa from m2)),
rb as (select * from b2 where entry_pos not in (select pb from m2)),
diff as (
  select case when a.data_digest = b.data_digest then 'same' else 'changed' end as class,
         'Hash' as tier, 0 as tier_idx, m1.k as match_key,
         a.entry_pos as entry_pos_1, a.file as file_1, a.data_digest as digest_1,
         b.entry_pos as entry_pos_2, b.file as file_2, b.data_digest as digest_2,
         concat('Hash:', m1.k) as attempt_trail, null as k1, null as k2
  from m1 join a on a.entry_pos = m1.pa join b on b.entry_pos = m1.pb
  union all
  select case when a2.data_digest = b2.data_digest then 'same' else 'changed' end,
         'FileName', 1, m2.k,
         a2.entry_pos, a2.file, a2.data_digest, b2.entry_pos, b2.file, b2.data_digest,
         concat_ws(' > ', 'Hash:' || a2.k1, 'FileName:' || m2.k), null, null
  from m2 join a2 on a2.entry_pos = m2.pa join b2 on b2.entry_pos = m2.pb
  union all
  select 'undetermined_1',
         case when k2 is not null then 'FileName' when k1 is not null then 'Hash' end,
         null, coalesce(k2, k1), entry_pos, file, data_digest, null, null, null,
         concat_ws(' > ', 'Hash:' || k1, 'FileName:' || k2), k1, k2
  from ra
  union all
  select 'undetermined_2',
         case when k2 is not null then 'FileName' when k1 is not null then 'Hash' end,
         null, coalesce(k2, k1), null, null, null, entry_pos, file, data_digest,
         concat_ws(' > ', 'Hash:' || k1, 'FileName:' || k2), k1, k2
  from rb
)"""

_DIFF_COLS = ("class, tier, match_key, entry_pos_1, file_1, digest_1, "
              "entry_pos_2, file_2, digest_2, attempt_trail")

_REPORT_ROWS = """
  select *, row_number() over (
      partition by class
      order by coalesce(tier_idx, 0),
               case when tier_idx is not null then match_key else k2 end asc nulls last,
               case when tier_idx is null then k1 end asc nulls last,
               coalesce(entry_pos_1, entry_pos_2)) - 1 as row_num
  from diff"""


def diff_frame(spark, sf_dir):
    return C.record_diff(entries_a(spark, sf_dir), entries_b(spark, sf_dir))


def _diff_out(df):
    return df.select(
        "class", "tier", "match_key", "entry_pos_1", "file_1", "digest_1",
        "entry_pos_2", "file_2", "digest_2", C.attempts_text().alias("attempt_trail"),
    )


@register("record_diff", f"{COMPARE_CTE} select {_DIFF_COLS} from diff")
def q_record_diff(spark, sf_dir):
    """Flagship: tiered compare (digest, then file name) of two snapshots."""
    return _diff_out(diff_frame(spark, sf_dir))


@register("diff_summary", f"""{COMPARE_CTE}
select count(*) filter (where class = 'same') as same,
       count(*) filter (where class = 'changed') as changed,
       count(*) filter (where class = 'undetermined_1') as undetermined_1,
       count(*) filter (where class = 'undetermined_2') as undetermined_2,
       count(*) as total
from diff""")
def q_diff_summary(spark, sf_dir):
    return C.diff_summary(diff_frame(spark, sf_dir))


@register("match_digest", f"""with a as ({SQL_ENTRIES_A}), b as ({SQL_ENTRIES_B})
select x.k as match_key, x.p as entry_pos_1, y.p as entry_pos_2
from {_UNIQUE.format(k='data_digest', t='a')} x join {_UNIQUE.format(k='data_digest', t='b')} y on x.k = y.k""")
def q_match_digest(spark, sf_dir):
    """#38 alone: unique digest matches between the two snapshots."""
    _, key = C.digest_tier()
    m = C.unique_match(entries_a(spark, sf_dir), entries_b(spark, sf_dir), key, C.HASH_TIER)
    return m.select("match_key", "entry_pos_1", "entry_pos_2")


@register("match_filename", f"""with a as ({SQL_ENTRIES_A}), b as ({SQL_ENTRIES_B})
select x.k as match_key, x.p as entry_pos_1, y.p as entry_pos_2
from {_UNIQUE.format(k=_FN, t='a')} x join {_UNIQUE.format(k=_FN, t='b')} y on x.k = y.k""")
def q_match_filename(spark, sf_dir):
    """#39 alone: unique base-name matches between the two snapshots."""
    _, key = C.filename_tier()
    m = C.unique_match(entries_a(spark, sf_dir), entries_b(spark, sf_dir), key, C.FILENAME_TIER)
    return m.select("match_key", "entry_pos_1", "entry_pos_2")


@register("unique_match", f"""with a as ({SQL_ENTRIES_A}), b as ({SQL_ENTRIES_B})
select x.k as match_key, x.p as entry_pos_1, y.p as entry_pos_2
from {_UNIQUE.format(k="regexp_extract(file, '^[^/]+/([^/]+)/', 1) || '/' || left(data_digest, 3)", t='a')} x
join {_UNIQUE.format(k="regexp_extract(file, '^[^/]+/([^/]+)/', 1) || '/' || left(data_digest, 3)", t='b')} y on x.k = y.k""")
def q_unique_match(spark, sf_dir):
    """#37 with a user key (source folder and the digest's first digits):
    keys of one entry on either side match, repeated ones (1:n, n:m) do not."""
    key = F.concat(F.regexp_extract("file", r"^[^/]+/([^/]+)/", 1), F.lit("/"), F.substring("data_digest", 1, 3))
    m = C.unique_match(entries_a(spark, sf_dir), entries_b(spark, sf_dir), key, "source")
    return m.select("match_key", "entry_pos_1", "entry_pos_2")


@register("match_tiers", f"""{COMPARE_CTE}
select tier, match_key, entry_pos_1, entry_pos_2 from diff where class in ('same', 'changed')""")
def q_match_tiers(spark, sf_dir):
    """#40: pairs matched by the digest -> file-name chain."""
    res = C.match_tiers(entries_a(spark, sf_dir), entries_b(spark, sf_dir))
    return res["matched"].select("tier", "match_key", "entry_pos_1", "entry_pos_2")


@register("match_attempts", f"""{COMPARE_CTE}
select class, coalesce(entry_pos_1, entry_pos_2) as entry_pos,
       cast(case when attempt_trail = '' then 0
                 else len(string_split(attempt_trail, ' > ')) end as bigint) as n_attempts,
       attempt_trail
from diff""")
def q_match_attempts(spark, sf_dir):
    """#41: the keys tried for every entry, as text."""
    d = diff_frame(spark, sf_dir)
    return d.select(
        "class",
        F.coalesce("entry_pos_1", "entry_pos_2").alias("entry_pos"),
        F.size("attempts").cast("bigint").alias("n_attempts"),
        C.attempts_text().alias("attempt_trail"),
    )


@register("group_by_key", f"""with a as ({SQL_ENTRIES_A})
select {_FN} as group_key, count(*) as n_entries, min(entry_pos) as first_pos,
       {_FN} is not null as grouped
from a group by {_FN}""")
def q_group_by_key(spark, sf_dir):
    """#36: snapshot 1 grouped by base name."""
    return C.group_by_key(entries_a(spark, sf_dir), file_name("file"))


@register("diff_report_rows", f"""{COMPARE_CTE}
select class, row_num, entry_pos_1, entry_pos_2, match_key from ({_REPORT_ROWS})""")
def q_diff_report_rows(spark, sf_dir):
    """#44: numbered report rows per class."""
    rows = C.diff_report_rows(diff_frame(spark, sf_dir))
    return rows.select("class", "row_num", "entry_pos_1", "entry_pos_2", "match_key")


@register("diff_labels", f"""{COMPARE_CTE}
select class, row_num, printf('[%04d]', row_num) as number_label,
       case when match_key is not null then concat('(', tier, ')  ', match_key) end as key_label,
       file_1 as path_1, file_2 as path_2,
       case when class = 'changed' then concat(digest_1, ' -> ', digest_2)
            else coalesce(digest_1, digest_2) end as digest_label
from ({_REPORT_ROWS})""")
def q_diff_labels(spark, sf_dir):
    """#45: report labels per numbered row."""
    return C.diff_labels(C.diff_report_rows(diff_frame(spark, sf_dir)))


@register("renames", f"""{COMPARE_CTE}
select tier, match_key, entry_pos_1, file_1, entry_pos_2, file_2, digest_1 as data_digest
from diff where class = 'same' and file_1 <> file_2""")
def q_renames(spark, sf_dir):
    """#46: same content under another path."""
    return C.renames(diff_frame(spark, sf_dir))
