"""Registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provenant.llm import (
    bpe, bwt_dedup, chat, decontaminate, fim_cut, html_text, lang_id, near_dups, periodic_runs, secret_scan, simhash_tree,
    suffix_model, vp_tree,
)
from provenant.llm.common import prepare, table

QUERIES = {}
ORACLE_SQL = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@_query
def op1_minhash_dedup(spark, sf_dir):
    """Near-duplicate component of every document."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op4_bpe_trie(spark, sf_dir):
    """Byte-level BPE of every document through the shared-prefix trie."""
    return bpe.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op8_secret_scan(spark, sf_dir):
    """Strong and linked secret spans of every document."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


@_query
def op9_language_id(spark, sf_dir):
    """Language of every document by bit-sliced Bloom filters."""
    return lang_id.language_digest(table(spark, sf_dir, "documents"))


@_query
def op10_decontaminate(spark, sf_dir):
    """Benchmark windows in every document by a suffix automaton."""
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op6_vp_tree"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op6_vp_tree(spark, sf_dir):
    """The 20 nearest vectors of every twentieth vector."""
    return vp_tree.search(table(spark, sf_dir, "embeddings"))


@_query
def op5_quote_links(spark, sf_dir):
    """Every message without quotes, in reply order by its keys."""
    return chat.link_quotes(table(spark, sf_dir, "conversations"), keep_unlinked=True)


@_query
def op2_wrapper_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op7_suffix_tree_lm(spark, sf_dir):
    """Log-probability of every document."""
    return suffix_model.score_texts(table(spark, sf_dir, "documents"))


@_query
def op3_bwt_dedup(spark, sf_dir):
    """Every document without byte strings that an earlier one has."""
    return bwt_dedup.repeat_digest(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_rank_index_fim"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u
), p AS (
  SELECT doc_id, t, n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:n], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@_query
def op11_rank_index_fim(spark, sf_dir):
    """Every document prepared for filling in its middle."""
    return fim_cut.fim_digest(table(spark, sf_dir, "documents"))


@_query
def op12_tiled_runs(spark, sf_dir):
    """Periodic runs of every document, every tenth with a repeating tail."""
    return periodic_runs.run_digest(periodic_runs.repeat_tails(table(spark, sf_dir, "documents")))


@_query
def op13_simhash_tree(spark, sf_dir):
    """Near-duplicate component of every document by its fingerprint."""
    return simhash_tree.near_fingerprints(table(spark, sf_dir, "documents"))
