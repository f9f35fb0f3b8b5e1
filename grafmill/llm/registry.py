"""Queries opN_<name> and pipeline over the whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from grafmill.llm import chat as _op10
from grafmill.llm import exact_dedup as _op7
from grafmill.llm import html_extract as _op4
from grafmill.llm import huffman as _op5
from grafmill.llm import minhash as _op9
from grafmill.llm import packing as _op8
from grafmill.llm import pii as _op1
from grafmill.llm import quality as _op2
from grafmill.llm import toxicity as _op3
from grafmill.llm import word_bpe as _op6
from grafmill.llm.common import documents, small_batches

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_skip_chain_pii(spark, sf_dir):
    return _op1.find_pii(documents(spark, sf_dir))


def op2_line_quality(spark, sf_dir):
    return _op2.judge(documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return _op3.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_html_extract(spark, sf_dir):
    small_batches(spark)
    return _op4.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_huffman(spark, sf_dir):
    return _op5.huffman_round_trip(documents(spark, sf_dir), BYTE_BPE)


def op6_bpe(spark, sf_dir):
    return _op6.bpe_round_trip(documents(spark, sf_dir), WORD_BPE)


def op7_exact_dedup(spark, sf_dir):
    return _op7.exact_dedup(documents(spark, sf_dir))


def op8_best_fit_packing(spark, sf_dir):
    return _op8.best_fit_packing(documents(spark, sf_dir), WORD_BPE)


def op9_minhash(spark, sf_dir):
    return _op9.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op10_chat_rotation(spark, sf_dir):
    return _op10.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: f for k, f in globals().items() if (k.startswith("op") or k == "pipeline") and callable(f)}


def oracle_sql():
    found = {k[len("SQL_") :]: v for k, v in globals().items() if k.startswith("SQL_")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


SQL_op7_exact_dedup = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SQL_op2_line_quality = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM g2, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS stutter FROM w),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, stutter,
    list_filter(ls, lambda x: regexp_matches(x, '[.!?…:;]["''”’»)\]]*[\x20\x09-\x0D]*$') AND NOT regexp_matches(x, '{_op2.NAVIGATION}') AND NOT regexp_matches(x, '{_op2.SEPARATED}')
      AND NOT regexp_matches(x, '{_op2.BOILERPLATE.replace(chr(92) + "u00a9", chr(0xA9))}') AND 10 * length(regexp_replace(x, '[^#*$%&|<>{{}}=~^\\]+', '', 'g')) <= length(x)) AS good
  FROM w JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(regexp_replace(array_to_string(good, ' '), '[\x20\x09-\x0D]+', '', 'g')) AS remaining FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND remaining >= 0.5 * word_chars AND n_symbols <= 0.1 * word_chars AND stutter <= 0.3 * n_words AS kept, n_lines, CAST(len(good) AS BIGINT) AS n_lines_kept
FROM v
"""

SQL_op10_chat_rotation = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(replace(replace(url_encode(role), '.', '%2E'), '~', '%7E'), '?') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
c AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
e AS (
  SELECT t.conv_id, perspective, turn, role AS speaker, text, role = perspective AS own,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS opening
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
r AS (SELECT *, opening || text || '<|im_end|>' || chr(10) AS rendered FROM e),
p AS (
  SELECT *, row_number() OVER w - 1 AS place, CAST(coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, place, turn, speaker, rendered, start,
  CASE WHEN own THEN start + length(opening) ELSE 0 END AS mask_start, CASE WHEN own THEN start + length(rendered) - 1 ELSE 0 END AS mask_end
FROM p
"""
