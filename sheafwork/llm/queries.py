"""The subpackage's queries: each operator over its whole table, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm.common import table
from sheafwork.llm.decontamination import leak_report
from sheafwork.llm.exact_dedup import exact_owners
from sheafwork.llm.html_text import extract_text
from sheafwork.llm.mixing import mixed
from sheafwork.llm.pseudo_likelihood import score_documents
from sheafwork.llm.quality import score_quality
from sheafwork.llm.repeats import repeat_report
from sheafwork.llm.sentence_spans import span_report
from sheafwork.llm.sharding import assign_shards
from sheafwork.llm.simhash import near_groups


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), length=400)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: Shares of the mixture's expected tokens.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_owners(table(spark, sf_dir, "documents"), keep="largest")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"), sentences=2, words=0, pieces=5)


OP2_SQL = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, s, md5(piece) AS h FROM (SELECT doc_id, s, hex(b[s + 1:s + 400]) AS piece FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS s FROM texts))),
again AS (SELECT doc_id, s FROM starts QUALIFY count(*) OVER (PARTITION BY h) > 1),
islands AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000000) > 400 AS fresh FROM again),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS e FROM (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM islands) GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, list(a ORDER BY a) AS aa, list(e ORDER BY a) AS ee FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(0, n_spans + 1), lambda i: hex(b[CASE WHEN i = 0 THEN 1 ELSE ee[i] + 1 END:CASE WHEN i = n_spans THEN octet_length(b) ELSE aa[i + 1] END])), ''))) END AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

OP3_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM phrases),
places AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words), sizes WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN phrases USING (phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_repeats, op3_decontamination, op4_html_text, op5_mixing, op6_simhash, op7_pseudo_likelihood, op8_exact_dedup, op9_quality, op10_sentence_spans]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats": OP2_SQL, "op3_decontamination": OP3_SQL, "op8_exact_dedup": OP8_SQL}
