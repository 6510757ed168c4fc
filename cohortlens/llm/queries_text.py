"""Queries of the operators that search whole texts for shared passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import decontamination, substring_dedup
from .queries_filters import ASCII_LOWER
from .tables import table

QUERIES = Registry()

#: Per document of the relation ``{docs}``: words, words hit, occurring items and the verdict.
CONTAMINATION_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII_LOWER}),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {{docs}}),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII_LOWER}),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw, (SELECT DISTINCT size FROM ig))),
hit AS (SELECT doc_id, i, ig.size, item_id FROM dg JOIN ig ON dg.size = ig.size AND dg.gram = ig.gram),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id"""


@QUERIES.add("op3_decontamination", "LLM-03", CONTAMINATION_SQL.format(docs="documents"))
def op3_decontamination(spark, sf_dir):
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"),
        "contaminated")


@QUERIES.add("op5_substring_dedup", "LLM-05")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
