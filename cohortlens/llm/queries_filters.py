"""Queries of the rule-based operators: quality rules, URL filters and line dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import line_dedup, quality_rules, url_filters
from .tables import table

QUERIES = Registry()

#: Per document of the relation ``{docs}``: all measures and verdicts of the quality rules.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (VALUES (5), (7), (10)) sizes(n))),
twice AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
covered AS (
  SELECT doc_id, n, count(*) AS words, sum(length(d.w[p])) AS chars
  FROM (SELECT DISTINCT doc_id, n, p
        FROM (SELECT doc_id, n, unnest(range(i, i + n)) AS p FROM twice)) JOIN d USING (doc_id)
  GROUP BY doc_id, n),
by_size AS (
  SELECT doc_id, max(words) FILTER (n = 5) AS words5, max(chars) FILTER (n = 5) AS chars5,
         max(chars) FILTER (n = 7) AS chars7, max(chars) FILTER (n = 10) AS chars10
  FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, count(*) - 1 AS extra,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
by_line AS (SELECT doc_id, sum(extra) AS dups, sum(extra * chars) AS chars FROM lines GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dups, 0) AS n_dup_lines, coalesce(words5, 0) AS n_repeat_words,
         coalesce(b.chars, 0) AS dup_line_chars, coalesce(chars5, 0) AS dup5_chars,
         coalesce(chars7, 0) AS dup7_chars, coalesce(chars10, 0) AS dup10_chars
  FROM d LEFT JOIN by_size s ON s.doc_id = d.doc_id LEFT JOIN by_line b ON b.doc_id = d.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * dup5_chars <= 25 * word_chars AND 100 * dup7_chars <= 24 * word_chars
         AND 100 * dup10_chars <= 22 * word_chars AND 100 * dup_line_chars <= 20 * word_chars AS kept,
       dup_line_chars::BIGINT AS dup_line_chars, dup5_chars::BIGINT AS dup5_chars,
       dup7_chars::BIGINT AS dup7_chars, dup10_chars::BIGINT AS dup10_chars
FROM m"""


@QUERIES.add("op7_quality_rules", "LLM-07", QUALITY_SQL.format(docs="documents"))
def op7_quality_rules(spark, sf_dir):
    return quality_rules.measure(table(spark, sf_dir, "documents"))


#: The rules that every page is judged by before its host's reputation.
URL_RULES = (
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
)

ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _level_sql(children: str, parent: str, keys: str) -> str:
    """A level's members with the strength of its prior and their shrunk rates."""
    return f"""
  SELECT *, (strength * prior + bad) / (strength + n) AS rate FROM (
    SELECT c.*, least(greatest(coalesce(1 / nullif(greatest(
             sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) OVER ()
             / nullif(sum(n * prior * (1 - prior) * (n - 1)) OVER (), 0), 0), 0) - 1, 1000), 1), 1000)
           AS strength
    FROM (SELECT {children}.*, {parent}.rate AS prior FROM {children} JOIN {parent} {keys}) c)"""


URL_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {ASCII_LOWER}) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (
  SELECT host, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain,
         count(quality)::DOUBLE AS n, coalesce(sum(1 - quality), 0)::DOUBLE AS bad
  FROM p LEFT JOIN labels ON doc_id = page_id GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
root AS (SELECT (sum(bad) + 1) / (sum(n) + 10) AS rate FROM s),
s2 AS ({_level_sql('s', 'root', 'ON true')}),
d2 AS ({_level_sql('d', 's2', 'USING (suffix)')}),
h2 AS ({_level_sql('h', 'd2', 'USING (suffix, domain)')}),
b AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (strength + n + 1)) > 0.5 AS blocked FROM h2),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, r.host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN b ON r.host = b.host"""


@QUERIES.add("op9_url_filters", "LLM-09", URL_SQL)
def op9_url_filters(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    return url_filters.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES, outcome_id="doc_id")


#: Lines of the relation ``{docs}`` with what is dropped.
LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         {ASCII_LOWER}) AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{docs}}))),
k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM m GROUP BY doc_id"""


@QUERIES.add("op10_line_dedup", "LLM-10", f"""
SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256
FROM ({LINES_SQL.format(docs='documents')})""")
def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"))
