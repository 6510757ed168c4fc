"""Queries of the operators that compare all documents with each other."""

from __future__ import annotations

from ..plans.registry import Registry
from . import ngram_join
from .queries_filters import ASCII_LOWER
from .tables import table

QUERIES = Registry()

#: Per document of the relation ``{docs}``: set size and group.
GROUPS_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII_LOWER}), '[^\x20\x09-\x0D]+') AS w
  FROM {{docs}}),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS other FROM {{docs}} UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


@QUERIES.add("op1_ngram_jaccard_join", "LLM-01", GROUPS_SQL.format(docs="documents"))
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")
