"""Queries of the conversation trie, the secret scan and the hard-negative search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import conversation_trie, hard_negatives, secret_scan
from .stages import cut
from .tables import table

QUERIES = Registry()

#: crc32 of a decimal id modulo 4, bit by bit.
_HEADS = """xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda y, k: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 4"""


@QUERIES.add("op11_conversation_trie", "LLM-11", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))
         || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, role, id) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 20 AS base, {_HEADS} AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS seq
  FROM h LEFT JOIN c b ON b.conv_id = h.base),
p AS (
  SELECT conv_id, len(seq) AS size, d, array_to_string(list_slice(seq, 1, d), ',') AS node,
         array_to_string(list_slice(seq, 1, d - 1), ',') AS parent,
         CASE WHEN d = 0 THEN 0 ELSE split_part(seq[d], ':', 2)::BIGINT END AS words
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (
  SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY node, d),
k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY parent, d),
s AS (
  SELECT a.node, a.d, sum(x.saved) AS saved_tokens, count(*) FILTER (k.parent IS NULL) AS n_leaves
  FROM n x LEFT JOIN k ON k.parent = x.node AND k.d = x.d
  JOIN (SELECT DISTINCT p.node AS below, p.d AS below_d, q.node, q.d FROM p JOIN p q ON q.conv_id = p.conv_id AND q.d <= p.d) a
    ON a.below = x.node AND a.below_d = x.d
  GROUP BY a.node, a.d)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node AND s.d = n.d LEFT JOIN k ON k.parent = n.node AND k.d = n.d
LEFT JOIN n up ON n.d > 0 AND up.node = n.parent AND up.d = n.d - 1""")
def op11_conversation_trie(spark, sf_dir):
    convs = conversation_trie.conversation_keys(table(spark, sf_dir, "conversations"))
    keys = conversation_trie.distinct_keys(conversation_trie.with_shared_heads(convs))
    return conversation_trie.trie(keys)


_LINK = r"""["\']?\x20*[:=]\x20*["\']?"""
#: kind, pattern with the measured characters as group 1, least length, role, weak
_PARTS = (
    ("assign", rf"(?:(?i)password|passwd|secret|token|api_?key){_LINK}([A-Za-z0-9+/_.=-]+)", 6, "secret"),
    ("access", "(AKIA[A-Z0-9]+)", 20, "id"),
    ("hex", "([0-9a-f]+)", 24, "secret"),
    ("user", rf"(?:(?i)username|user|login|account|client_?id|key_?id){_LINK}([A-Za-z0-9+/_.@=-]+)", 3, "id"),
    ("pass", rf"(?:(?i)pass|pwd|passphrase|credential|private_?key|access_?key){_LINK}([A-Za-z0-9+/_.=-]+)", 6,
     "secret"),
    ("mixed", "([A-Za-z0-9+/_-]+)", 24, "secret"),
    ("endpoint", r"""([A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20"'<>\x7F]+)""", 8, "endpoint"),
)


def _matches_sql(nth: int, kind: str, pattern: str, least: int, role: str) -> str:
    """All matches of a kind: the text is cut at marks set around them (a mark is no ASCII byte)."""
    pattern = pattern.replace("'", "''")
    mixed = (" AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
             if kind == "mixed" else "")
    return f"""
  SELECT doc_id, {nth} AS nth, '{kind}' AS kind, '{role}' AS role, pos AS a, pos + length(m) AS b FROM (
    SELECT doc_id, parts[i] AS m, list_sum(list_transform(list_slice(parts, 1, i - 1), lambda x: length(x)))::BIGINT AS pos, i
    FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'),
                                  chr(57344)) AS parts FROM d)))
  WHERE length(regexp_extract(m, '^{pattern}$', 1)) >= {least}{mixed}"""


@QUERIES.add("op12_secret_scan", "LLM-12", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(n, *part) for n, part in enumerate(_PARTS))}),
l AS (
  SELECT doc_id, i, length(line) AS size, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d))),
s AS (
  SELECT doc_id, min(pos) AS low, max(pos + size) AS high
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l WHERE filled)
  GROUP BY doc_id, block),
p AS (SELECT m.*, greatest(a - 300, low) AS low, least(b + 300, high) AS high
      FROM m JOIN s ON m.doc_id = s.doc_id AND a >= s.low AND a < s.high),
x AS (
  SELECT * FROM p WHERE nth < 3 OR EXISTS (
    SELECT 1 FROM m o WHERE o.doc_id = p.doc_id AND (o.role = 'secret') <> (p.role = 'secret') AND o.a < p.high AND o.b > p.low)),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) FILTER (nth < 3) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) AS spans
  FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id""")
def op12_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@QUERIES.add("op13_hard_negatives", "LLM-13", """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.vec, r.vec)::BIGINT AS score
  FROM r a JOIN r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5""")
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = cut(hard_negatives.whole_vectors(rows.withColumn("label", label)))
    return hard_negatives.mine(vectors, vectors.where("id % 100 = 0"))
