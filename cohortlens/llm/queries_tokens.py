"""Queries of the operators that model languages, tokens and training text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import chat_format, language_id, sentencepiece_sampling, token_counts
from .tables import table

QUERIES = Registry()


def sampled_digests(docs):
    """Two segmentations per document with digests of their pieces and of the text they decode to."""
    return sentencepiece_sampling.encode(docs, samples=2, decoded=True).select(
        "doc_id", "sample", "n_pieces", "log_prob", "log_inclusion",
        F.sha2("pieces", 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("text_sha256"))

#: A text that looks like the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def _escaped_sql(c: str) -> str:
    return (rf"replace(replace(replace(replace({c}, '\', '\\'), '<turn>', '\<turn>'), "
            rf"'</turn>', '\</turn>'), '###', '\###')")


@QUERIES.add("op6_chat_format", "LLM-06", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(replace({_escaped_sql('role')}, ':', '\:'))
           + length({_escaped_sql('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""")
def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("id"),
        F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    tricky = json.dumps({"messages": [{"role": "user", "content": TRICKY},
                                      {"role": "assistant", "content": TRICKY}]})
    one = spark.range(1).select(F.lit(-7).cast("bigint").alias("id"), F.lit(tricky).alias("record"))
    turns = chat_format.canonical_turns(rows.unionByName(one))
    return chat_format.read_back(chat_format.formatted(turns)).withColumnRenamed("id", "conv_id")


@QUERIES.add("op8_token_counts", "LLM-08")
def op8_token_counts(spark, sf_dir):
    return token_counts.prefixes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@QUERIES.add("op2_language_id", "LLM-02")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2,
                          F.lit(False))
    models = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, models).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@QUERIES.add("op4_sentencepiece_sampling", "LLM-04")
def op4_sentencepiece_sampling(spark, sf_dir):
    return sampled_digests(table(spark, sf_dir, "documents"))
