"""A training corpus from ``documents``, in stages that each read what the stage before has kept.

1. quality rules drop repetitive and very short documents;
2. line dedup drops lines that many documents share, but for one of them;
3. the n-gram Jaccard join keeps one document of each group of near copies;
4. decontamination drops documents with passages of ``benchmark``;
5. SentencePiece encoding samples segmentations and decodes them again.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``.
The last one returns, per document and sample, digests of the pieces and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontamination, line_dedup, ngram_join, quality_rules
from cohortlens.llm.queries_tokens import sampled_digests
from cohortlens.llm.tables import table
from cohortlens.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs, chars_col="n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark_passages),
    ("sentencepiece", pieces),
]

#: Sampling cannot be said in SQL; tests compare the stages with SQL and brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
