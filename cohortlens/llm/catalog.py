"""Every registered query of this package, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from ..plans.registry import Query
from . import queries_filters, queries_pairs, queries_search, queries_text, queries_tokens

QUERIES = {}
for module in (queries_filters, queries_pairs, queries_search, queries_text, queries_tokens):
    QUERIES.update(module.QUERIES)
QUERIES["pipeline"] = Query(corpus_pipeline.run, "LLM-PIPELINE", corpus_pipeline.ORACLE_SQL)
