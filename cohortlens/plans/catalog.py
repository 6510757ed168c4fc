"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from . import (
    queries_batches,
    queries_evaluation,
    queries_loop,
    queries_matching,
    queries_path,
    queries_quality,
    queries_responses,
    queries_text,
)

QUERIES = {}
for module in (queries_matching, queries_loop, queries_text, queries_responses,
               queries_quality, queries_path, queries_evaluation,
               queries_batches):
    QUERIES.update(module.QUERIES)
