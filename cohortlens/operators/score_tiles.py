"""Exact top-k over all pairs of distinct queries and distinct trials, scored as products of tiles.

Where queries share most of their words with most trials, the rows that an inverted index emits grow with
queries x trials x words.  Two facts bound the work instead:

* only tokens that some query has decide a score, and queries (or trials) with equal counts of them have equal scores.
  Equal ones are a *class*; each pair of classes is scored once;
* a block of query classes against a block of trial classes is a product of two matrices of whole
  numbers, exact in doubles while sums stay below 2^53, which the caller makes sure of.

Blocks have fixed sizes, so a task's memory does not grow with the tables; the pairs of blocks are dealt over
the cluster.  A trial among a query's first k is in one of the first k classes, ordered by score and by the class's first
trial; of a class at most k trials are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .ranking import top_n

#: tokens that queries and trials share, at most; matrices of a task are as wide
WIDTH = 1024
QUERY_BLOCK, TRIAL_BLOCK = 8192, 32768
_ROWS, _COLS = 512, 4096

_FOUND = "query_class BINARY, trial_class BINARY, first_pos BIGINT, trials INT, fixed_score BIGINT"


def _with_class(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """A row per key with its counts as a sorted array (``vec``) and a digest that names the class."""
    vec = F.array_sort(F.collect_list(F.struct("token_id", F.col(value).cast("bigint").alias("n"))))
    digest = F.substring(F.unhex(F.sha2(F.col("vec").cast("string"), 256)), 1, 16)
    return df.groupBy(*keys).agg(vec.alias("vec")).withColumn(name, digest)


def _block(key: str, count: int, size: int) -> tuple[Column, int]:
    blocks = -(-count // size) or 1
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), blocks


def _dense(offsets, ids, counts, place, width, start, stop):
    """Rows ``start`` to ``stop`` of ragged (token, count) lists as a matrix; tokens without a place are left out."""
    a, b = offsets[start], offsets[stop]
    rows = np.repeat(np.arange(stop - start), np.diff(offsets[start:stop + 1]))
    cols = place[ids[a:b]]
    used = cols >= 0
    out = np.zeros((stop - start, width))
    out[rows[used], cols[used]] = counts[a:b][used]
    return out


def _ragged(table: pa.Table):
    vec = table.column("vec").combine_chunks()
    offsets = vec.offsets.to_numpy() - vec.offsets[0].as_py()
    flat = vec.flatten()
    return offsets, flat.field("token_id").to_numpy(), flat.field("n").to_numpy()


def _first(rows, cols, scores, k):
    """The best ``k`` of each row: highest score, then lowest column."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k
    return rows[keep], cols[keep], scores[keep], rank[keep]


def best_of_blocks(queries: pa.Table, trials: pa.Table, k: int) -> pa.Table:
    """The best ``k`` trial classes of each query class within a pair of blocks."""
    trials = trials.sort_by([("first_pos", "ascending"), ("trial_class", "ascending")])
    q_off, q_ids, q_n = _ragged(queries)
    t_off, t_ids, t_n = _ragged(trials)
    shared = np.intersect1d(q_ids, t_ids)
    place = np.full(max(q_ids.max(initial=0), t_ids.max(initial=0)) + 1, -1)
    place[shared] = np.arange(len(shared))
    n_q, n_t, width = len(queries), len(trials), len(shared)
    left = _dense(q_off, q_ids, q_n, place, width, 0, n_q)
    floor = np.zeros(n_q)  # a pair without a shared token has no score
    empty = np.empty(0, np.int64)
    best = {a: (empty, empty, np.empty(0)) for a in range(0, n_q, _ROWS)}
    for c in range(0, n_t, _COLS):
        right = _dense(t_off, t_ids, t_n, place, width, c, min(c + _COLS, n_t)).T
        for a in best:
            b = min(a + _ROWS, n_q)
            s = left[a:b] @ right
            # trials are in order, so a later one with an equal score loses
            better = s > floor[a:b, None]
            if s.shape[1] > k and np.count_nonzero(better) > 4 * k * (b - a):
                better &= s >= np.partition(s, -k, axis=1)[:, [-k]]
            rows, cols = np.nonzero(better)
            if len(rows):
                old = best[a]
                kept = _first(np.concatenate([old[0], rows + a]), np.concatenate([old[1], cols + c]),
                              np.concatenate([old[2], s[rows, cols]]), k)
                full = kept[3] == k - 1
                floor[kept[0][full]] = kept[2][full]
                best[a] = kept[:3]
    rows, cols, scores = (np.concatenate([x[i] for x in best.values()] or [empty]) for i in range(3))
    taken = trials.select(["trial_class", "first_pos", "trials"]).take(pa.array(cols, pa.int64()))
    return pa.table([queries.column("query_class").take(pa.array(rows, pa.int64())), *taken.columns,
                     pa.array(scores.astype(np.int64))],
                    names=["query_class", "trial_class", "first_pos", "trials", "fixed_score"])


def best_pairs(terms: DataFrame, postings: DataFrame, tokens: Sequence[str], k: int,
               query_block: int = QUERY_BLOCK, trial_block: int = TRIAL_BLOCK) -> DataFrame:
    """``(query_id, trial_id, trial_pos, fixed_score)``: each query's first ``k`` trials, and maybe some behind them.

    ``tokens`` are all tokens of ``terms``, at most :data:`WIDTH`; no query's bounds add up to 2^53 or more.
    """
    spark = terms.sparkSession
    ids = F.broadcast(spark.createDataFrame(list(enumerate(sorted(tokens))), "token_id INT, token STRING"))
    q = written(_with_class(terms.join(ids, "token"), ["query_id"], "weight", "query_class"), "query-classes")
    t = _with_class(postings.join(ids, "token"), ["trial_id", "trial_pos"], "tf", "trial_class")
    # a class's first k trials; its counts stay with them
    t = written(top_n(t, ["trial_class"], [F.col("trial_pos"), F.col("trial_id")], k, "_m"), "trial-classes")
    q_classes = q.groupBy("query_class").agg(F.first("vec").alias("vec"))
    t_classes = t.groupBy("trial_class").agg(
        F.first("vec").alias("vec"), F.min("trial_pos").cast("bigint").alias("first_pos"),
        F.count(F.lit(1)).cast("int").alias("trials"))
    q_no, q_blocks = _block("query_class", q.agg(F.count_distinct("query_class")).first()[0], query_block)
    t_no, t_blocks = _block("trial_class", t.filter("_m = 1").count(), trial_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q_classes.select("*", q_no.alias("qb"), every(t_blocks).alias("tb"))
    right = t_classes.select("*", t_no.alias("tb"), every(q_blocks).alias("qb"))

    def scored(queries: pa.Table, trials: pa.Table) -> pa.Table:
        return best_of_blocks(queries, trials, k)

    found = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInArrow(scored, _FOUND)
    best = top_n(found, ["query_class"], [F.col("fixed_score").desc(), F.col("first_pos"), F.col("trial_class")],
                 k, "_c")
    # classes behind k trials with higher scores add nothing
    above = W.partitionBy("query_class").orderBy(F.col("fixed_score").desc()).rangeBetween(
        W.unboundedPreceding, -1)
    best = best.withColumn("_above", F.coalesce(F.sum("trials").over(above), F.lit(0))).filter(
        F.col("_above") < k).select("query_class", "trial_class", "fixed_score")
    members = best.join(t.select("trial_class", "trial_id", "trial_pos"), "trial_class")
    first = written(top_n(members, ["query_class"], [F.col("fixed_score").desc(), F.col("trial_pos"),
                                                     F.col("trial_id")], k, "_r"), "class-trials")
    return q.select("query_id", "query_class").join(first, "query_class").select(
        "query_id", "trial_id", "trial_pos", "fixed_score")
