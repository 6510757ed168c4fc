"""Tiles of classes give the rows of the plain join, and their work doesn't grow with copies."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.operators import retrieval as T
from cohortlens.operators import score_tiles as S


def _tables(spark, trials=90, queries=40):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    # few distinct texts, so many trials and queries are equal and scores tie across classes
    rows = [(f"T{i:03}", i, c, "s", rng.choices(words, k=rng.choice([0, 1, 2, 3])) + [f"only{i}"])
            for i in range(trials) for c in range(2)]
    asked = [(f"Q{i:03}", " ".join(rng.choices(words, k=rng.choice([1, 2])) + [f"mine{i}"]))
             for i in range(queries)] + [("none", "missing"), ("null", None)]
    chunks = spark.createDataFrame(
        rows, "trial_id STRING, trial_pos BIGINT, chunk_pos INT, section STRING, tokens ARRAY<STRING>")
    return chunks, spark.createDataFrame(asked, "query_id STRING, text STRING")


def _rows(found):
    return sorted((r.query_id, r.retrieval_rank, r.trial_id, r.fixed_score, r.retrieval_score)
                  for r in found.collect())


def test_tiles_equal_the_plain_join(spark):
    chunks, queries = _tables(spark)
    postings, stats = T.build_postings(chunks)
    for k in (1, 5, 60):
        want = _rows(T.retrieve(queries, postings, stats, k, prune=False))
        assert _rows(T.retrieve(queries, postings, stats, k, tiles=True)) == want
        terms = T.query_terms(queries, stats)
        pairs = S.best_pairs(terms, postings, T._shared_tokens(terms), k, query_block=7, trial_block=9)
        assert _rows(T._best(pairs, k)) == want
    nothing = T.retrieve(queries.filter("query_id = 'none'"), postings, stats, 5, tiles=True)
    assert nothing.count() == 0


def test_long_tiles_keep_the_first_of_equal_scores(monkeypatch):
    monkeypatch.setattr(S, "_ROWS", 2)
    monkeypatch.setattr(S, "_COLS", 3)
    vec = pa.list_(pa.struct([("token_id", pa.int32()), ("n", pa.int64())]))
    counts = [1, 3, 3, 2, 3, 1, 3, 5, 0, 3]
    trials = pa.table([pa.array([bytes([i]) for i in range(10)]), pa.array(
        [[{"token_id": 1 if n else 2, "n": n or 1}] for n in counts], vec),
        pa.array(range(10), pa.int64()), pa.array([1] * 10, pa.int32())],
        names=["trial_class", "vec", "first_pos", "trials"])
    queries = pa.table([pa.array([b"a", b"b", b"c"]), pa.array(
        [[{"token_id": 1, "n": 2}], [{"token_id": 2, "n": 7}], [{"token_id": 3, "n": 1}]], vec)],
        names=["query_class", "vec"])
    out = S.best_of_blocks(queries, trials.take(pa.array([9, 3, 0, 7, 8, 6, 5, 4, 2, 1])), 4).to_pydict()
    assert list(zip(out["query_class"], out["first_pos"], out["fixed_score"])) == [
        (b"a", 7, 10), (b"a", 1, 6), (b"a", 2, 6), (b"a", 4, 6), (b"b", 8, 7)]


def test_copies_of_queries_and_trials_are_scored_once(spark, monkeypatch):
    chunks, queries = _tables(spark, 30, 10)
    more = chunks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "trial_id", F.concat("trial_id", F.lit("-"), "i")).withColumn(
        "trial_pos", F.col("trial_pos") + 1000 * F.col("i")).drop("i")
    copies = queries.unionByName(queries.withColumn("query_id", F.concat(F.lit("again"), "query_id")))
    postings, stats = T.build_postings(more)
    terms = T.query_terms(copies, stats)
    kept = []
    monkeypatch.setattr(S, "written", lambda df, name: kept.append((name, df.cache())) or kept[-1][1])
    found = S.best_pairs(terms, postings, T._shared_tokens(terms), 3)
    assert _rows(T._best(found, 3)) == _rows(T.retrieve(copies, postings, stats, 3, prune=False))
    kept = dict(kept)
    q = kept["query-classes"]
    assert q.count() == 20 and q.select("query_class").distinct().count() <= 10
    t = kept["trial-classes"]
    assert t.groupBy("trial_class").count().agg(F.max("count")).first()[0] == 3


def test_chunks_are_scored_once_for_equal_queries(spark):
    chunks, queries = _tables(spark, 30, 10)
    copies = queries.unionByName(queries.withColumn("query_id", F.concat(F.lit("again"), "query_id")))
    postings, stats = T.build_postings(chunks)
    found = T.retrieve(copies, postings, stats, 4)
    best = T.top_chunks(found, copies, chunks, stats)
    got = {(r.query_id, r.trial_id, r.chunk_rank): (r.chunk_pos, r.chunk_score) for r in best.collect()}
    terms = T.query_terms(copies, stats)
    scored = chunks.select("trial_id", "chunk_pos", F.explode("tokens").alias("token")).join(
        terms, "token").groupBy("query_id", "trial_id", "chunk_pos").agg(F.sum("weight").alias("s"))
    scores = {}
    for r in scored.join(found, ["query_id", "trial_id"]).collect():
        scores.setdefault((r.query_id, r.trial_id), []).append((-r.s, r.chunk_pos))
    want = {(*pair, n + 1): (pos, round(-s / 1e9, 3)) for pair, cs in scores.items()
            for n, (s, pos) in enumerate(sorted(cs)[:3])}
    assert got.keys() == want.keys() and all(
        got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 0.002 for x in want)


def test_found_rows_are_stored(spark):
    chunks, queries = _tables(spark, 20, 5)
    postings, stats = T.build_postings(chunks)
    for prune in (False, True):
        found = T.retrieve(queries, postings, stats, 3, prune=prune)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
