"""Lexical top-k retrieval as joins over an inverted index.

Scores are sums of ``query tf x chunk tf x idf``.  The idf is held as a fixed-point integer,
so a sum does not depend on the order rows arrive in and equal texts get equal scores on any
cluster.  Because the score is linear in the term counts, trials are ranked on counts summed
over their chunks; chunk scores are only worked out for the winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..session import broadcast_if_small, shuffled, written
from .ranking import keep_first, top_n
from .score_tiles import WIDTH, best_pairs

SCALE = 10 ** 9
CHAMPIONS = 64
# pruning pays once the plain join would emit this many times the index itself
PLAIN_FACTOR = 8
# and never below this many rows, which take less time than finding out what to prune
PLAIN_ROWS = 1 << 26
# tiles cost a few short jobs, whatever the plain join would emit
TILE_ROWS = 1 << 22


def tokenize(c: Column | str, stop_words=K.STOP_WORDS) -> Column:
    """Lower-case alphanumeric tokens of two letters or more, without stop words."""
    t = F.lower(X.text_or_empty(c))
    for phrase, joined in K.PHRASE_JOINS:
        t = F.replace(t, F.lit(phrase), F.lit(joined))
    stop = X.words(stop_words)
    return F.filter(F.split(t, "[^a-z0-9]+"),
                    lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def _join(c: str) -> Column:
    return F.array_join(c, ", ")


def trial_sections(trials: DataFrame, lines: int | None = None) -> DataFrame:
    """Five text sections per trial: ``(trial_id, trial_pos, section, chunk_pos, text)``.

    All criteria lines are taken unless ``lines`` limits them (historic: 12).
    """
    shown = lambda c: F.col(c) if lines is None else F.slice(c, 1, lines)
    s = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    given = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    lit = F.lit
    overview = F.concat(
        F.col("trial_id"), lit(": "), F.col("title"), lit(". Phase: "),
        given("phase", "not specified"), lit(". Status: "), given("status", "not specified"),
        lit(". Conditions: "), _join("conditions"), lit(". Interventions: "),
        _join("interventions"), lit(". "), X.text_or_empty("summary"))
    inclusion = F.concat(
        lit("Age: minimum "), s("min_age", "none"), lit(", maximum "), s("max_age", "none"),
        lit(". Sex: "), given("sex", "all"), lit(". Allowed stages: "),
        F.when(F.size("allowed_stages") > 0, _join("allowed_stages"))
        .otherwise("not stage-restricted"),
        lit(". Maximum ECOG: "), s("max_ecog", "not specified"),
        lit(". Required prior treatments: "),
        F.when(F.size("required_prior_treatments") > 0, _join("required_prior_treatments"))
        .otherwise("none"), lit("."))
    markers = F.array_join(F.transform(F.map_entries("required_biomarkers"), lambda e: F.concat(
        e["key"], lit(" must be "), e["value"])), "; ")
    biomarkers = F.when(F.size("required_biomarkers") > 0, F.concat(
        lit("Required biomarkers: "), markers, lit("."))).otherwise(
        "No required biomarker is specified.")
    flags = F.array_join(F.transform("excluded_flags", X.spaced), "; ")
    exclusions = F.when(F.size("excluded_flags") > 0, F.concat(
        lit("Exclude patients with "), flags, lit("."))).otherwise(
        "No explicit exclusion flags are listed.")
    raw = X.strip(F.concat(
        lit("Inclusion criteria: "), F.array_join(shown("inclusion_criteria"), " "),
        lit(" Exclusion criteria: "), F.array_join(shown("exclusion_criteria"), " "),
        lit(" Raw eligibility criteria: "), X.text_or_empty("eligibility_criteria")))
    parts = [("overview", overview), ("inclusion", inclusion), ("biomarkers", biomarkers),
             ("exclusions", exclusions), ("raw_criteria", raw)]
    array = F.array(*[F.struct(lit(n).alias("section"), t.alias("text")) for n, t in parts])
    return trials.select(
        "trial_id", "trial_pos", "title", F.posexplode(array).alias("chunk_pos", "c")
    ).select("trial_id", "trial_pos", "title", "chunk_pos", "c.section", "c.text")


def index_tokens(sections: DataFrame) -> DataFrame:
    """Adds the indexed tokens of each chunk: title, section name and text."""
    head = [F.col("title")] if "title" in sections.columns else []
    return sections.withColumn("tokens", tokenize(F.concat_ws(" ", *head, "section", "text")))


def build_postings(chunks: DataFrame, *, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(postings, stats)`` of chunks with ``trial_id, trial_pos, chunk_pos, tokens``.

    ``postings``: (token, trial_id, trial_pos, tf, chunks) with counts summed per trial.
    ``stats``: (token, df, max_tf, idf) with the document frequency over chunks.  Both are
    aggregations with partial results, so a token in every chunk is pre-added per task.

    The postings are read several times by a retrieval, so they are stored once; texts are
    not tokenized again.
    """
    # sorted in its row, a chunk shows where each distinct token starts, so one aggregation
    # counts both the occurrences and the chunks
    ordered = chunks.select("trial_id", "trial_pos", F.array_sort("tokens").alias("s"))
    marked = F.transform("s", lambda t, i: F.struct(
        t.alias("token"), F.when(F.get("s", i - 1).eqNullSafe(t), F.lit(0)).otherwise(F.lit(1))
        .alias("starts")))
    terms = ordered.select("trial_id", "trial_pos", F.explode(marked).alias("m"))
    postings = terms.groupBy(F.col("m.token").alias("token"), "trial_id", "trial_pos").agg(
        F.count(F.lit(1)).alias("tf"), F.sum("m.starts").alias("chunks"))
    if store:
        postings = written(postings, "postings")
    n_chunks = chunks.agg(F.count(F.lit(1))).scalar()
    df = postings.groupBy("token").agg(
        F.sum("chunks").alias("df"), F.max("tf").alias("max_tf"),
        F.count(F.lit(1)).alias("n_trials"))
    idf = F.log(1 + (n_chunks + 1) / (F.col("df") + 1))
    stats = df.select(
        "token", "df", "max_tf", "n_trials", F.round(idf * SCALE).cast("bigint").alias("idf"))
    return postings, written(stats, "token-stats") if store else stats


def query_terms(queries: DataFrame, stats: DataFrame, text: str = "text") -> DataFrame:
    """``(query_id, token, weight, bound)``: term weight and the most a trial can gain."""
    q = (queries.select("query_id", F.explode(tokenize(text)).alias("token"))
         .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf")))
    return q.join(stats, "token").select(
        "query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"),
        (F.col("qtf") * F.col("idf") * F.col("max_tf")).alias("bound"), "max_tf", "n_trials")


def _score(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "trial_id", "trial_pos").agg(
        F.sum(F.col("weight") * F.col("tf")).alias("fixed_score"))


def _complete(cands: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Full scores of candidate pairs: their query's terms looked up by (token, trial)."""
    wanted = cands.select("query_id", "trial_id").join(
        terms.select("query_id", "token", "weight"), "query_id")
    return _score(wanted.join(postings, ["token", "trial_id"]))


def _best(scored: DataFrame, k: int) -> DataFrame:
    top = top_n(scored, ["query_id"], [F.col("fixed_score").desc(), F.col("trial_pos")], k,
                "retrieval_rank")
    return top.withColumn("_s", F.col("fixed_score") / F.lit(float(SCALE))).withColumn(
        "retrieval_score", X.round_exact("_s", 3)).drop("_s")


def _shared_tokens(terms: DataFrame) -> list[str] | None:
    """The tokens of all queries in the index; none if they are too many for tiles or scores too large for doubles."""
    tokens = [r.token for r in terms.select("token").distinct().limit(WIDTH + 1).collect()]
    if len(tokens) > WIDTH:
        return None
    total = terms.groupBy("query_id").agg(F.sum(F.col("bound").cast("decimal(38,0)")).alias("b")).agg(
        F.max("b")).first()[0] or 0
    return tokens if total < 2 ** 53 else None


def retrieve(queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int, *,
             prune: bool | None = None, champions: int = CHAMPIONS, tiles: bool | None = None) -> DataFrame:
    """Exact top ``k`` trials per query; ties by input order.  The rows found are stored.

    The plain way joins every posting of every query token and adds up.  What it emits is
    known beforehand from the token counts.  Beyond a few million rows, and if queries and index share few tokens,
    classes of equal queries are scored against classes of equal trials in tiles (:mod:`.score_tiles`).  With more tokens the plain
    way is the cheaper one while it emits some tens of millions of rows, or a few times the index.  With many queries
    a token found in a third of the trials would be emitted for each of them, and only strong postings are joined:

    1. each token's ``champions`` highest counts, added up per query and trial, give partial
       scores; the k-th best of them is a floor for the query's k-th best score;
    2. a trial whose every count stays below ``floor / sum(bounds)`` of that token's maximum
       cannot reach the floor, so a pair is kept only if one posting reaches that share;
    3. the kept pairs get their full scores by an equi-join on (token, trial).

    All give the same rows.  A query with fewer than k seeds has floor 0 and keeps every
    posting.  ``prune`` and ``tiles`` decide for the caller when given.
    """
    terms = written(query_terms(queries, stats), "query-terms")
    emitted = terms.agg(F.sum("n_trials")).first()[0] or 0 if prune is None else 0
    if tiles is None:
        tiles = prune is None and emitted > TILE_ROWS
    tokens = _shared_tokens(terms) if tiles else None
    if tokens is not None:
        return _best(best_pairs(terms, postings, tokens, k), k)
    if prune is None:
        prune = emitted > max(PLAIN_ROWS, PLAIN_FACTOR * postings.count())
    if not prune:
        return written(_best(_score(broadcast_if_small(terms).join(postings, "token")), k), "found")
    strongest = top_n(postings, ["token"], [F.col("tf").desc(), F.col("trial_pos")], champions,
                      "_c").drop("_c")
    seeds = _score(terms.join(strongest, "token"))
    ranked = top_n(seeds, ["query_id"], [F.col("fixed_score").desc(), F.col("trial_pos")], k,
                   "_r")
    floor = ranked.filter(F.col("_r") == k).select(
        "query_id", F.col("fixed_score").alias("floor"))
    total = terms.groupBy("query_id").agg(F.sum("bound").alias("total"))
    limits = total.join(floor, "query_id", "left").select(
        "query_id", (F.coalesce("floor", F.lit(0)) / F.col("total")).alias("share"))
    # counts are whole numbers, so the next one above the share is the least that reaches it; the
    # share is taken a hair smaller, so rounding can only keep more
    least = F.ceil(F.col("share") * F.col("max_tf") * (1 - 1e-12))
    probes = terms.join(limits, "query_id").select("query_id", "token", least.alias("least"))
    strong = broadcast_if_small(probes).join(
        postings.select("token", "trial_id", "tf"), "token").filter("tf >= least")
    cands = strong.select("query_id", "trial_id").distinct()
    return written(_best(_complete(cands, terms, postings), k), "found")


def top_chunks(retrieved: DataFrame, queries: DataFrame, chunks: DataFrame, stats: DataFrame,
               n: int = 3) -> DataFrame:
    """The ``n`` best chunks of each retrieved pair, as an ordered list."""
    terms = written(query_terms(queries, stats).select("query_id", "token", "weight"), "chunk-terms")
    # queries of equal terms are scored once per trial
    vec = F.array_sort(F.collect_list(F.struct("token", "weight")))
    classed = written(terms.groupBy("query_id").agg(vec.alias("vec")).select(
        "query_id", F.sha2(F.col("vec").cast("string"), 256).alias("_q"), "vec"), "chunk-queries")
    wanted = written(retrieved.select("query_id", "trial_id").join(
        shuffled(classed.select("query_id", "_q")), "query_id"), "wanted-chunks")
    pairs = wanted.select("_q", "trial_id").distinct()
    words = classed.groupBy("_q").agg(F.first("vec").alias("vec"))
    asked = pairs.join(words, "_q").select("_q", "trial_id", F.explode("vec").alias("t")).select(
        "_q", "trial_id", "t.token", "t.weight")
    parts = (chunks.join(broadcast_if_small(wanted.select("trial_id").distinct()), "trial_id",
                         "left_semi")
             .select("trial_id", "chunk_pos", "section", F.explode("tokens").alias("token"))
             .groupBy("trial_id", "chunk_pos", "section", "token")
             .agg(F.count(F.lit(1)).alias("tf")))
    scored = (asked.join(parts, ["trial_id", "token"])
              .groupBy("_q", "trial_id", "chunk_pos", "section")
              .agg(F.sum(F.col("weight") * F.col("tf")).alias("fixed")))
    best = wanted.join(top_n(scored, ["_q", "trial_id"], [F.col("fixed").desc(), F.col("chunk_pos")],
                             n, "chunk_rank"), ["_q", "trial_id"])
    rows = best.withColumn("_s", F.col("fixed") / F.lit(float(SCALE))).withColumn(
        "chunk_score", X.round_exact("_s", 3))
    return rows.select("query_id", "trial_id", "chunk_rank", "chunk_pos", "section",
                       "chunk_score")


def context_blocks(retrieved: DataFrame, best_chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Text block per retrieved pair: header, best sections, then all five sections."""
    names = best_chunks.groupBy("query_id", "trial_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_rank", "section"))),
        lambda x: x["section"]), ", ").alias("top_sections"))
    body = sections.groupBy("trial_id", "title").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_pos", "text"))),
        lambda x: x["text"]), "\n").alias("body"))
    score = F.col("retrieval_score").cast("string")
    block = F.concat_ws(
        "\n", F.concat(F.lit("--- "), F.col("trial_id"), F.lit(" | RAG score "), score,
                       F.lit(" ---")),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Top retrieved sections: "), F.col("top_sections")), F.col("body"))
    return (retrieved.join(names, ["query_id", "trial_id"]).join(body, "trial_id")
            .select("query_id", "trial_id", "retrieval_rank", block.alias("context")))


def pin_target(retrieved: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Candidate list with the target trial first (rank 1, score 1.0), no repeats, cut to n.

    ``targets``: query_id, trial_id of known trials.
    """
    cols = ["query_id", "trial_id", "retrieval_score", "_p"]
    first = targets.select("query_id", "trial_id", F.lit(1.0).alias("retrieval_score"),
                           F.lit(0).alias("_p"))
    rest = retrieved.select("query_id", "trial_id", "retrieval_score",
                            F.col("retrieval_rank").alias("_p"))
    once = keep_first(first.unionByName(rest).select(*cols), ["query_id", "trial_id"], "_p")
    return top_n(once, ["query_id"], [F.col("_p")], n, "retrieval_rank").drop("_p")


def candidates(patients: DataFrame, trials: DataFrame, k: int, *, note: str = "note",
               targets: bool = False) -> DataFrame:
    """Top-k trials of each patient's note: ``(patient_id, trial_id, rank, score)``."""
    chunks = index_tokens(trial_sections(trials))
    postings, stats = build_postings(chunks)
    queries = patients.select(F.col("patient_id").alias("query_id"), F.col(note).alias("text"))
    # four times the wanted length leaves room for the pinned trial, as in the batch job
    found = retrieve(queries, postings, stats, k * 4 if targets else k)
    if targets:
        wanted = patients.filter(F.col("target_trial_id").isNotNull()).select(
            F.col("patient_id").alias("query_id"), F.col("target_trial_id").alias("trial_id"))
        known = wanted.join(trials.select("trial_id"), "trial_id", "left_semi")
        found = pin_target(found, known, k)
    return found.withColumnRenamed("query_id", "patient_id")
