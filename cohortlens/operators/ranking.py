"""Ranks, top-n, keep-first/last and order-dependent windows that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..session import written

BLOCK = 1 << 20


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    Spark limits each task's share of a key before the shuffle (window group limit), so a
    key with a third of all rows sends at most ``n`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], pos: Column | str) -> DataFrame:
    return top_n(df, keys, [X.col(pos).asc()], 1, "_rn").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], pos: Column | str) -> DataFrame:
    return top_n(df, keys, [X.col(pos).desc()], 1, "_rn").drop("_rn")


def full_rank(df: DataFrame, keys: Sequence[str], levels: Sequence[tuple[str, bool]], pos: str,
              rank: str = "rank", ranges: int | None = None) -> DataFrame:
    """Rank *all* rows of each key by ``levels`` (name, ascending) and then ``pos``.

    Rows are dealt by sampled ranges of their whole order, (key, levels, pos), so a hot key fills as
    many tasks as its rows need, whether its scores are few or all distinct.  Each range is sorted
    by itself and its rows numbered; counts per (key, range), summed over the ranges before,
    say how many rows of the key lie ahead.  The only window runs over those counts, of which a
    key has one per range.

    The input is written once, for the sample and the ranges must see the same rows, and the
    numbered rows once, for counts and rows must see the same ranges.  Select the columns that
    are needed before.  Rows equal in key, levels and ``pos`` get different ranks in any order.
    """
    order = [*[F.col(k).asc() for k in keys],
             *[F.col(n).asc() if asc else F.col(n).desc() for n, asc in levels], F.col(pos).asc()]
    rows = written(df, "ranked")
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order)
    placed = written(dealt.sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "places")
    cells = placed.withColumn("_range", F.shiftright("_at", 33))  # the partition's number
    cell = [*keys, "_range"]
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = (cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
             .withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    ahead = ahead.select("_ahead", "_first", *[F.col(c).alias(f"_k{n}") for n, c in enumerate(cell)])
    same = reduce(lambda a, b: a & b, [
        F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(cell)])
    return cells.join(ahead, same).select(
        *df.columns, (F.col("_ahead") + F.col("_at") - F.col("_first") + 1).alias(rank))


def carry_forward(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str,
                  block: int = BLOCK) -> DataFrame:
    """Last non-NULL ``value`` up to each row, in blocks so no key is one task's work.

    Inside a block a window carries the value; one summary row per block hands the last
    value on to the blocks after it.
    """
    cell = [*keys, "_blk"]
    rows = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block))).withColumn("_v", value)
    inside = W.partitionBy(*cell).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    rows_in = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    last = (rows.filter(F.col("_v").isNotNull())
            .groupBy(*cell).agg(F.max_by("_v", F.col(pos)).alias("_last")))
    blocks = rows.select(*cell).distinct().join(last, cell, "left")
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(*cell, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return rows_in.join(carry, cell).select(
        *df.columns, F.coalesce("_in", "_carry").alias(out))


def head_rows(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The first ``n`` rows in input order (a bare limit has no order)."""
    return df.filter(F.col(pos) < n)


def with_position(df: DataFrame, name: str) -> DataFrame:
    """Ordinal of rows that have none, in the order of their partitions.

    Rows of files get their place from :func:`cohortlens.sources.readers.with_file_order`.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def recommend_top(decided: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` trials per patient by score, recommended first, input order on ties."""
    return top_n(decided, ["patient_id"], [
        F.col("score").desc(), (F.col("decision") == "recommend").desc(), F.col("trial_pos"),
    ], n)


def rank_report(recs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All pairs of a patient ranked by label weight, report score and retrieval score."""
    weighted = recs.withColumn(
        "_w", X.mapped("eligibility", K.ELIGIBILITY_WEIGHT, 0))
    return full_rank(
        weighted, ["patient_id"],
        [("_w", False), ("recommendation_score", False), ("retrieval_score", False)],
        "retrieval_pos", ranges=ranges).drop("_w")


def bucket_ranks(assessed: DataFrame, *, descending: bool = True,
                 pos: str = "trial_pos", ranges: int | None = None) -> DataFrame:
    """Rank inside each eligibility bucket by satisfied count, then trial.

    ``descending=False`` ranks the trial with the fewest satisfied criteria first.
    """
    return full_rank(assessed, ["patient_id", "eligibility"], [("satisfied", not descending)],
                     pos, rank="bucket_rank", ranges=ranges)


def numeric_suffix_key(question_id: Column | str, patient_id: Column | str) -> Column:
    """Sort key of a question id: its number, ids of another form last."""
    q = X.col(question_id)
    n = F.nullif(F.regexp_extract(q, r"Q(\d+)$", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.when(F.startswith(q, X.col(patient_id)), n), F.lit((1 << 63) - 1))


def batches(df: DataFrame, pos: str, size: int, ranges: int | None = None) -> DataFrame:
    """Number rows by ``pos`` and cut them into batches of ``size`` (from 1).

    The numbering is the blocked rank, so no task sees the whole table.
    """
    numbered = full_rank(df.withColumn("_all", F.lit(1)), ["_all"], [], pos, "row_no", ranges)
    return numbered.drop("_all").withColumn(
        "batch", (F.floor((F.col("row_no") - 1) / F.lit(max(1, size))) + 1).cast("int"))


def sample_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """A bounded, ordered sample for a report, beside an exact count."""
    return df.orderBy(*order).limit(n)


def lower_percentile(df: DataFrame, keys: Sequence[str], value: str,
                     points: Sequence[float], block: float = 1000.0) -> DataFrame:
    """The element at index ``int((n-1)*p)`` of each key's sorted values, exactly.

    Counts per distinct value first; then whole blocks of values are skipped by their
    cumulative counts and only the block that holds the wanted index is looked into.
    """
    keys = list(keys)
    hist = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_blk", F.floor(F.col(value) / F.lit(block))))
    blocks = hist.groupBy(*keys, "_blk").agg(F.sum("_n").alias("_bn"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    upto = part.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    want = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    hit = (blocks.withColumn("_off", F.coalesce(F.sum("_bn").over(upto), F.lit(0)))
           .withColumn("_total", F.sum("_bn").over(part))
           .withColumn("p", want)
           .withColumn("_idx", F.floor((F.col("_total") - 1) * F.col("p")))
           .filter((F.col("_idx") >= F.col("_off"))
                   & (F.col("_idx") < F.col("_off") + F.col("_bn"))))
    inside = W.partitionBy(*keys, "p").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (hit.join(hist, [*keys, "_blk"])
            .withColumn("_cum", F.sum("_n").over(inside) + F.col("_off"))
            .filter(F.col("_cum") > F.col("_idx"))
            .groupBy(*keys, "p").agg(F.min(value).alias("percentile")))
