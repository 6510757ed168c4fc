"""Connected components of an edge list, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import counted, cut, parts_for


def _starred(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Links each node's neighbours to the least of them: the larger ones, or the others."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        out = (down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
               .union(least.select("a", F.col("least").alias("b"))))
    return out.where("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """``node`` and ``root`` (the least node of its component) of every node on an edge (a, b), and
    how many they are at most.

    Large and small stars take turns until nothing changes, a number of rounds logarithmic in the
    longest chain.  A node with very many edges is reduced to its minimum before the shuffle, and
    the join that uses it is one that adaptive execution splits.
    """
    edges, rows = counted(edges.select("a", "b").where("a <> b").distinct())
    parts = parts_for(rows)
    sign = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("sign")
    before = None
    while True:
        edges = cut(_starred(_starred(edges, True, parts), False, parts))
        now = tuple(edges.agg(*sign).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(parts)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), 2 * rows
