"""Line dedup across documents: lines found in many documents stay in one of them.

Lines are exploded, normalised and hashed; documents are counted per hash; hashes over the
threshold name the lines to drop, and each text is put together again from the positions left.
Only hashes and positions are shuffled for the counts.  A hash that very many documents share is
counted before the shuffle, and the join that finds its lines is one that adaptive execution splits.

Results for odd input: a null or empty text is one empty line.  Rows of one id
count as one document and get equal results if their texts are equal; where several rows hold the
largest id, all of them keep the line.  A null id counts as no document and ranks below all others.  Texts left without lines become empty,
their rows stay.  An empty table gives an empty table.  Only the id and text columns are read;
``drop_lines`` returns the input's own columns, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strip

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z as a-z."""
    return F.translate(strip(line), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """128 bits in two columns: two keys of one hash are not to be expected at any size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Positions to drop per id and text.  ``docs`` has ``id``, ``text_hash`` and ``text``."""
    long_enough = F.length("key") >= min_chars
    keys = docs.select("id", F.explode(F.array_distinct(
        F.transform(_lines(F.col("text")), line_key))).alias("key")).where(long_enough)
    frequent = (keys.select("id", *_hashes(F.col("key"))).distinct()
                .groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keeper"))
                .where(F.col("n") >= min_docs).drop("n"))
    places = (docs.select("id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
              .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
              .where(long_enough).select("id", "text_hash", "pos", *_hashes(F.col("key"))))
    return (places.join(frequent, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: ``row`` (the input row as a struct), ``kept_text``, ``n_lines``,
    ``n_dropped``."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
        docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    drops = _dropped(rows.drop("row"), min_chars, min_docs).select(
        F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drop")
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id"))
                       & (F.col("text_hash") == F.col("drop_hash")), "left")
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    return (joined.select("row", lines.alias("lines"),
                          F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
            .select("row",
                    F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
                    F.size("lines").cast("bigint").alias("n_lines"),
                    F.size("drop").cast("bigint").alias("n_dropped")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               chars_col: str | None = None, **limits: int) -> DataFrame:
    """The input with its texts deduplicated; ``chars_col``, if named, gets their new lengths."""
    new = {text_col: F.col("kept_text")}
    if chars_col is not None:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.length("kept_text").cast(kind)
    return dedup(docs, id_col, text_col, **limits).select(
        *[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
