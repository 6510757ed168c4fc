"""Benchmark decontamination by winnowing.

Both sides are cut into words and the hashes of all k-grams of words are taken.  Of every ``w``
consecutive k-grams the one with the smallest hash is a fingerprint, so two texts that share
``k + w - 1`` words in a row share a fingerprint there.  Fingerprints carry the hashes of the words
around them; after the join on the fingerprint a hit is extended word by word, and it counts when
the run it lies in is as long as a window.  Items shorter than a window are looked for whole: their
single fingerprint is compared with all n-grams of that length.

A bitmap of fixed size over the benchmark's fingerprints keeps documents' other fingerprints from
being shuffled.  It only saves work: with a benchmark of any size the join decides.

Results for odd input: a null or empty text has no words and no hits; items without words never
occur; repeated rows of documents get equal results, one row each; items with equal words are all
reported; a null item id is left out of the item list but its window marks hits.  An empty
benchmark marks nothing, empty documents give an empty table.  Only id and text columns are read;
``drop_contaminated`` returns the input's own columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .stages import cut

WINDOW = 13
GRAM = 7
FILTER_BITS = 24

_PRINTS = "array<struct<key:bigint,pos:int,around:array<bigint>>>"
_PRINTS_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()),
                                    ("around", pa.list_(pa.int64()))]))


def _winnowed(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints."""
    width = window - gram + 1
    at = T.windows(first, window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    hashes = T.combined(words, np.arange(len(words) - gram + 1), gram)
    reach = len(hashes) - width + 1
    best, where = hashes[:reach].copy(), np.zeros(reach, np.int8)
    for k in range(1, width):
        other = hashes[k:k + reach]
        lower = other < best
        best[lower], where[lower] = other[lower], k
    chosen = np.zeros(len(words), bool)
    chosen[at + where[at]] = True
    chosen = np.flatnonzero(chosen)
    return chosen, hashes[chosen]


def _sized(hashes: np.ndarray, size: int) -> np.ndarray:
    """Keys of grams of different lengths never meet."""
    return T.mix(hashes ^ np.uint64(size))


def _prints(texts: T.Texts, sizes: list[int] | None, window: int, gram: int,
            known: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Word counts and fingerprints per text.

    ``sizes`` are the lengths of short items to look for; ``None`` takes a short text as an item.
    ``known`` is the bitmap of wanted keys.
    """
    texts = texts.lower()
    starts, ends, first = T.word_spans(texts, T.LETTERS_AND_DIGITS)
    words = T.PrefixHash(texts.data).of(starts, ends)
    counts = np.diff(first)
    at, hashes = _winnowed(words, first, window, gram)
    positions, keys = [at], [_sized(hashes, window)]
    for size in range(1, window) if sizes is None else sizes:
        at = T.windows(first, size) if sizes is not None else first[:-1][counts == size]
        positions.append(at)
        keys.append(_sized(T.combined(words, at, size), size))
    at, keys = np.concatenate(positions), np.concatenate(keys)
    if known is not None:
        wanted = known[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        at, keys = at[wanted], keys[wanted]
    order = np.argsort(at, kind="stable")
    at, keys = at[order], keys[order]
    home = np.searchsorted(first, at, "right") - 1
    offsets = np.searchsorted(at, first)
    left = window - gram
    around = at[:, None] + np.arange(-left, window)
    inside = (around >= first[home][:, None]) & (around < first[home + 1][:, None])
    values = words[np.where(inside, around, 0)].view(np.int64)
    span = left + window
    flat = pa.array(values.ravel(), mask=~inside.ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * span, pa.int32()), flat)
    rows = pa.StructArray.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array((at - first[home]).astype(np.int32)), lists],
        ["key", "pos", "around"])
    return counts, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _with_prints(rows: DataFrame, sizes: list[int] | None, window: int, gram: int,
                 known=None) -> DataFrame:
    """From ``id``, ``text_hash``, ``text``: the first two, ``n_words`` and ``prints``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else np.unpackbits(
            np.frombuffer(known.value, np.uint8)).view(bool)
        for batch in batches:
            for texts in T.slices(batch.column(2)):
                counts, prints = _prints(texts, sizes, window, gram, bits)
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), prints.cast(_PRINTS_ARROW)],
                    ["id", "text_hash", "n_words", "prints"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, text_hash bigint, n_words bigint, prints {_PRINTS}")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("text_hash"),
                     df[text_col].alias("text"))


def _bitmap(keys: DataFrame) -> bytes:
    """One bit per leading ``FILTER_BITS`` bits of a key: at most 2 ** FILTER_BITS values come."""
    buckets = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bucket")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[buckets.toArrow()["bucket"].to_numpy()] = True
    return np.packbits(bits).tobytes()


def _run_length(doc: Column, item: Column, places: list[int]) -> Column:
    """How many of the places, from the first on, hold equal words."""
    length = F.lit(0)
    for place in reversed(places):
        length = F.when(F.get(doc, F.lit(place)) == F.get(item, F.lit(place)), 1 + length).otherwise(0)
    return length


def _extended(prints: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of equal words (``start``, ``stop``) with the ``words_key`` of the item they are in."""
    left = window - gram
    before = _run_length(F.col("around"), F.col("item_around"), list(range(left - 1, -1, -1)))
    after = _run_length(F.col("around"), F.col("item_around"), list(range(left, left + window)))
    pairs = prints.join(items, "key").select(
        "id", "text_hash", "pos", "words_key", "size",
        F.when(F.col("size") < window, 0).otherwise(before).alias("before"), after.alias("after"))
    long_enough = F.when(F.col("size") < window, F.col("after") >= F.col("size")).otherwise(
        F.col("before") + F.col("after") >= window)
    stop = F.when(F.col("size") < window, F.col("pos") + F.col("size")).otherwise(
        F.col("pos") + F.col("after"))
    return pairs.where(long_enough).select(
        "id", "text_hash", "words_key", (F.col("pos") - F.col("before")).alias("start"), stop.alias("stop"))


def _covered(spans: Column) -> Column:
    """Words in the union of spans: sorted by start, each adds what lies beyond the furthest stop."""
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, span):
        fresh = F.greatest(span["stop"] - F.greatest(span["start"], acc["stop"]), F.lit(0))
        return F.struct(F.greatest(acc["stop"], span["stop"]).alias("stop"),
                        (acc["n"] + fresh).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_hit`` and ``spans`` (start and stop of hit runs), the
    ids of the occurring items joined by commas (``items``), their number, ``contaminated``."""
    spark = docs.sparkSession
    found = cut(_with_prints(_rows(benchmark, item_id, item_text), None, window, gram))
    # items of equal words are one: their windows are compared once
    words_key = F.col("text_hash")
    items = (found.select(words_key.alias("words_key"), "n_words", F.explode("prints").alias("p"))
             .select("words_key", F.least("n_words", F.lit(window)).cast("int").alias("size"),
                     F.col("p.key").alias("key"), F.col("p.around").alias("item_around"))
             .dropDuplicates(["words_key", "key", "item_around"]))
    names = found.where(F.col("id").isNotNull()).select("id", words_key.alias("words_key")).distinct()
    sizes = sorted(r.n_words for r in found.where((F.col("n_words") > 0) & (F.col("n_words") < window))
                   .select("n_words").distinct().collect())  # fewer than ``window`` numbers
    known = spark.sparkContext.broadcast(_bitmap(items))
    rows = cut(_with_prints(_rows(docs, id_col, text_col), sizes, window, gram, known))
    prints = (rows.where(F.size("prints") > 0).dropDuplicates(["id", "text_hash"])
              .select("id", "text_hash", F.explode("prints").alias("p"))
              .select("id", "text_hash", F.col("p.key").alias("key"), F.col("p.pos").alias("pos"),
                      F.col("p.around").alias("around")))
    hits = (_extended(prints, items, window, gram).groupBy("id", "text_hash")
            .agg(F.collect_set(F.struct("start", "stop")).alias("spans"),
                 F.array_sort(F.collect_set("words_key")).alias("keys")))
    hits = cut(hits)
    # the item list of each distinct set of windows is put together once
    lists = (hits.select("keys").distinct().select("keys", F.explode("keys").alias("words_key"))
             .join(names, "words_key").groupBy("keys")
             .agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("items"))
             .select("keys", F.array_join("items", ",").alias("items"),
                     F.size("items").cast("bigint").alias("n_items")))
    hits = hits.join(lists, "keys", "left").select(
        F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items", "n_items")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0))
    return (rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id"))
                      & (F.col("text_hash") == F.col("hit_hash")), "left")
            .select(F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), "spans",
                    F.coalesce("items", F.lit("")).alias("items"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    bad = (contamination(docs, benchmark, id_col, text_col, **options).where("contaminated")
           .select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"])
                     & (F.xxhash64(docs[text_col]) == bad["bad_hash"]), "left_anti")
