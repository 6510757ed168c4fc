"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of character n-grams.  All models lie in one set of sorted hash arrays, an
array of gram hashes and one of context hashes per order, with a column of log probabilities per
language.  A text gets the language whose model gives the lowest cross-entropy per character.
Certainty is a softmax of the cross-entropies whose temperature is fitted on rows that the counts
left out; texts below a fitted certainty, or unlike every language, are marked as rejected.

The models are fitted on a sample of labelled rows: ``sample_bytes`` of text in all, shared evenly
among the languages and drawn by a hash of the text.  That bounds what is collected and broadcast.
Every row is scored whole.

Results for odd input: a null text or one without letters is ``und`` with score 0 and not rejected;
repeated rows get equal results; null ids stay null; rows without language teach nothing; without
any labelled row everything is ``und``; an empty table gives an empty table.  Only the named columns
are read, and a prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T

ORDER = 4
SAMPLE_BYTES = 32 << 20
MEMO_BITS = 18
_BLOCK = 1 << 21  # character positions times languages that are scored at once

_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower-case letter per code point, a space for everything else."""
    global _folded
    if _folded is None:
        table = np.full(0x110000, 0x20, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _folded = table
    return _folded


def _characters(texts: T.Texts, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points with ``order - 1`` spaces before each text, the texts' bounds in them, and
    the number of letters per text.  Runs of spaces are one space."""
    raw = texts.data.tobytes()
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = T.code_points(texts.data)[texts.bounds]
    if len(code) != bounds[-1]:  # not valid UTF-8: text by text
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in
                 zip(texts.bounds[:-1], texts.bounds[1:], strict=True)]
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    folded = _fold_table()[code]
    letter = folded != 0x20
    letters = T.sum_by_text(letter, bounds)
    kept = np.ones(len(folded), bool)
    kept[1:] = letter[1:] | letter[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    kept[starts] = letter[starts]  # the spaces before a text stand for one at its start
    pad = order - 1
    lengths = T.sum_by_text(kept, bounds) + pad
    first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(first[-1], 0x20, np.uint32)
    inner = np.ones(first[-1], bool)
    for k in range(pad):
        inner[first[:-1] + k] = False
    out[inner] = folded[kept]
    return out, first, letters


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of grams given as columns of code points."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
    return T.mix(out)


@dataclass
class Models:
    """Sorted hash arrays of all languages: ``grams[n]`` and ``contexts[n]`` are (hashes, values)."""

    languages: list[str]
    order: int
    unseen: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0
    least_score: float = 0.0
    most_entropy: float = float("inf")

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """Of the last character of each gram (a row of code points), a column per language."""
        value = np.broadcast_to(self.unseen, (len(gram), len(self.languages)))
        for n in range(1, self.order + 1):
            columns = [gram[:, k] for k in range(self.order - n, self.order)]
            if n > 1:
                value = value + _looked_up(*self.contexts[n], _hash(columns[:-1]), 0.0)
            seen = _looked_up(*self.grams[n], _hash(columns), np.nan)
            value = np.where(np.isnan(seen), value, seen)
        return value.astype(np.float32)


def _looked_up(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where((hashes[at] == wanted)[:, None], values[at], np.float32(missing))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Models:
    """Models from the distinct grams (rows of code points) and their counts per language."""
    languages = sorted(counts)
    alphabet = len(np.unique(np.concatenate([g.ravel() for g, _ in counts.values()]))) + 1
    unseen = np.zeros(len(languages))
    grams = {n: [] for n in range(1, order + 1)}
    contexts = {n: [] for n in range(2, order + 1)}
    for at, language in enumerate(languages):
        gram, count = counts[language]
        levels = {order: (gram, count)}
        for n in range(order - 1, 0, -1):  # below the top, grams count the distinct ones before them
            gram, inverse = np.unique(levels[n + 1][0][:, 1:], axis=0, return_inverse=True)
            levels[n] = (gram, np.bincount(inverse.ravel(), minlength=len(gram)))
        lower_hash = lower = None
        for n in range(1, order + 1):
            gram, count = levels[n]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
            if n == 1:
                total = count.sum()
                rest = discount * len(count) / total / alphabet
                unseen[at] = np.log(rest)
                value = np.maximum(count - discount, 0) / total + rest
            else:
                context, inverse = np.unique(_hash([gram[:, k] for k in range(n - 1)]), return_inverse=True)
                total = np.bincount(inverse, count)
                share = discount * np.bincount(inverse) / total
                contexts[n].append((at, context, np.log(share)))
                below = lower[np.searchsorted(lower_hash, _hash([gram[:, k] for k in range(1, n)]))]
                value = np.maximum(count - discount, 0) / total[inverse] + share[inverse] * below
            key = _hash([gram[:, k] for k in range(n)])
            sort = np.argsort(key)
            lower_hash, lower = key[sort], value[sort]
            grams[n].append((at, lower_hash, np.log(lower)))

    def joined(parts, missing):
        hashes = np.unique(np.concatenate([h for _, h, _ in parts]))
        values = np.full((len(hashes), len(languages)), missing, np.float32)
        for at, own, value in parts:
            values[np.searchsorted(hashes, own), at] = value
        return hashes, values
    return Models(languages, order, unseen, {n: joined(p, np.nan) for n, p in grams.items()},
                  {n: joined(p, 0.0) for n, p in contexts.items()})


class Scorer:
    """Cross-entropies of texts, with a memo of grams of fixed size."""

    def __init__(self, models: Models):
        self.models = models
        self.keys = np.zeros(1 << MEMO_BITS, np.uint64)
        self.values = np.zeros((1 << MEMO_BITS, len(models.languages)), np.float32)

    def _values(self, gram: np.ndarray) -> np.ndarray:
        key = _hash([gram[:, k] for k in range(gram.shape[1])])
        slot = (key >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != key)
        if len(missed):
            _, first, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
            fresh = missed[first]
            found = self.models.log_probabilities(gram[fresh])
            out[missed] = found[inverse]
            # of grams that share a slot the last one written must own both arrays
            last = len(fresh) - 1 - np.unique(slot[fresh][::-1], return_index=True)[1]
            self.keys[slot[fresh[last]]], self.values[slot[fresh[last]]] = key[fresh[last]], found[last]
        return out

    def entropies(self, texts: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character for each language, characters and letters of each text."""
        order = self.models.order
        code, first, letters = _characters(texts, order)
        ends = np.arange(len(code))
        inner = np.ones(len(code), bool)
        for k in range(order - 1):
            inner[first[:-1] + k] = False
        ends = ends[inner]
        lengths = np.diff(first) - (order - 1)
        home = np.repeat(np.arange(len(texts)), lengths)
        total = np.zeros((len(texts), len(self.models.languages)))
        block = max(_BLOCK // len(self.models.languages), 1)
        for start in range(0, len(ends), block):
            part = ends[start:start + block]
            values = self._values(np.stack([code[part - k] for k in range(order - 1, -1, -1)], axis=1))
            low = home[start]
            own = home[start:start + block] - low
            for k in range(values.shape[1]):
                sums = np.bincount(own, values[:, k])
                total[low:low + len(sums), k] += sums
        return -total / np.maximum(lengths, 1)[:, None], lengths, letters


def _entropy_rows(rows: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with ``letters``, ``length`` and ``entropies`` of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    rows = rows.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        width = len(scorer.models.languages)
        for batch in batches:
            for texts in T.slices(batch.column(len(keep))):
                found, lengths, letters = scorer.entropies(texts)
                offsets = pa.array(np.arange(len(texts) + 1) * width, pa.int32())
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(letters), pa.array(lengths),
                     pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
                    [*keep, "letters", "length", "entropies"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join(
        [*fields, "letters bigint", "length bigint", "entropies array<double>"]))


def _softmax(entropies: str, length: str, temperature):
    """Probability of every language: evidence grows with the length, up to 100 characters."""
    low = F.array_min(entropies)
    weight = F.least(F.col(length), F.lit(100)) * temperature
    raised = F.transform(entropies, lambda e: F.exp(-(e - low) * weight))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """Counts of all grams per ``lang``, summed within batches first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for texts in T.slices(batch.column(1)):
                code, first, _ = _characters(texts, order)
                at = T.windows(first, order)
                home = np.searchsorted(first, at, "right") - 1
                gram = np.stack([code[at + k] for k in range(order)], axis=1)
                names, which = np.unique(langs[texts.first:texts.first + len(texts)].astype(str),
                                         return_inverse=True)
                for k, name in enumerate(names):
                    own = gram[which[home] == k]
                    if not len(own):
                        continue
                    _, index, count = np.unique(_hash([own[:, j] for j in range(order)]),
                                                return_index=True, return_counts=True)
                    text = np.ascontiguousarray(own[index]).view(f"<U{order}").ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(index)), pa.array(text.tolist(), pa.string()),
                         pa.array(count)], ["lang", "gram", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        sample_bytes: int = SAMPLE_BYTES) -> Models | None:
    """Models of all languages in ``labelled``; None without any labelled text."""
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.size for r in rows.groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("size")).collect()}
    if not sizes:
        return None
    share = sample_bytes / len(sizes)
    drawn = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    chance = F.coalesce(*[F.when(F.col("lang") == lang, min(1.0, share / max(size, 1)))
                          for lang, size in sorted(sizes.items())])
    sample = rows.where(drawn < chance)
    # one row in eight is left out of the counts to fit the certainty on
    aside = F.pmod(F.xxhash64(F.lit("aside"), "text"), F.lit(8)) == 0
    table = _gram_counts(sample.where(~aside), order).toArrow()
    if not table.num_rows:  # a handful of rows: learn from all of them
        table = _gram_counts(sample, order).toArrow()
    if not table.num_rows:
        return None
    langs = np.array(table["lang"].to_pylist())
    gram = np.array(table["gram"].to_pylist(), f"<U{order}").view("<u4").reshape(-1, order)
    count = table["n"].to_numpy()
    models = kneser_ney({lang: (gram[langs == lang], count[langs == lang])
                         for lang in np.unique(langs).tolist()}, order)
    return _calibrated(models, sample.where(aside))


def _calibrated(models: Models, aside: DataFrame) -> Models:
    """Temperature of least log loss; certainty and entropy that all but few right answers pass."""
    rows = _entropy_rows(aside, models, ["lang"]).where("letters > 0")
    place = F.array_position(F.array(*[F.lit(x) for x in models.languages]), F.col("lang"))
    grid = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0]
    rows = rows.withColumn("place", place.cast("int")).where("place > 0")
    losses = rows.agg(*[F.avg(-F.log(F.greatest(F.element_at(
        _softmax("entropies", "length", F.lit(t)), F.col("place")), F.lit(1e-9)))).alias(f"t{i}")
        for i, t in enumerate(grid)]).first()
    if losses[0] is None:
        return models
    models.temperature = grid[int(np.argmin(losses))]
    right = rows.where(F.array_position("entropies", F.array_min("entropies")) == F.col("place"))
    limits = right.agg(
        F.percentile_approx(F.array_max(_softmax("entropies", "length", F.lit(models.temperature))),
                            0.005, 10000).alias("score"),
        F.percentile_approx(F.array_min("entropies"), 0.999, 10000).alias("entropy")).first()
    if limits.score is not None:
        models.least_score, models.most_entropy = limits.score, 1.1 * limits.entropy
    return models


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score`` (0 to 1), ``entropy`` (best, nats per character), ``rejected``."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if models is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"),
                           F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"),
                           F.lit(False).alias("rejected"))
    found = _entropy_rows(rows, models, ["id"])
    languages = F.array(*[F.lit(x) for x in models.languages])
    best = F.array_position("entropies", F.array_min("entropies")).cast("int")
    known = F.col("letters") > 0
    certainty = F.array_max(_softmax("entropies", "length", F.lit(models.temperature)))
    return found.select(
        F.col("id").alias(id_col),
        F.when(known, F.element_at(languages, best)).otherwise("und").alias("lang_pred"),
        F.when(known, certainty).otherwise(0.0).alias("score"),
        F.when(known, F.array_min("entropies")).alias("entropy"),
        (known & ((certainty < models.least_score)
                  | (F.array_min("entropies") > models.most_entropy))).alias("rejected"))
