"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths find the n-grams that a text holds twice or more;
the characters they cover, and those in repeated lines, are measured against all characters in words.

Results for odd input: a null or empty text has no words, so every measure is 0 and the base rule
rejects it.  Rows are judged one by one: repeated rows get equal verdicts, a null id stays null, no
row is dropped by ``measure``.  An empty table gives an empty table.  Of the input only the id and
text columns are read by ``measure``; ``keep_good`` returns the input's own columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Most that a kept text may have, in percent of the characters in words."""

    least_words: int = 10
    repeat_words_pct: int = 20
    ngram_chars_pct: tuple[tuple[int, int], ...] = ((5, 25), (7, 24), (10, 22))
    line_chars_pct: int = 20


def _measures(texts: T.Texts, limits: Limits) -> dict[str, np.ndarray]:
    data, hashes = texts.data, T.PrefixHash(texts.data)
    starts, ends, first = T.word_spans(texts, T.BLANK_SEPARATED)
    points = T.code_points(data)
    word_chars = points[ends] - points[starts]
    out = {
        "n_words": np.diff(first), "word_chars": T.sum_by_text(word_chars, first),
        "n_symbols": T.sum_by_text(_SYMBOL[data], texts.bounds),
    }
    # a text's number goes into every key, so equal keys are repeats within one text
    salt = T.mix(T.owner(first).astype(np.uint64))
    words = T.mix(hashes.of(starts, ends) ^ salt)
    for size in sorted({5, *dict(limits.ngram_chars_pct)}):
        at = T.windows(first, size)
        twice, _ = T.repeated(T.combined(words, at, size))
        steps = (np.bincount(at[twice], minlength=len(words) + 1)
                 - np.bincount(at[twice] + size, minlength=len(words) + 1))
        covered = np.cumsum(steps[:-1]) > 0
        if size == 5:
            out["n_repeat_words"] = T.sum_by_text(covered, first)
        if size in dict(limits.ngram_chars_pct):
            out[f"dup{size}_chars"] = T.sum_by_text(word_chars * covered, first)
    line_starts, line_ends, line_first = T.line_spans(texts)
    line_text = T.owner(line_first)
    inside = np.zeros(len(words) + 1, np.int64)
    np.cumsum(word_chars, out=inside[1:])
    chars = inside[np.searchsorted(starts, line_ends)] - inside[np.searchsorted(starts, line_starts)]
    keys = T.mix(hashes.of(line_starts, line_ends) ^ T.mix(line_text.astype(np.uint64)))
    again = np.zeros(len(keys), bool)
    with_word = chars > 0
    again[with_word] = T.repeated(keys[with_word])[1]
    out["n_dup_lines"] = T.sum_by_text(again, line_first)
    out["dup_line_chars"] = T.sum_by_text(chars * again, line_first)
    out["base_failed"] = (out["n_words"] < limits.least_words) | (
        100 * out["n_repeat_words"] > limits.repeat_words_pct * out["n_words"])
    good = 100 * out["dup_line_chars"] <= limits.line_chars_pct * out["word_chars"]
    for size, pct in limits.ngram_chars_pct:
        good &= 100 * out[f"dup{size}_chars"] <= pct * out["word_chars"]
    out["kept"] = good & ~out["base_failed"]
    return out


def _columns(limits: Limits) -> list[str]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "dup_line_chars"]
    return names + [f"dup{size}_chars" for size, _ in limits.ngram_chars_pct]


def measure(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """The id and all measures and verdicts of every row."""
    names = _columns(limits)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in T.slices(batch.column(1)):
                found = _measures(texts, limits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)),
                     *[pa.array(found[n]) for n in names]], [id_col, *names])

    kinds = {"base_failed": "boolean", "kept": "boolean"}
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(
        [f"`{id_col}` {id_type}", *[f"{n} {kinds.get(n, 'bigint')}" for n in names]]))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_measures(texts, limits)["kept"] for texts in T.slices(batch.column(place))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
