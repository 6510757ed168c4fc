"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-level BPE: a text is cut into pieces and merges stay inside a piece.  Inside a piece the last
token of every prefix follows from those of shorter prefixes: it is the one vocabulary entry ending
there that can stand beside the last token of the prefix before it.  Two tokens can stand side by
side when replaying their merges in order of rank never merges across their border.  So one pass
gives the count at every prefix, and how many tokens a cut text has, or how much of it fits a
budget, is read from the stored counts without encoding again.

``prefixes`` stores one signed byte per code point: the change of the count when that code point is
added.  The count of a prefix is the sum of the bytes before its end, exactly what the tokenizer
gives for the prefix alone.

Results for odd input: a null or empty text has 0 bytes, 0 tokens and an empty record; repeated rows
get equal results; null ids stay null; an empty table gives an empty table.  A special token inside
a text counts as one token.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textbytes as T

#: fixed: how byte-level BPE cuts a text into pieces
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: entries kept per worker; beyond it what was not used since the last time goes, which costs time only
CACHED_PIECES = 200_000
CACHED_PAIRS = 250_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Vocabulary files write bytes as letters: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Prefix counts of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        self.number = {bytes([b]): b for b in range(256)}  # a token's number is the rank of its merge
        self.merged, self.halves = {}, [(b, b) for b in range(256)]
        for merge in model["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = [bytes(letters[c] for c in part) for part in (left, right)]
            sides = (self.number[pair[0]], self.number[pair[1]])
            self.number[pair[0] + pair[1]] = self.merged[sides] = len(self.halves)
            self.halves.append(sides)
        self.longest = max(map(len, self.number))
        self.pieces = regex.compile(PIECES).findall
        self.spaces = regex.compile(r"\s{2,}(?=\S)").finditer
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split
        self.spines = ({}, {})
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of a token, from its byte up to itself."""
        found = self.spines[side].get(token)
        if found is None:
            found = [token] if token < 256 else [*self._spine(self.halves[token][side], side), token]
            self.spines[side][token] = found
        return found

    def _can_stand(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes by rank leaves their border open."""
        lefts, rights = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            next_left = lefts[i + 1] if i + 1 < len(lefts) else math.inf
            next_right = rights[j + 1] if j + 1 < len(rights) else math.inf
            across = self.merged.get((lefts[i], rights[j]))
            # of equal merges the leftmost comes first
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left is math.inf and next_right is math.inf:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _counts(self, data: bytes) -> list[int]:
        """Tokens in each prefix of a piece."""
        number, beside = self.number, self.beside
        last, counts = [-1], [0]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = number.get(data[start:end])
                if token is None:
                    continue
                if start:
                    pair = (last[start], token)
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) >= CACHED_PAIRS:
                            beside.clear()
                        fits = beside[pair] = self._can_stand(*pair)
                    if not fits:
                        continue
                last.append(token)
                counts.append(counts[start] + 1)
                break
        return counts

    def piece(self, piece: str) -> bytes:
        """The changes of the count over the code points of a piece."""
        found = self.known.get(piece)
        if found is None:
            found = self.before.get(piece) or self._changes(piece)
            if len(self.known) >= CACHED_PIECES:
                self.before, self.known = self.known, {}
            self.known[piece] = found
        return found

    def _changes(self, piece: str) -> bytes:
        data = piece.encode()
        counts = self._counts(data)
        if len(data) != len(piece):
            ends = accumulate(len(c.encode()) for c in piece)
            counts = [0, *(counts[e] for e in ends)]
        elif len(piece) == 3 and piece[0] == "'" and piece[1:] in ("re", "ve", "ll"):
            counts[2] = 2  # cut short, an apostrophe and a letter are two pieces
        return bytes([(after - before) & 0xFF for before, after in pairwise(counts)])

    def _total(self, piece: str) -> int:
        return int(np.frombuffer(self.piece(piece), np.int8).sum())

    def _plain(self, text: str) -> np.ndarray:
        """Changes over a text without special tokens."""
        known, piece = self.known, self.piece
        changes = np.frombuffer(b"".join(
            [known.get(p) or piece(p) for p in self.pieces(text)]), np.int8)
        fixes = []
        for run in self.spaces(text):
            # the last space of a run goes to what follows; a prefix that ends there keeps it
            run_text, at = run.group(), run.end() - 1
            extra = self._total(run_text) - self._total(run_text[:-1]) - self._total(run_text[-1])
            if extra:
                fixes.append((at, extra))
        if fixes:
            changes = changes.copy()
            for at, extra in fixes:
                changes[at] += extra
                changes[at + 1] -= extra
        return changes

    def changes(self, text: str) -> np.ndarray:
        parts = self.special(text) if self.specials else [text]
        if len(parts) == 1:
            return self._plain(text)
        out = []
        for n, part in enumerate(parts):
            if n % 2 == 0:
                out.append(self._plain(part))
                continue
            # until it is complete, a special token is text that goes on from what stands before
            tail = "".join(self.pieces(parts[n - 1])[-2:])
            begun = self._plain(tail + part[:-1])[len(tail):]
            out.append(np.append(begun, np.int8(1 - int(begun.sum(dtype=np.int64)))))
        return np.concatenate(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The tables of a tokenizer file, read once per worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefixes(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and the ``prefix`` record of every row."""
    path = model or default_model()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(path)
        for batch in batches:
            for texts in T.slices(batch.column(1)):
                part = batch.slice(texts.first, len(texts))
                changes = [tables.changes(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(texts.bounds)),
                    pa.array([int(c.sum(dtype=np.int64)) for c in changes], pa.int64()),
                    pa.array([c.tobytes() for c in changes], pa.binary())],
                    [id_col, "n_bytes", "n_tokens", "prefix"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, prefix binary")


def _answers(table: DataFrame, ask: str, name: str, answer) -> DataFrame:
    keep = [c for c in table.columns if c not in ("prefix", ask)]
    rows = table.select(*keep, ask, "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(len(keep)).to_pylist()
            records = batch.column(len(keep) + 1).to_pylist()
            found = [None if q is None or r is None else
                     answer(np.cumsum(np.frombuffer(r, np.int8), dtype=np.int64), q)
                     for q, r in zip(asked, records, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep) + 1], pa.array(found, pa.int64())], [*keep, ask, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "prefix"]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{name}` bigint"]))


def tokens_in_prefix(table: DataFrame, chars_col: str) -> DataFrame:
    """Adds ``tokens``: how many tokens the first ``chars_col`` code points are (all, if fewer)."""
    def answer(counts, chars):
        at = min(chars, len(counts))
        return int(counts[at - 1]) if at > 0 else 0
    return _answers(table, chars_col, "tokens", answer)


def chars_within(table: DataFrame, budget_col: str) -> DataFrame:
    """Adds ``chars``: the longest prefix, in code points, of at most ``budget_col`` tokens."""
    def answer(counts, budget):
        fitting = np.flatnonzero(counts <= budget)
        return int(fitting[-1]) + 1 if len(fitting) and budget >= 0 else 0
    return _answers(table, budget_col, "chars", answer)
