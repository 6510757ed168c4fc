"""Secret scans by multipart credential linking.

Base patterns find assigned secrets, access ids and long hexadecimal strings; their spans are always
reported.  Weak patterns find parts that say little alone: user names and passwords under loose
names, mixed strings, endpoints.  A part has a role (identifier, secret or endpoint).  Inside a scope,
a block of lines without a blank one, every part's interval is widened by ``reach`` code points
and joined with the intervals of the parts that complement it: secrets with identifiers and with
endpoints.  A weak part is reported only if such a part exists.

The join counts, with two searches in sorted starts and ends per part, the complementary intervals
that a widened one meets; pairs are never made, so a scope with very many parts costs no more than
sorting them.  A document is judged inside its own row and nothing is shuffled; whole Arrow batches
are searched on their bytes, in slices, and offsets become code points.

Results for odd input: a null or empty text has no spans; rows are judged one by one, so repeated
rows get equal spans and a null id stays null; equal spans of different kinds are all reported, in
the order of ``KINDS``; a text of any length is searched whole; an empty table gives an empty
table.  Only the id and text columns are read, whatever other columns exist.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as T

IDENTIFIER, SECRET, ENDPOINT = range(3)
COMPLEMENTS = {IDENTIFIER: (SECRET,), SECRET: (IDENTIFIER, ENDPOINT), ENDPOINT: (SECRET,)}

_LINK = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern of parts.  ``least`` counts the characters of ``group``; shorter matches are found
    (so that they take their place) and dropped.  ``classes``: one byte of each must occur.
    ``any_case``: A-Z count as a-z.
    ``needle``: every match holds this string, at most ``ahead`` bytes behind its start."""

    name: str
    pattern: str
    role: int
    group: int = 0
    least: int = 1
    weak: bool = False
    any_case: bool = False
    classes: tuple[str, ...] = ()
    needle: str = ""
    ahead: int = 0


KINDS = (
    Kind("assign", rf"(password|passwd|secret|token|api_?key){_LINK}([A-Za-z0-9+/_.=-]+)", SECRET, 2, 6,
         any_case=True),
    Kind("access", r"AKIA[A-Z0-9]+", IDENTIFIER, 0, 20),
    Kind("hex", r"[0-9a-f]+", SECRET, 0, 24),
    Kind("user", rf"(username|user|login|account|client_?id|key_?id){_LINK}([A-Za-z0-9+/_.@=-]+)", IDENTIFIER,
         2, 3, True, True),
    Kind("pass", rf"(pass|pwd|passphrase|credential|private_?key|access_?key){_LINK}([A-Za-z0-9+/_.=-]+)",
         SECRET, 2, 6, True, True),
    Kind("mixed", r"[A-Za-z0-9+/_-]+", SECRET, 0, 24, True, False, ("[a-z]", "[A-Z]", "[0-9]")),
    Kind("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20\"'<>\x7F]+", ENDPOINT, 0, 8, True,
         needle="://", ahead=16),
)


def _alphabet(pattern: str) -> np.ndarray | None:
    """The bytes of a pattern that is one repeated class."""
    found = re.fullmatch(r"(\[[^\]]+\])\+", pattern)
    if not found:
        return None
    one = re.compile(found[1].encode())
    return np.array([one.match(bytes([b])) is not None for b in range(256)])


class Finder:
    """Finds the matches of one kind in a slice of texts, none across two of them."""

    def __init__(self, kind: Kind):
        self.kind, self.alphabet = kind, _alphabet(kind.pattern)
        self.pattern = re.compile(kind.pattern.encode())
        self.classes = [re.compile(c.encode()).search for c in kind.classes]

    def of(self, texts: T.Texts, whole: bytes, lower: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the matches that are long enough, in order."""
        least, group = self.kind.least, self.kind.group
        if self.alphabet is not None:  # the matches are the runs of these bytes
            starts, ends, _ = T.word_spans(texts, self.alphabet)
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
        else:
            bounds = texts.bounds.tolist()
            if self.kind.any_case:  # patterns of such kinds are written in small letters
                whole = lower
            matches = self._at_needles if self.kind.needle else self.pattern.finditer
            spans = np.array([m.span() for a, b in pairwise(bounds) for m in matches(whole, a, b)
                              if m.end(group) - m.start(group) >= least], np.int64).reshape(-1, 2)
            starts, ends = spans[:, 0], spans[:, 1]
        if self.classes and len(starts):
            kept = np.array([all(has(whole, a, b) for has in self.classes)
                             for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            starts, ends = starts[kept], ends[kept]
        return starts, ends

    def _at_needles(self, whole: bytes, start: int, end: int) -> Iterator[re.Match]:
        """All matches, tried only where the needle is near."""
        needle, ahead = self.kind.needle.encode(), self.kind.ahead
        at = whole.find(needle, start, end)
        while at >= 0:
            found = self.pattern.search(whole, max(start, at - ahead), end)
            if found is None:
                return
            yield found
            start = found.end()
            at = whole.find(needle, start, end)


def scopes(texts: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the blocks of lines that hold a word, in order."""
    word = T.BLANK_SEPARATED[texts.data]
    inside = np.zeros(len(word) + 1, np.int64)
    np.cumsum(word, out=inside[1:])
    starts, ends, first = T.line_spans(texts)
    filled = inside[ends] > inside[starts]
    opens = np.zeros(len(starts) + 1, bool)
    opens[first[:-1]] = True
    before = np.concatenate([[False], filled[:-1]])
    after = np.concatenate([filled[1:], [False]])
    return (starts[filled & (~before | opens[:-1])],
            ends[filled & (~after | np.concatenate([opens[1:-1], [True]]))])


def linked(starts: np.ndarray, ends: np.ndarray, roles: np.ndarray, low: np.ndarray, high: np.ndarray,
           reach: int) -> np.ndarray:
    """Which parts, widened by ``reach`` within ``low`` to ``high``, meet a complementary part.

    Offsets grow over all texts and scopes, so one search serves them all.
    """
    out = np.zeros(len(starts), bool)
    left, right = np.maximum(starts - reach, low), np.minimum(ends + reach, high)
    for role, others in COMPLEMENTS.items():
        mine = np.flatnonzero(roles == role)
        for other in others:
            theirs = roles == other
            begun = np.searchsorted(np.sort(starts[theirs]), right[mine], "left")
            ended = np.searchsorted(np.sort(ends[theirs]), left[mine], "right")
            out[mine] |= begun > ended
    return out


def _found(texts: T.Texts, finders: list[Finder], reach: int) -> tuple[np.ndarray, ...]:
    """Text, kind, start and end (code points) of all spans, in the order they are reported."""
    whole, points = texts.data.tobytes(), T.code_points(texts.data)
    lower = whole.lower()
    spans = [f.of(texts, whole, lower) for f in finders]
    starts, ends = (np.concatenate([s[k] for s in spans]) for k in (0, 1))
    kinds = np.repeat(np.arange(len(finders)), [len(s[0]) for s in spans])
    home = np.searchsorted(texts.bounds, starts, "right") - 1
    scope_starts, scope_ends = scopes(texts)
    scope = np.searchsorted(scope_starts, starts, "right") - 1
    at, to = points[starts], points[ends]
    roles = np.array([f.kind.role for f in finders])[kinds]
    kept = ~np.array([f.kind.weak for f in finders])[kinds]
    if len(starts):
        kept |= linked(at, to, roles, points[scope_starts][scope], points[scope_ends][scope], reach)
    home, kinds, at, to = home[kept], kinds[kept], at[kept], to[kept]
    order = np.lexsort((kinds, at))
    home = home[order]
    zero = points[texts.bounds][home]
    return home, kinds[order], at[order] - zero, to[order] - zero


def scan(docs: DataFrame, reach: int = 300, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row the number of spans of each base kind (``n_assign`` and so on), ``base`` and ``spans``:
    base and all spans as ``kind:start:end``, joined by commas in the order of their starts."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    base = [k for k, kind in enumerate(kinds) if not kind.weak]
    counts = [f"n_{kinds[k].name}" for k in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(k) for k in kinds]
        for batch in batches:
            for texts in T.slices(batch.column(1)):
                home, kind, start, end = _found(texts, finders, reach)
                all_spans, base_spans = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
                for h, k, a, b in zip(home.tolist(), kind.tolist(), start.tolist(), end.tolist(), strict=True):
                    span = f"{kinds[k].name}:{a}:{b}"
                    all_spans[h].append(span)
                    if not kinds[k].weak:
                        base_spans[h].append(span)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)),
                     *[pa.array(np.bincount(home[kind == k], minlength=len(texts))) for k in base],
                     pa.array(map(",".join, base_spans), pa.string()),
                     pa.array(map(",".join, all_spans), pa.string())],
                    [id_col, *counts, "base", "spans"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(
        [f"`{id_col}` {id_type}", *[f"{c} bigint" for c in counts], "base string", "spans string"]))
