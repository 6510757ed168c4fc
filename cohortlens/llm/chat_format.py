"""Chat formatting: records of many layouts become canonical turns, turns become training text.

A record's fingerprint is the hash of its nested field paths (``messages[].content``), of those
paths that any layout knows.  It selects a layout, a declarative mapping from fields to turns.
Turns are written with a template whose control strings are escaped inside texts, so that reading
back gives every text as it was; the loss mask covers the assistant's texts.

The output has a row per turn in the order of the conversation, and is read back as a stream: a
conversation of any length takes the memory of one turn.

Results for odd input: a null role or text is empty; a record that is null, no JSON object or of no
known layout gives one row without layout and turn; repeated rows are turns of their own; turns of
equal number are ordered by role and text; a null id is a conversation; an empty table gives an
empty table.  Only the id and record columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list (the record itself for ``[]``-less rows of turns)."""

    items: str
    role: str
    text: str
    number: str | None = None


@dataclass(frozen=True)
class Fields:
    """A turn per (role, paths): the texts found are joined by a blank line, none gives no turn."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    mapping: Each | Fields
    optional: tuple[str, ...] = ()


def _list_layout(name: str, items: str, role: str, text: str) -> Layout:
    return Layout(name, (items, f"{items}[]", f"{items}[].{role}", f"{items}[].{text}"),
                  Each(items, role, text))


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), Each("", "role", "text", "turn")),
    _list_layout("messages", "messages", "role", "content"),
    _list_layout("conversations", "conversations", "from", "value"),
    _list_layout("dialog", "dialog", "speaker", "text"),
    Layout("instruction", ("instruction", "output"),
           Fields((("system", ("system",)), ("user", ("instruction", "input")),
                   ("assistant", ("output",)))), ("input", "system")),
    Layout("prompt_completion", ("prompt", "completion"),
           Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
           ("system",)),
    Layout("prompt_response", ("prompt", "response"),
           Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
           ("system",)),
    Layout("question_answer", ("question", "answer"),
           Fields((("system", ("system",)), ("user", ("context", "question")),
                   ("assistant", ("answer",)))), ("context", "system")),
)

#: Roles as other layouts write them.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant",
              "model": "assistant"}


def field_paths(value, prefix: str = "") -> set[str]:
    """All paths of fields and list elements below a value."""
    found: set[str] = set()
    if isinstance(value, dict):
        for name, inner in value.items():
            path = f"{prefix}.{name}" if prefix else name
            found |= {path} | field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            found |= {f"{prefix}[]"} | field_paths(inner, f"{prefix}[]")
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Layouts:
    """Layouts by the fingerprints of all their forms."""

    def __init__(self, layouts: tuple[Layout, ...]):
        self.paths = {p for x in layouts for p in (*x.required, *x.optional)}
        self.by_print = {}
        for layout in layouts:
            for extra in chain.from_iterable(
                    combinations(layout.optional, n) for n in range(len(layout.optional) + 1)):
                self.by_print.setdefault(fingerprint({*layout.required, *extra}), layout)

    def of(self, record) -> Layout | None:
        return self.by_print.get(fingerprint(field_paths(record) & self.paths))


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record, layout: Layout) -> list[tuple[int | None, str, str]]:
    """Number, role and text of a record's turns."""
    mapping = layout.mapping
    if isinstance(mapping, Fields):
        found = [(role, [_text(record[p]) for p in paths if record.get(p) not in (None, "")])
                 for role, paths in mapping.turns]
        return [(n, role, "\n\n".join(texts)) for n, (role, texts) in
                enumerate((r, t) for r, t in found if t)]
    if not mapping.items:
        number = record[mapping.number]
        return [(number if isinstance(number, int) else None,
                 _text(record[mapping.role]), _text(record[mapping.text]))]
    turns = []
    for n, item in enumerate(record[mapping.items]):
        item = item if isinstance(item, dict) else {}
        role = _text(item.get(mapping.role))
        turns.append((n, ROLE_NAMES.get(role, role), _text(item.get(mapping.text))))
    return turns


def canonical_turns(records: DataFrame, id_col: str = "id", record_col: str = "record",
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id``, ``layout``, ``turn``, ``role`` and ``text`` from JSON records of any known layout."""
    rows = records.select(records[id_col].alias("id"), records[record_col].alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Layouts(layouts)
        for batch in batches:
            home, names, turns = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                layout = known.of(record) if isinstance(record, dict) else None
                found = record_turns(record, layout) if layout else [(None, None, None)]
                home += [n] * len(found)
                names += [layout.name if layout else None] * len(found)
                turns += found
            numbers, roles, texts = zip(*turns, strict=True) if turns else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(home, pa.int64())), pa.array(names, pa.string()),
                 pa.array(numbers, pa.int64()), pa.array(roles, pa.string()),
                 pa.array(texts, pa.string())], ["id", "layout", "turn", "role", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, layout string, turn bigint, role string, text string")


# The template: a turn is "<turn>### role: text</turn>\n".  Inside roles and texts a backslash stands
# before every backslash and control string, in roles before colons too.
_OPEN, _MARK, _CLOSE = "<turn>", "###", "</turn>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (_OPEN, _CLOSE, _MARK):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``id``, ``turn``, ``segment`` and the loss mask: ``loss_start`` (code points into the
    segment) and ``loss_len``.  A conversation's text is its segments in the order of
    ``turn, role, text``, which ``sort_key`` keeps."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    role_out = F.replace(escaped(role), F.lit(":"), F.lit("\\:"))
    head = F.concat(F.lit(f"{_OPEN}{_MARK} "), role_out, F.lit(": "))
    body = escaped(text)
    return (turns.where(F.col("layout").isNotNull())
            .select("id", "turn", F.struct(role, text).alias("sort_key"), head.alias("head"),
                    body.alias("body"), (role == loss_role).alias("learn"))
            .select("id", "turn", "sort_key",
                    F.concat("head", "body", F.lit(_CLOSE + "\n")).alias("segment"),
                    F.length("head").alias("loss_start"),
                    F.when(F.col("learn"), F.length("body")).otherwise(0).alias("loss_len")))


_SEGMENT = re.compile(r"<turn>### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(\\|:|</?turn>|###)")


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: ``n_turns``, ``turns_sha256`` (role, line
    break, text, line break per turn), ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    ordered = (segments.repartition("id").sortWithinPartitions("id", "turn", "sort_key")
               .select("id", "segment", "loss_start", "loss_len"))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, open_id, state = [], [], None, None

        def close():
            turns, turns_hash, loss, loss_hash, chars = state
            ids.append(open_id)
            rows.append((turns, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))

        def out(id_type):
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            made = pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *[pa.array(list(c), k) for c, k in
                                           zip(columns, kinds, strict=True)]], ["id", *names])
            ids.clear()
            rows.clear()
            return made

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, segment, start, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or key != open_id:
                    if state is not None:
                        close()
                    open_id, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = map(unescaped, _SEGMENT.fullmatch(segment).groups())
                learned = unescaped(segment[start:start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            yield out(id_type)
        if state is not None:
            close()
            yield out(id_type)

    kind = segments.schema["id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, "
                                   "loss_chars bigint, loss_sha256 string, formatted_chars bigint")
