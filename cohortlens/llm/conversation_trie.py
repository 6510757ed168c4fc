"""The prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text, a conversation's key its turns' ids one
behind the other (``conversation_keys``).  Texts are left behind at the scan: what is shuffled is 16
bytes and a word count per turn.  Equal keys become one row before any tree is built
(``distinct_keys``), so a group of copies of any size is one key.

Distinct keys are dealt by ranges of their order.  A task cuts its range into chunks and builds a
radix tree of each; of the tree's byte depths only those between turns are nodes of the trie.  A
chunk knows all members of a node unless the node lies on the path of the chunk's first or last
key; such nodes go on, as partial sums along two paths, to a next round that merges the paths of
many chunks in the same way, until one chunk holds all that is left (``trie``).  A task holds one
chunk, never a node's members.  A conversation is one key: 16 bytes per turn are held in one row.

Results for odd input: a null role or text is empty; turns of equal number are ordered by role, then
by id; repeated rows are turns of their own; rows without a conversation id take no part; a
conversation may have no turns and then ends at the root; an empty table has no root and gives an
empty table.  Only the four columns named are read, whatever other columns exist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radix_tree import Node, Tree, shared
from .stages import counted, cut, lookup

WIDTH = 16
#: keys, and bytes of keys, that one tree holds (64 keys at least, whatever their length)
CHUNK_KEYS, CHUNK_BYTES, LEAST_KEYS = 20_000, 16 << 20, 64
#: paths that one last tree holds (of ``CHUNK_BYTES`` or ``LEAST_KEYS`` at most)
LAST_KEYS = 1024
#: ids per piece of a long list of members
PIECE_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256().hexdigest()


def conversation_keys(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text", together: int = 20) -> DataFrame:
    """``conv_id``, ``base`` and ``turns`` (id and words of each turn, in order) per conversation.

    Conversations of one ``base``, the multiple of ``together`` their ids are counted from, lie in
    one partition.
    """
    conv = turns[id_col].cast("bigint")
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    # the role's length keeps (role, text) pairs of equal concatenation apart
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(conv.isNotNull()).select(
        (conv - conv % together).alias("base"), conv.alias("conv_id"), F.struct(
            turns[turn_col].alias("turn"), role.alias("role"),
            F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 2 * WIDTH)).alias("id"),
            F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return (rows.repartition("base").groupBy("base", "conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("base", "conv_id",
                    F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words")))
                    .alias("turns")))


def with_shared_heads(convs: DataFrame, heads: int = 4) -> DataFrame:
    """Each conversation with its first h turns replaced by the first h of its base's, h = crc32 of
    its decimal id modulo ``heads``."""
    from pyspark.sql import Window

    own = F.col("turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    # a base has the ids that are counted from it, 39 at most, so the window is small
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice(own, 1, heads - 1)), True).over(
        Window.partitionBy("base"))
    return convs.select(
        "base", "conv_id", F.concat(
            F.slice(F.coalesce(first, F.slice(own, 1, 0)), F.lit(1), h),
            F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0)))).alias("turns"))


def _ids(turns: str | Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda x: F.hex(x["id"])), ""))


_KEYS = ("key binary, words array<int>, parts array<struct<depth: int, n: bigint, least: bigint, "
         "children: bigint, leaves: bigint, saved: bigint, ends: string>>")
_PART = pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("least", pa.int64()),
                   ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
                   ("ends", pa.string())])
_ARROW_KEYS = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())),
                         ("parts", pa.list_(_PART))])


def _end(key: bytes, n: int, least: int, ends: str) -> dict:
    """What a key's own conversations give to the node where they end."""
    return {"depth": len(key) // WIDTH, "n": n, "least": least, "children": 0, "leaves": 0,
            "saved": 0, "ends": ends}


_RUNS = "key binary, words array<int>, least bigint, n bigint, ids string, digest string"
_ARROW_RUNS = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), ("least", pa.int64()),
                         ("n", pa.int64()), ("ids", pa.string()), ("digest", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Run:
    """The members of one key as they come, in pieces of joined ids."""

    def __init__(self, key: bytes, words: list):
        self.key, self.words, self.pieces, self.open, self.sha = key, words, [], [], hashlib.sha256()

    def add(self, least: int, n: int, ids: str) -> None:
        self.open.append((least, n, ids))
        if len(self.open) >= PIECE_IDS:
            self.end_piece()

    def end_piece(self) -> None:
        if self.open:
            ids = ",".join(i for _, _, i in self.open)
            self.sha.update((("," if self.pieces else "") + ids).encode())
            self.pieces.append((self.key, self.words, self.open[0][0], sum(n for _, n, _ in self.open),
                                ids, None))
            self.open = []

    def whole(self) -> tuple:
        self.end_piece()
        return (self.key, self.words, self.pieces[0][2], sum(p[3] for p in self.pieces), None,
                self.sha.hexdigest())


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Run, bool]]:
    """Runs of rows in key order (columns key, words, least, n, ids) and whether they are complete:
    an open one comes after every batch, so that its pieces can be taken while it grows."""
    run = None
    for batch in batches:
        for key, words, least, n, ids in zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True):
            if run is None or run.key != key:
                if run is not None:
                    yield run, True
                run = Run(key, words)
            run.add(least, n, ids)
        if run is not None:
            yield run, False
    if run is not None:
        yield run, True


def _runs(rows: DataFrame) -> DataFrame:
    """Rows in the order of ``key, least`` to one row per key and partition.

    Of a partition's first and last key, which other partitions may hold too, all pieces are passed
    on and ``digest`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out, held = None, [], None
        for found, complete in _by_key(batches):
            first = first or found
            if held is not None and held is not found:
                out.append(held.whole())
                held = None
            if found is first:  # nothing of it is kept back
                if complete:
                    found.end_piece()
                out += found.pieces
                found.pieces = []
            elif complete:
                held = found  # the last one if no other comes
            if len(out) >= PIECE_IDS:
                yield _batch(out, _ARROW_RUNS)
                out = []
        if held is not None:
            held.end_piece()
            out += held.pieces
        if out:
            yield _batch(out, _ARROW_RUNS)

    return rows.mapInArrow(run, _RUNS)


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of one key, of any number, to one row with the digest of them all in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], None
        for batch in batches:
            for key, words, least, n, ids, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        out.append((*state[:4], None, state[4].hexdigest()))
                    state = [key, words, least, 0, hashlib.sha256()]
                else:
                    state[4].update(b",")
                state[4].update(ids.encode())
                state[3] += n
        if state is not None:
            out.append((*state[:4], None, state[4].hexdigest()))
            yield _batch(out, _ARROW_RUNS)

    return pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(run, _RUNS)


def distinct_keys(convs: DataFrame) -> DataFrame:
    """``key``, ``words`` and ``parts`` of every distinct conversation: how many there are, the least
    id, and the digest of all their ids in order.

    Members are dealt by ranges of (key, id), so those of one key lie in many tasks; each makes
    pieces of ``PIECE_IDS`` ids, and a key's pieces, not its members, meet to be hashed in order.
    """
    rows = cut(convs.select(
        _ids("turns").alias("key"), F.transform("turns", lambda x: x["words"]).alias("words"),
        F.col("conv_id").alias("least"), F.lit(1).cast("bigint").alias("n"),
        F.col("conv_id").cast("string").alias("ids")))
    runs = cut(_runs(rows.repartitionByRange("key", "least").sortWithinPartitions("key", "least")))
    whole = runs.where("digest is not null").unionByName(_joined(runs.where("digest is null")))
    return whole.select("key", "words", F.array(F.struct(
        (F.length("key") / WIDTH).cast("int").alias("depth"), "n", "least",
        *[F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "saved")],
        F.col("digest").alias("ends"))).alias("parts"))


_NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
          "n_leaves bigint, saved_tokens bigint, ends_sha256 string, ref binary, parent_ref binary")
_NODE_NAMES = [c.split()[0] for c in _NODES.split(", ")]
_NODE_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]


def _ref(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[:WIDTH * depth]).digest()[:16]


def _merged(a: dict, b: dict) -> dict:
    return {"n": a["n"] + b["n"], "least": min(a["least"], b["least"]),
            **{c: a[c] + b[c] for c in ("children", "leaves", "saved")}, "ends": a["ends"] or b["ends"]}


class Sums:
    """What is known of a trie node, or of all that hangs below a byte depth between two turns."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "rows", "ends", "asked")

    def __init__(self):
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.rows, self.ends, self.asked = None, [], None, False

    def member(self, n: int, least: int) -> None:
        if n:
            self.n += n
            self.least = least if self.least is None else min(self.least, least)

    def add(self, other: Sums) -> None:
        self.member(other.n, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.rows += other.rows

    def part(self, part: dict) -> None:
        self.member(part["n"], part["least"])
        self.children += part["children"]
        self.leaves += part["leaves"]
        self.saved += part["saved"]
        self.ends = part["ends"]
        # complete children of an earlier round ask for this node's least id by its reference
        self.asked = part["children"] > 0


def chunk_nodes(rows: list[tuple[bytes, list, list]], last: bool) -> tuple[list, list]:
    """Trie nodes of a chunk of path rows in order of their keys, and the path rows that go on.

    ``last``: nothing lies outside this chunk, so nothing goes on.
    """
    tree, words = Tree(_merged), {}
    for key, counts, parts in rows:
        words[key] = counts
        for part in parts:
            at = key[:WIDTH * part["depth"]]
            if len(at) < len(key):
                words.setdefault(at, counts)
            tree.put(at, part)
    low, high = rows[0][0], rows[-1][0]
    out: list[list] = []
    edges: dict[bool, list] = {True: [], False: []}  # parts along the first and the last key

    def along(path: bytes, node: Node) -> int:
        """How deep the path of an edge and a node's prefix agree (the parent's end at least)."""
        return shared(path, node.key, node.start, min(len(path), node.end))

    def climb(node: Node, sums: Sums, first: int, second: int) -> Sums:
        """From the end of a node's prefix up to its start, through the trie nodes on the way; down
        to ``first`` and ``second`` bytes they lie on the path of the first and the last key."""
        counts = words.get(node.key)
        # depths above the prefix belong to the node before; the root has the depth 0 of its own
        top = 0 if node.end == 0 else node.start // WIDTH + 1
        for depth in range(node.end // WIDTH, top - 1, -1):
            at = WIDTH * depth
            if not last and at <= max(first, second):
                if sums.n:
                    edges[at <= first].append({
                        "depth": depth, "n": sums.n, "least": sums.least, "children": sums.children,
                        "leaves": sums.leaves, "saved": sums.saved, "ends": sums.ends})
                    ref = _ref(node.key, depth) if sums.rows else None
                    for row in sums.rows:
                        out[row][9] = ref
                sums = Sums()
                continue
            if not sums.children:
                sums.leaves = 1
            if depth:
                sums.saved += (sums.n - 1) * counts[depth - 1]
            for row in sums.rows:
                out[row][2] = sums.least
            out.append([sums.least, depth, None, sums.n, sums.children, sums.leaves, sums.saved,
                        sums.ends or EMPTY_SHA, _ref(node.key, depth) if sums.asked else None, None])
            up = Sums()
            up.member(sums.n, sums.least)
            up.children, up.leaves, up.saved, up.rows = 1, sums.leaves, sums.saved, [len(out) - 1]
            sums = up
        return sums

    # children before parents, without recursion: conversations may be long
    stack = [(tree.root, 0, 0, None, False)]
    results: dict[int, Sums] = {}
    while stack:
        node, first, second, parent, left = stack.pop()
        if not left:
            results[id(node)] = Sums()
            stack.append((node, first, second, parent, True))
            for kid in node.kids():
                stack.append((kid, along(low, kid) if first == node.end else -1,
                              along(high, kid) if second == node.end else -1, node, False))
            continue
        below = results.pop(id(node))
        if node.value is not None:
            below.part(node.value)
        up = climb(node, below, first, second)
        if parent is not None:
            results[id(parent)].add(up)
    paths = [(key, words[key], sorted(found, key=lambda p: p["depth"])) for key, found in
             ((low, edges[True]), (high, edges[False])) if found]
    return out, paths


def _round(paths: DataFrame, last: bool, chunk_keys: int) -> DataFrame:
    """One round over path rows, sorted within each partition: done nodes and further path rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def made():
            nodes, further = chunk_nodes(rows, last)
            pad = len(further)
            columns = list(zip(*nodes, strict=True)) if nodes else [()] * len(_NODE_TYPES)
            arrays = [pa.array([*c, *[None] * pad], t) for c, t in zip(columns, _NODE_TYPES, strict=True)]
            arrays += [pa.array([*[None] * len(nodes), *[p[k] for p in further]], f.type)
                       for k, f in enumerate(_ARROW_KEYS)]
            return pa.RecordBatch.from_arrays(arrays, [*_NODE_NAMES, *_ARROW_KEYS.names])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                full = len(rows) >= chunk_keys or (size >= CHUNK_BYTES and len(rows) >= LEAST_KEYS)
                if full and not last:
                    yield made()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[0])
        if rows:
            yield made()

    return paths.mapInArrow(run, f"{_NODES}, {_KEYS}")


def trie(keys: DataFrame, chunk_keys: int = CHUNK_KEYS, last_keys: int = LAST_KEYS) -> DataFrame:
    """All nodes of the trie of distinct keys (see ``distinct_keys``).

    ``chunk_keys`` keys make a tree, up to ``last_keys`` paths the last one; the nodes are the same
    whatever these are.
    """
    done, paths = [], cut(keys.select("key", "words", "parts"))
    while True:
        rows, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
        last = rows <= LEAST_KEYS or rows <= last_keys and size <= CHUNK_BYTES
        if last:
            ordered = paths.coalesce(1)
        elif not done:
            ordered, parts = paths.repartitionByRange("key"), rows
        else:  # as few parts as their trees allow, so that the rounds come to an end
            parts = min(parts // 2, max(rows // chunk_keys, min(size // CHUNK_BYTES, rows // LEAST_KEYS))) + 1
            ordered = paths.repartitionByRange(parts, "key")
        step = cut(_round(ordered.sortWithinPartitions("key"), last, chunk_keys))
        done.append(step.where("depth is not null").select(*_NODE_NAMES))
        if last:
            break
        # few rows go on, two for each chunk at most
        paths, _ = counted(step.where("key is not null").select("key", "words", "parts"))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    names = _NODE_NAMES[:8]
    if len(done) == 1:
        return nodes.select(*names)
    parents = cut(nodes.where("ref is not null").select(
        F.col("ref").alias("parent_ref"), F.col("conv_id").alias("found")))
    asking = nodes.where("parent_ref is not null").join(
        lookup(parents, parents.count()), "parent_ref", "left")
    return nodes.where("parent_ref is null").select(*names).unionByName(
        asking.withColumn("parent_conv_id", F.col("found")).select(*names))
