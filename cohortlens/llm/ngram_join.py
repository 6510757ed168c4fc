"""N-gram Jaccard join: all pairs of texts whose sets of word n-grams are similar, and their groups.

Texts of equal sets are one class from the start.  In a common order of all n-grams two similar sets
share at least ``m`` of their first ``n - ceil(threshold * n) + m`` n-grams, for any ``m``, so classes meet
at those keys; ``m`` grows with ``n``, which keeps long texts apart that share but a passage.  The order
puts n-grams last that are found in very many texts: which ones those are is read off a count
sketch of fixed size, and since any order is right, its errors cost nothing but time.

The classes at a key are a run, ordered by set size.  Many keys have the same run, which is kept once
with its number of keys.  First every member of a run is paired with a few leaders, which are joined to
it, and groups follow from the pairs that are similar.  Then members of different groups are paired in
size-banded tiles of the runs; a tile of very many rows is split, the members of a run's largest group
over its parts.  Pairs that meet at too few keys are left out.  Pairs inside a group need no comparison,
so copies are not expanded into all pairs, and no link between different groups is lost.  For each pair hashed bitmaps, as wide as the sets are large, bound the
overlap from above before the exact comparison of sorted hash arrays.

Results for odd input: a null text, or one without words, has an empty set and links with nothing; a
text of fewer words than an n-gram has its whole sequence as one; repeated rows are copies; null ids
rank after all others and are a component of their own only if all their texts' ids are null.  An
empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as T
from .bitmaps import collect_bitmap, in_bitmap
from .components import components
from .stages import counted, cut, lookup

WORDS = 5
PERCENT = 75
SKETCH_BITS = 17
NARROWEST, WIDEST = 8, 21  # bitmap widths, as powers of two
ID_FILTER_BITS = 24
LEADERS = (1, 16)  # of each round
KEY_FILTER_BITS = 26
_CHUNK = 1 << 19
_BLOCK = 1 << 20
_LARGE = 1 << 12
_PART = 1 << 15  # rows of a tile beyond which it is split


def _shingles(texts: T.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and their bounds per text, repeats included."""
    texts = texts.lower()
    starts, ends, first = T.word_spans(texts, T.BLANK_SEPARATED)
    words = T.PrefixHash(texts.data).of(starts, ends)
    counts = np.diff(first)
    hashes = np.zeros(0, np.uint64)
    homes = np.zeros(0, np.int64)
    for length in range(1, size + 1):
        at = T.windows(first, size) if length == size else first[:-1][counts == length]
        homes = np.concatenate([homes, np.searchsorted(first, at, "right") - 1])
        hashes = np.concatenate([hashes, T.mix(T.combined(words, at, length) + np.uint64(length))])
    order = np.argsort(homes, kind="stable")
    return hashes[order], np.searchsorted(homes[order], np.arange(len(texts) + 1))


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text in ascending order, and their bounds."""
    home = T.owner(first)
    order = np.lexsort((keys, home))
    keys, home = keys[order], home[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (home[1:] != home[:-1])
    keys, home = keys[fresh], home[fresh]
    return keys, np.searchsorted(home, np.arange(len(first)))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _lead(n, percent: int):
    """How many of its first n-grams a set of ``n`` offers as keys, beyond those it may have alone."""
    return np.minimum(1 + n // 20 - (percent * n + 99) // 100, 0)


def _meetings(n, m, percent: int):
    """At how many keys similar sets of ``n`` and ``m`` must meet.

    The l-th of the n-grams they share is at most the ``n - overlap + l``-th of a set, and the overlap
    is at least ``percent / (100 + percent) * (n + m)``.
    """
    overlap = -(-percent * (n + m) // (100 + percent))
    return np.maximum(overlap + np.minimum(_lead(n, percent), _lead(m, percent)), 1)


def _bitmap(keys: np.ndarray) -> bytes:
    """A set's bitmap: 4 to 8 bits per element, as far as the widest goes."""
    width = min(max(int(4 * len(keys) - 1).bit_length(), NARROWEST), WIDEST)
    bits = np.zeros(1 << width, bool)
    bits[(keys & np.uint64((1 << width) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _most_overlap(n: int, m: int, x: bytes, y: bytes) -> int:
    """Upper bound of the overlap of two sets: every bit of one that the other lacks is an element."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    width = min(len(a), len(b))
    if len(a) > width:  # the low bits of the place are common to all widths
        a = np.bitwise_or.reduce(a.reshape(-1, width), axis=0)
    if len(b) > width:
        b = np.bitwise_or.reduce(b.reshape(-1, width), axis=0)
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _popular(rows: DataFrame, size: int) -> np.ndarray:
    """Which buckets of n-gram hashes hold far more n-grams than the mean bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for texts in T.slices(batch.column(0)):
                counts += np.bincount(_bucket(_shingles(texts, size)[0]), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    found = (rows.select("text").mapInArrow(run, "bucket bigint, n bigint")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # 2 ** SKETCH_BITS rows at most
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    mean = counts.mean()
    return counts > mean + max(0.25 * mean, 4 * np.sqrt(mean))


def _sets(rows: DataFrame, size: int, percent: int, popular: np.ndarray) -> DataFrame:
    """``id``, ``text_hash``, ``n`` (set size), ``node`` (hash of the set, null if empty), ``bits`` and ``keys``."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(popular))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for texts in T.slices(batch.column(2)):
                hashes, first = _shingles(texts, size)
                keys = (hashes >> np.uint64(1)) | (
                    late[_bucket(hashes)].astype(np.uint64) << np.uint64(63))
                keys, first = _distinct(keys, first)
                n = np.diff(first)
                sums = np.zeros(len(keys) + 1, np.uint64)
                np.cumsum(T.mix(keys), out=sums[1:])
                node = T.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
                length = n + _lead(n, percent)
                offsets = np.concatenate([[0], np.cumsum(length)])
                where = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], length)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)),
                    batch.column(1).slice(texts.first, len(texts)), pa.array(n),
                    pa.array(node.view(np.int64), mask=n == 0),
                    pa.array([_bitmap(keys[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)],
                             pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                             pa.array(keys[where].view(np.int64)))],
                    ["id", "text_hash", "n", "node", "bits", "keys"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text_hash", "text").mapInArrow(
        run, f"id {kind}, text_hash bigint, n bigint, node bigint, bits binary, keys array<bigint>")


def _held(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys with the class and set size of each, distinct within about ``rows_at_once`` of them."""
    parts, held = [], 0

    def joined():
        keys, node, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, keys))
        keys, node, n = keys[order], node[order], n[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
        return keys[fresh], node[fresh], n[fresh]

    for batch in batches:
        lists = batch.column(2)
        sizes = pc.list_value_length(lists).to_numpy()
        parts.append((lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), sizes),
                      np.repeat(batch.column(1).to_numpy(), sizes)))
        held += len(parts[-1][0])
        if held > rows_at_once:
            yield joined()
            parts, held = [], 0
    if held:
        yield joined()


def _shared_keys(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``key``, ``n`` and ``node`` for the keys that several classes have: of the popular ones and of the others.

    Keys are counted first, without what belongs to them; a bitmap of fixed size then keeps the
    others out of the shuffle, and classes that have too few keys left to be similar to any.
    """
    lists = sets.where("n > 0").select("node", "n", "keys")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, _ in _held(batches, _CHUNK):
            # a key that several classes have here counts as met twice
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            second = np.flatnonzero(~first)
            second = second[first[second - 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys[first], keys[second]]))], ["key"])

    several = (lists.mapInArrow(count, "key bigint").groupBy("key")
               .agg(F.count("*").alias("times")).where("times > 1"))
    # the highest bit of a key only says whether it is popular
    wanted = collect_bitmap(several, F.shiftleft("key", 1), KEY_FILTER_BITS)

    def keep(batches: Iterator[pa.RecordBatch], popular: bool) -> Iterator[pa.RecordBatch]:
        def left():
            for batch in batches:
                lists = batch.column(2)
                some = in_bitmap(wanted.value, lists.flatten().to_numpy().view(np.uint64) << np.uint64(1))
                ends = np.cumsum(pc.list_value_length(lists).to_numpy())
                counts = np.diff(np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], ends])])
                enough = counts >= _fewest(batch.column(1).to_numpy(), percent)
                some &= np.repeat(enough, np.diff(np.concatenate([[0], ends])))
                some &= (lists.flatten().to_numpy() < 0) == popular
                offsets = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], ends])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), lists.flatten().filter(pa.array(some)))],
                    ["node", "n", "keys"])
        for keys, node, n in _held(left(), _CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(n), pa.array(node)], ["key", "n", "node"])

    kind = "key bigint, n bigint, node bigint"
    return (lists.mapInArrow(lambda batches: keep(batches, True), kind),
            lists.mapInArrow(lambda batches: keep(batches, False), kind))


def _grouped(batches: Iterator[pa.RecordBatch], at_once: int = _CHUNK) -> Iterator[list[pa.Array]]:
    """Columns of rows that come sorted by the first column, cut between two of its values."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_once:
            continue
        table = joined()
        key = table.column(0).to_numpy()
        cut_at = int(np.searchsorted(key, key[-1]))
        if cut_at:
            yield [c.combine_chunks() for c in table.slice(0, cut_at).columns]
            held = table.slice(cut_at).to_batches()
            rows = table.num_rows - cut_at
    if held:
        yield [c.combine_chunks() for c in joined().columns]


def _runs(popular: DataFrame, keys: DataFrame) -> DataFrame:
    """The members of each distinct run of two classes or more: ``run``, ``n``, ``node``, ``times`` (keys
    that have this run).

    A key that is not popular has few members, a fixed share of all n-grams at most, and its run is
    held in memory.  Runs of popular keys are named by partial aggregates and joined to their members.
    """
    distinct = cut(popular.groupBy("key", "node").agg(F.min("n").alias("n")))
    names = distinct.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("run"), F.count("*").alias(
        "members")).where("members > 1")
    names = counted(names.groupBy("run").agg(F.min("key").alias("key"), F.count("*").alias("times")))
    large = distinct.join(lookup(*names), "key").select("run", "n", "node", "times")
    ordered = keys.repartition("key").sortWithinPartitions("key", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, node in _grouped(batches):
            key, n, node = key.to_numpy(), n.to_numpy(), node.to_numpy()
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, n, node = key[fresh], n[fresh], node[fresh]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            shared = same[:-1] | same[1:]
            key, n, node = key[shared], n[shared], node[shared]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            name = T.mix(np.add.reduceat(T.mix(node.view(np.uint64)), starts))
            sizes = np.diff(np.append(starts, len(key)))
            _, kept, which = np.unique(name, return_index=True, return_inverse=True)
            times = np.zeros(len(starts), np.int64)
            times[kept] = np.bincount(which)
            times = np.repeat(times, sizes)
            rows = times > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(name, sizes)[rows].view(np.int64)), pa.array(n[rows]),
                 pa.array(node[rows]), pa.array(times[rows])], ["run", "n", "node", "times"])

    return (ordered.mapInArrow(run, "run bigint, n bigint, node bigint, times bigint").union(large)
            .repartition("node")  # a class has no more runs than keys, a run may have very many classes
            .groupBy("run", "n", "node").agg(F.sum("times").alias("times")))


def _met(a, b, least, times) -> tuple[np.ndarray, pa.RecordBatch]:
    """Pairs (``a``, ``b``, ``least`` meetings wanted, ``times`` met), each once, and where each was."""
    order = np.lexsort((b, a))
    a, b, least, times = a[order], b[order], least[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)])
    sums = np.add.reduceat(times, first) if len(first) else times
    return order[first], pa.RecordBatch.from_arrays(
        [pa.array(a[first]), pa.array(b[first]), pa.array(least[first]), pa.array(sums)],
        ["a", "b", "least", "times"])


_MET = "a bigint, b bigint, least bigint, times bigint"


def _often_met(pairs: DataFrame) -> DataFrame:
    return (pairs.groupBy("a", "b").agg(F.max("least").alias("least"), F.sum("times").alias("times"))
            .where("times >= least").select("a", "b"))


def _fewest(n, percent: int):
    """At how many keys a set of ``n`` meets any similar one at least."""
    small, large = (percent * n + 99) // 100, 100 * n // percent
    return np.minimum(np.minimum(_meetings(n, small, percent), _meetings(n, large, percent)),
                      _meetings(n, n, percent))


def _rooted(runs: DataFrame, roots: tuple[DataFrame, int] | None, percent: int) -> DataFrame:
    """The runs that hold several groups, with the group of each member.

    Classes that meet others there at fewer keys than any similar pair does are left out.
    """
    if roots is None:
        return runs.withColumn("root", F.col("node"))

    def several(rows):
        mixed = rows.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
            "low <> high").select("run")
        return counted(rows.join(lookup(*counted(mixed)), "run", "left_semi"))[0]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, times = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield batch.select([0]).filter(pa.array(times >= _fewest(n, percent)))

    members = several(runs.join(lookup(*roots), "node", "left").withColumn(
        "root", F.coalesce("root", "node")))
    enough = members.groupBy("node").agg(F.first("n").alias("n"), F.sum("times").alias("times")).mapInArrow(
        often, "node bigint")
    return several(members.join(lookup(*counted(enough)), "node", "left_semi"))


def _in_tiles(members: DataFrame) -> DataFrame:
    return members.repartition("lead").sortWithinPartitions("lead", "run", "n", "node")


def _heads(members: DataFrame, leaders: range) -> DataFrame:
    """The first members of each run in the order of classes: ``run``, ``heads`` (their places, ``node``,
    ``n``, ``root``).  A task sends as many of a run as there are leaders at most."""
    first = members.select("run", "node", "n", "root", F.row_number().over(
        Window.partitionBy("run").orderBy("node")).alias("place")).where(F.col("place") <= leaders.stop)
    return first.groupBy("run").agg(F.collect_list(F.struct(
        (F.col("place").cast("bigint") - 1).alias("place"), "node", "n", "root")).alias("heads"))


def _leader_pairs(runs: DataFrame, roots: tuple[DataFrame, int] | None, percent: int, leaders: range) -> DataFrame:
    """Each member with some of its run, the same few in all its runs: ``a``, ``b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, times, root = (batch.column(k).to_numpy() for k in range(4))
            counts = pc.list_value_length(batch.column(4)).to_numpy()
            place, head, size, group = (x.to_numpy() for x in batch.column(4).flatten().flatten())
            member = np.repeat(np.arange(len(n)), counts)
            own = np.full(len(n), np.iinfo(np.int64).max)
            same = (head == node[member]) & (place >= leaders.start)  # those before are not leaders now
            own[member[same]] = place[same]
            small, large = np.minimum(size, n[member]), np.maximum(size, n[member])
            near = (percent * large <= 100 * small) & (group != root[member]) & (place >= leaders.start)
            near &= own[member] > place  # with earlier leaders it has met
            member, head, size = member[near], head[near], size[near]
            yield _met(np.minimum(head, node[member]), np.maximum(head, node[member]),
                       _meetings(size, n[member], percent), times[member])[1]

    members = _rooted(runs, roots, percent)
    heads = counted(_heads(members, leaders))
    return _often_met(members.join(lookup(*heads), "run").select("n", "node", "times", "root", "heads")
                      .mapInArrow(run, _MET))


class _Bitmaps:
    """The bitmaps of a tile's classes, in one table per width and folded to half of it."""

    def __init__(self, bits: list[bytes]):
        words = np.array([len(b) // 8 for b in bits])
        self.width, self.row, self.table = words, {}, {}
        for width in np.unique(words).tolist():
            for low in (width, width // 2):
                if low * 64 < 1 << NARROWEST:
                    continue
                own = np.flatnonzero(words == width)
                table = np.frombuffer(b"".join([bits[k] for k in own]), np.uint64).reshape(len(own), width)
                if low < width:
                    table = table[:, :low] | table[:, low:]
                row = self.row.setdefault(low, np.full(len(bits), -1))
                row[own] = np.arange(len(own)) + len(self.table.get(low, ()))
                self.table[low] = np.concatenate([self.table[low], table]) if low in self.table else table

    def may_be_similar(self, i, j, n, m, percent: int) -> np.ndarray:
        """For pairs of near size: whether their bitmaps allow enough overlap."""
        out = np.ones(len(i), bool)
        low = np.minimum(self.width[i], self.width[j])
        for width, table in self.table.items():
            own = np.flatnonzero((low == width) & (np.maximum(self.width[i], self.width[j]) <= 2 * width))
            step = max((1 << 20) // width, 1)
            for part in (own[k:k + step] for k in range(0, len(own), step)):
                x, y = table[self.row[width][i[part]]], table[self.row[width][j[part]]]
                most = np.minimum(n[part] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64),
                                  m[part] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                out[part] = 100 * most >= percent * (n[part] + m[part] - most)
        return out


def _near_runs(members: DataFrame) -> DataFrame:
    """Gives runs that share members one ``lead``, so that most pairs lie in one tile only."""
    own = counted(members.groupBy("run").agg(F.min("node").alias("own")))
    least = counted(members.join(lookup(*own), "run").groupBy("node").agg(F.min("own").alias("near")))
    runs = counted(members.select("run", "node").join(lookup(*least), "node").groupBy("run").agg(
        F.min("near").alias("lead")))
    return members.join(lookup(*runs), "run")


def _dealt(members: DataFrame) -> DataFrame:
    """Splits tiles of very many rows, and adds ``kind``: 0 for members of the largest group of their run,
    1 for others, 2 for others that are here for the sake of those of kind 0 and 1.

    Members of a run's largest group need no pairs with each other, so each is in one part of its
    tile; the others are in all parts, in one of them as themselves.
    """
    parts = counted(members.groupBy("lead").agg(F.ceil(F.count("*") / _PART).alias("parts")))
    main = counted(members.groupBy("run", "root").agg(F.count("*").alias("members")).groupBy("run").agg(
        F.max_by("root", F.struct("members", "root")).alias("main")))
    is_main, own = F.col("root") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("parts"))
    rows = members.join(lookup(*parts), "lead").join(lookup(*main), "run").select(
        "*", own.alias("own"), F.explode(F.when(is_main, F.array(own)).otherwise(
            F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).alias("part"))
    split = F.col("parts") > 1
    return rows.select(
        *[F.when(split, F.xxhash64(c, "part")).otherwise(F.col(c)).alias(c) for c in ("lead", "run")],
        "n", "node", "times", "root",
        F.when(is_main, 0).when(F.col("part") == F.col("own"), 1).otherwise(2).alias("kind"))


def _bands(run, n, kind, percent: int) -> list[tuple[np.ndarray, ...]]:
    """Pairs of near size of which one at least is not in its run's largest group: places of the one, and
    for each a range (low, high) of the places of the others."""
    bounds = np.append(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), len(run))
    main, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind != 0)
    low, high, reach = (np.zeros(len(rest), np.int64) for _ in range(3))
    in_main, in_rest = np.searchsorted(main, bounds), np.searchsorted(rest, bounds)
    for k in np.flatnonzero(np.diff(in_rest)):
        own = slice(in_rest[k], in_rest[k + 1])
        sizes, others = n[rest[own]], n[main[in_main[k]:in_main[k + 1]]]
        low[own] = in_main[k] + np.searchsorted(others, -(-percent * sizes // 100))
        high[own] = in_main[k] + np.searchsorted(others, 100 * sizes // percent, "right")
        reach[own] = in_rest[k] + np.searchsorted(sizes, 100 * sizes // percent, "right")
    after = np.arange(len(rest)) + 1
    return [(rest, main, low, high), (rest, rest, after, np.where(kind[rest] == 1, reach, after))]


def _pairs_of_tile(run, n, root, node, times, kind, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs of near size in different groups of one run: places of both, and how often they met.

    ``run`` and ``n`` ascend; ``node`` numbers the classes from 0; ``kind`` is that of ``_dealt``.
    """
    size = int(node.max()) + 1
    found, met = [], np.zeros(size * size) if size * size <= 8 * _BLOCK else None
    for one, other, low, high in _bands(run, n, kind, percent):
        steps = np.concatenate([[0], np.cumsum(high - low)])
        done = 0
        while done < len(one):
            till = max(int(np.searchsorted(steps, steps[done] + _BLOCK, "right")) - 1, done + 1)
            counts = high[done:till] - low[done:till]
            left = np.repeat(one[done:till], counts)
            right = other[np.arange(len(left)) + np.repeat(low[done:till] - np.cumsum(counts) + counts, counts)]
            apart = root[left] != root[right]
            left, right = left[apart], right[apart]
            x, y = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
            if met is not None:
                met += np.bincount(x * size + y, times[left], minlength=size * size)
            else:
                code, which = np.unique(x * size + y, return_inverse=True)
                found.append((code, np.bincount(which, times[left])))
            done = till
    if met is not None:
        code = np.flatnonzero(met)
        return code // size, code % size, met[code].astype(np.int64)
    code = np.concatenate([c for c, _ in found])
    code, which = np.unique(code, return_inverse=True)
    times = np.bincount(which, np.concatenate([t for _, t in found])).astype(np.int64)
    return code // size, code % size, times


def _later_pairs(runs: DataFrame, roots: tuple[DataFrame, int], classes: DataFrame, percent: int) -> DataFrame:
    """Members of one run and of near enough size that are in different groups and whose bitmaps
    allow enough overlap: ``a``, ``b``."""
    members, _ = counted(_near_runs(_rooted(runs, roots, percent)))
    members, _ = counted(_dealt(members))
    # a bitmap comes once per tile and class, on a row without a run
    known, rows = counted(members.select("lead", "node").distinct())
    maps_ = classes.select("node", "n", "bits").join(lookup(known, rows), "node").select(
        "lead", F.lit(None).cast("bigint").alias("run"), "n", "node", F.lit(0).cast("bigint").alias("times"),
        F.lit(0).cast("bigint").alias("root"), F.lit(0).alias("kind"), "bits")
    members = maps_.union(members.select("lead", "run", "n", "node", "times", "root", "kind",
                                         F.lit(None).cast("binary").alias("bits")))

    def tile(has_run, run_, n, node, times, root, kind, bits) -> pa.RecordBatch:
        # the same class may have its bitmap in several of the leads in one tile
        _, at = np.unique(node[~has_run], return_index=True)
        maps = _Bitmaps(bits.filter(pa.array(~has_run)).take(pa.array(at)).to_pylist())
        run_, n, node, times, root, kind = (x[has_run] for x in (run_, n, node, times, root, kind))
        distinct, at, which = np.unique(node, return_index=True, return_inverse=True)
        x, y, met = _pairs_of_tile(run_, n, root, which, times, kind, percent)
        sizes = n[at]
        near = maps.may_be_similar(x, y, sizes[x], sizes[y], percent)
        x, y, met = x[near], y[near], met[near]
        a, b = np.minimum(distinct[x], distinct[y]), np.maximum(distinct[x], distinct[y])
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(_meetings(sizes[x], sizes[y], percent)), pa.array(met)],
            ["a", "b", "least", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, bits in _grouped(batches, 4 * _LARGE):
            has_run = columns[1].is_valid().to_numpy(zero_copy_only=False)
            columns[1] = pc.fill_null(columns[1], 0)
            lead, *columns = (x.to_numpy() for x in columns)
            columns = [has_run, *columns]
            bounds = np.append(np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])), len(lead))
            sizes = np.diff(bounds)
            for low in bounds[:-1][sizes > _LARGE]:
                part = slice(low, low + int(sizes[np.searchsorted(bounds, low)]))
                yield tile(*(c[part] for c in columns), bits[part])
            rest = np.flatnonzero(np.repeat(sizes <= _LARGE, sizes))
            if len(rest):
                yield tile(*(c[rest] for c in columns), bits.take(pa.array(rest)))

    return _often_met(_in_tiles(members).mapInArrow(run, _MET))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar.

    Texts of members stream past the sorted hash array of the class they are compared with; the
    members of a class with very many are dealt over several tasks.  A bitmap of fixed size keeps
    texts that no pair needs out of the shuffles.
    """
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / 2000).alias("parts"))
    dealt, _ = counted(pairs.join(split, "a").select(
        "a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("place")))
    heads = dealt.select("a", F.lit(None).cast("bigint").alias("b"), "place", F.col("a").alias("node"))
    slots, rows_ = counted(heads.distinct().union(dealt.select("a", "b", "place", F.col("b").alias("node"))))
    slots, rows_ = counted(classes.select("node", "pick").join(lookup(slots, rows_), "node").select(
        "place", "a", "b", F.col("pick.id").alias("own_id"), F.col("pick.text_hash").alias("own_hash")))
    wanted = collect_bitmap(slots, F.xxhash64("own_id", "own_hash"), ID_FILTER_BITS)
    marked = rows.select("id", "text_hash", F.xxhash64("id", "text_hash").alias("mark"), "text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy())))

    texts = marked.mapInArrow(some, marked.schema).select("id", "text_hash", "text")
    ordered = (texts.join(lookup(slots, rows_), F.col("id").eqNullSafe(F.col("own_id"))
                          & (F.col("text_hash") == F.col("own_hash")))
               .select("place", "a", "b", "text")
               .repartition("place").sortWithinPartitions("place", "a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(1).to_numpy(), batch.column(2)
            heads = b.is_null().to_numpy(zero_copy_only=False)
            links = []
            for texts in T.slices(batch.column(3)):
                keys, first = _distinct(*_shingles(texts, size))
                for k in range(len(texts)):
                    own, row = keys[first[k]:first[k + 1]], texts.first + k
                    if heads[row]:
                        leader = own
                        continue
                    at = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
                    both = int((leader[at] == own).sum())
                    if 100 * both >= percent * (len(leader) + len(own) - both):
                        links.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[links]), b.take(pa.array(links, pa.int64()))], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
          percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (``id``, ``text_hash``, ``n``, ``node``) and the ``root`` of every ``node`` that
    links connect with others."""
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"),
                       docs[text_col].alias("text"))
    sets = cut(_sets(rows, size, percent, _popular(rows, size)))
    classes = cut(sets.where("n > 0").groupBy("node").agg(
        F.min(F.struct("id", "text_hash")).alias("pick"), F.first("n").alias("n"),
        F.first("bits").alias("bits")))
    runs, _ = counted(_runs(*_shared_keys(sets, percent)))
    near, roots = None, None
    for step, count in enumerate(LEADERS):
        done = sum(LEADERS[:step])
        pairs = _leader_pairs(runs, roots, percent, range(done, done + count))
        pairs, _ = counted(_within_bound(pairs, classes, percent))
        fresh = _verified(pairs, classes, rows, size, percent)
        near, _ = counted(fresh if near is None else near.union(fresh))
        roots = components(near)
    later, _ = counted(_later_pairs(runs, roots, classes, percent))
    far, _ = counted(_verified(later, classes, rows, size, percent))
    # of the links found last only those between groups count
    side = lookup(*roots)
    joined = (far.join(side.toDF("a", "root_a"), "a", "left").join(side.toDF("b", "root_b"), "b", "left")
              .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    tops = components(joined)
    old = roots[0].select("node", F.col("root").alias("old"))
    top = tops[0].select(F.col("node").alias("old"), "root")
    moved = old.join(lookup(top, tops[1]), "old", "left").select(
        "node", F.coalesce("root", "old").alias("root"))
    fresh = tops[0].join(lookup(*roots).select("node"), "node", "left_anti")
    return sets.select("id", "text_hash", "n", "node"), moved.union(fresh)


def _within_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow enough overlap."""
    pairs, rows = counted(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    side, _ = counted(classes.select("node", "n", "bits").join(lookup(nodes, 2 * rows), "node", "left_semi"))
    both = (pairs.join(side.toDF("a", "n_a", "bits_a"), "a").join(side.toDF("b", "n_b", "bits_b"), "b")
            .select("a", "b", "n_a", "n_b", "bits_a", "bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, m, x, y in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True):
                most = _most_overlap(n, m, x, y)
                near.append(100 * most >= percent * (n + m - most))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
           percent: int = PERCENT) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``node`` (its
    class: rows of equal sets share it), ``text_hash``."""
    sets, roots = links(docs, id_col, text_col, size, percent)
    least = (sets.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(least)
    component = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "node", "component_id")
    return sets.join(component, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        "node", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the smallest id of each group, and all rows with empty sets."""
    chosen = groups(docs, id_col, text_col, **options).where(
        F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["kept_id"])
                     & (F.xxhash64(docs[text_col]) == chosen["kept_hash"]), "left_semi")
