"""Hard negatives by inner product, searched in STR-packed R-trees.

Vectors become integer steps.  Rows are dealt by ranges of their first coordinate and packed, range
by range, into tiles by sort-tile-recursive packing: the rows are cut along one coordinate after the
other, the widest first, until a tile holds ``TILE_ROWS`` of them; inside a tile the same order
gives leaves, and runs of leaves give inner boxes (``packed``).  A box's bounds give, per coordinate,
the interval that the product with an anchor's component lies in; their sum bounds the inner
product from both sides.

A search (``search``) sends blocks of at most ``BLOCK_ANCHORS`` anchors to the tiles, which are
rows of a stored table.  A task holds one tile and one block at a time.  For every anchor a queue
hands out boxes, the highest upper bound first; a box is left out when all its products lie
outside every window, or strictly below the k-th best of every window it could serve.  Tiles return
the best k of each window, and the best of all tiles are the result, so the rows that leave the
tasks are k per anchor, window and tile.

Mining takes two searches: an anchor's positives are the best rows of its label, and each positive
gives a window of scores in which rows of other labels are searched.

Results for odd input: rows without an id or label, without a vector or with a component that
is null or not finite take no part; of rows with one id the least by label and vector counts; a
vector's missing components are zeros; a component beyond the range in which all products fit 64
bits is taken as the end of that range; equal scores are ordered by id; an anchor without positives
or without negatives gives no rows; an empty table gives an empty table.  Only the three columns
named are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, lookup

TILE_ROWS, LEAF_ROWS, FAN_OUT, BLOCK_ANCHORS = 8192, 128, 8, 512
#: steps per unit, and the largest component in steps
STEPS = 256
LIMIT = 1 << 26


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """``id``, ``label`` and ``vec`` (steps, as ints) of the rows that take part."""
    x = F.col("v").cast("array<double>")
    # 64 bits hold the sum of as many products as a vector has components
    most = F.least(F.lit(float(LIMIT)), F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(x), F.lit(1)))))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.select(rows[id_col].cast("bigint").alias("id"), rows[label_col].cast("bigint").alias("label"),
                        rows[vec_col].alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
            .select("id", "label", F.transform(x, lambda c: F.greatest(F.least(
                F.floor(c * STEPS).cast("double"), most), -most).cast("int")).alias("vec"))
            .groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
            .select("id", "r.label", "r.vec"))


def str_order(vectors: np.ndarray, rows: int) -> np.ndarray:
    """An order of the rows in which runs of ``rows`` lie close: sort-tile-recursive packing.

    Coordinates are taken by their spread; along each the rows of a slab are cut into as many slabs
    as the packing needs, two at least, until a slab is a run.
    """
    n, width = vectors.shape
    spread = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable") if n else np.arange(width)
    order, out = np.arange(n), np.empty(n, np.int64)
    work = [(0, order, 0)]
    while work:
        at, part, depth = work.pop()
        runs = -(-len(part) // rows)
        if runs <= 1 or depth == width:
            out[at:at + len(part)] = part
            continue
        part = part[np.argsort(vectors[part, spread[depth]], kind="stable")]
        slabs = max(2, int(np.ceil(runs ** (1 / (width - depth)))))
        size = -(-runs // slabs) * rows
        for k in range(0, len(part), size):
            work.append((at + k, part[k:k + size], depth + 1))
    return out


class Boxes:
    """An R-tree over rows in packed order, given by the bounds of its boxes level by level."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS, fan_out: int = FAN_OUT):
        self.leaf, self.fan_out = leaf, fan_out
        at = np.arange(0, len(vectors), leaf)
        low, high = np.minimum.reduceat(vectors, at), np.maximum.reduceat(vectors, at)
        levels = [(low, high)]
        while len(levels[-1][0]) > 1:
            low, high = levels[-1]
            at = np.arange(0, len(low), fan_out)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        levels.reverse()  # the root first
        #: the first box of each level, and of no further one
        self.first = np.cumsum([0, *[len(low) for low, _ in levels]]).tolist()
        self.low = np.concatenate([low for low, _ in levels]).astype(np.float64)
        self.high = np.concatenate([high for _, high in levels]).astype(np.float64)
        self.leaves_at = self.first[-2]

    def bounds(self, anchors: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and most product of any row of each box with each anchor (a row per anchor).

        Products up to ``largest`` of whole numbers are exact below 2 ** 53; beyond, the bounds
        are widened by more than sums of floats can stray.
        """
        width = anchors.shape[1]
        low, high = self.low[:, :width].T, self.high[:, :width].T
        up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
        slack = 0.0 if largest < 1 << 53 else largest * 1e-9
        return up @ low + down @ high - slack, up @ high + down @ low + slack

    def below(self, box: int, level: int) -> range:
        """The boxes one level down that a box is made of."""
        start = self.first[level + 1] + (box - self.first[level]) * self.fan_out
        return range(start, min(start + self.fan_out, self.first[level + 2]))


class Best:
    """The k best (score, id) that lie in a window; ties go to the smaller id.

    ``floor``: no smaller score is wanted, for it lies below the window or strictly below the k-th.
    """

    def __init__(self, k: int, low: int, high: int):
        self.k, self.floor, self.high, self.heap = k, low, high, []

    def offer(self, score: int, key: int) -> None:
        if self.floor <= score <= self.high:
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -key))
            else:
                heapq.heappushpop(self.heap, (score, -key))
            if len(self.heap) == self.k:
                self.floor = self.heap[0][0]


def best_first(tree: Boxes, vectors: np.ndarray, ids: np.ndarray, usable: np.ndarray, anchor: np.ndarray,
               least: np.ndarray, most: np.ndarray, windows: list[Best]) -> int:
    """Fill the windows of one anchor; the number of leaves looked at.

    ``least`` and ``most`` bound the anchor's products with each box.
    """
    low, high = least.tolist(), most.tolist()
    ceiling = max((w.high for w in windows), default=0)

    def wanted(box: int) -> bool:
        return any(high[box] >= w.floor and low[box] <= w.high for w in windows)

    queue, seen = [(-high[0], 0, 0)] if wanted(0) else [], 0
    while queue:
        _, box, level = heapq.heappop(queue)
        if not wanted(box):  # windows have filled since
            continue
        if box < tree.leaves_at:
            for below in tree.below(box, level):
                if wanted(below):
                    heapq.heappush(queue, (-high[below], below, level + 1))
            continue
        seen += 1
        start = (box - tree.leaves_at) * tree.leaf
        scores = vectors[start:start + tree.leaf] @ anchor
        at = np.flatnonzero((scores >= min(w.floor for w in windows)) & (scores <= ceiling)
                            & usable[start:start + tree.leaf])
        for score, key in zip(scores[at].tolist(), ids[start + at].tolist(), strict=True):
            for w in windows:
                w.offer(score, key)
    return seen


_BLOB = "n int, ids binary, labels binary, vecs binary, extra binary"


def _stacked(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels, vectors (zeros behind short ones) and the last column of up to ``rows`` rows."""
    held, n = [], 0

    def made(part: pa.Table):
        part = part.combine_chunks()
        vec = part["vec"].chunk(0)
        sizes = np.diff(vec.offsets.to_numpy())
        out = np.zeros((len(sizes), int(sizes.max(initial=0)) or 1), np.int32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = vec.flatten().to_numpy(zero_copy_only=False)
        extra = part["extra"].to_pylist() if "extra" in part.column_names else None
        return part["id"].to_numpy(), part["label"].to_numpy(), out, extra

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield made(table.slice(0, rows))
            held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield made(pa.Table.from_batches(held))


def _blob(ids, labels, vecs, extra=b"") -> list:
    return [len(ids), np.ascontiguousarray(ids, np.int64).tobytes(),
            np.ascontiguousarray(labels, np.int64).tobytes(),
            np.ascontiguousarray(vecs, np.int32).tobytes(), extra]


def _unblob(n, ids, labels, vecs, _extra=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64),
            np.frombuffer(vecs, np.int32).reshape(n, -1))


_ARROW_BLOB = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def packed(rows: DataFrame, tile_rows: int = TILE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per tile: its rows in packed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # several tiles' rows are cut together, so that tiles are near in more than one coordinate
        for ids, labels, vecs, _ in _stacked(batches, 8 * tile_rows):
            order = str_order(vecs, tile_rows)
            for at in range(0, len(order), tile_rows):
                part = order[at:at + tile_rows]
                part = part[str_order(vecs[part], leaf_rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(_blob(ids[part], labels[part], vecs[part]),
                                                      _ARROW_BLOB, strict=True)],
                    ["n", "ids", "labels", "vecs", "extra"])

    # the id parts rows of equal coordinates
    dealt = rows.repartitionByRange(F.coalesce(F.get("vec", F.lit(0)), F.lit(0)), "id")
    return dealt.mapInArrow(run, _BLOB)


def _numbered(tiles: DataFrame) -> tuple[DataFrame, int]:
    """Tiles with places from 0 on, and how many there are.  Only their ids are numbered in one task."""
    tiles = cut(tiles.withColumn("tile", F.monotonically_increasing_id()))
    count = tiles.count()
    places = tiles.select("tile", (F.row_number().over(Window.orderBy("tile")) - 1).alias("place"))
    return tiles.join(lookup(places, count), "tile").select("place", "n", "ids", "labels", "vecs", "extra"), count


class Search:
    """What one search asks of every tile: the best ``k`` rows of the anchor's label or of others, in
    one window of all scores or in those of the anchor."""

    def __init__(self, same_label: bool, k: int, down_to: tuple[int, int] = (4, 5)):
        self.same_label, self.k, self.down_to = same_label, k, down_to

    def windows(self, ends: list[int]) -> list[Best]:
        """From ``down_to`` (a fraction) of each end to the end; without ends, one of all scores."""
        if not self.same_label:
            part, whole = self.down_to
            return [Best(self.k, -(-part * end // whole), end) for end in ends]
        return [Best(self.k, -(1 << 63), 1 << 63)]

    def of(self, tile, tree: Boxes, block, ends: list[list[int]]) -> list[tuple[int, int, int, int]]:
        """Anchor, window, row and score of all that one tile has for one block of anchors."""
        (ids, labels, vecs), (anchor_ids, anchor_labels, anchors) = tile, block
        width = min(vecs.shape[1], anchors.shape[1])  # what is missing counts as zeros
        vecs, anchors = vecs[:, :width], anchors[:, :width]
        largest = int(np.abs(vecs).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * width
        kind = np.float64 if largest < 1 << 53 else np.int64
        vecs, anchors = vecs.astype(kind), anchors.astype(kind)
        least, most = tree.bounds(anchors.astype(np.float64), largest)
        out = []
        for n, anchor_id in enumerate(anchor_ids.tolist()):
            same = labels == anchor_labels[n]
            windows = self.windows(ends[n])
            best_first(tree, vecs, ids, same & (ids != anchor_id) if self.same_label else ~same,
                       anchors[n], least[n], most[n], windows)
            out += [(anchor_id, w, -key, int(score)) for w, window in enumerate(windows)
                    for score, key in window.heap]
        return out


def search(tiles: DataFrame, n_tiles: int, anchors: DataFrame, job: Search,
           block_rows: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor``, ``win``, ``id``, ``score``: the best ``job.k`` rows of each anchor's windows.

    ``anchors`` has ``id``, ``label``, ``vec`` and ``extra``, the upper ends of its windows.
    """
    names = ["n", "ids", "labels", "vecs", "extra"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vecs, extra in _stacked(batches, block_rows):
            ends = np.array([len(extra), *map(len, extra), *(x for e in extra for x in e)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(_blob(ids, labels, vecs, ends.tobytes()), _ARROW_BLOB,
                                                  strict=True)], names)

    def ends_of(extra: bytes) -> list[list[int]]:
        found = np.frombuffer(extra, np.int64)
        counts, values = found[1:1 + found[0]], found[1 + found[0]:]
        return [v.tolist() for v in np.split(values, np.cumsum(counts)[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = tile = tree = None
        for batch in batches:
            for k in range(batch.num_rows):
                here, is_block, *blob = (c[k].as_py() for c in batch.columns)
                if not is_block:  # a tile comes before the blocks that are sent to it
                    place, tile = here, _unblob(*blob)
                    tree = Boxes(tile[2])
                elif here == place:
                    found = job.of(tile, tree, _unblob(*blob), ends_of(blob[-1]))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                            ["anchor", "win", "id", "score"])

    blocks = anchors.select("id", "label", "vec", "extra").mapInArrow(block, _BLOB)
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(max(n_tiles, 1) - 1))).alias("place"),
                         F.lit(True).alias("is_block"), *names)
    met = (tiles.select("place", F.lit(False).alias("is_block"), *names).unionByName(sent)
           .repartition(max(n_tiles, 1), "place").sortWithinPartitions("place", "is_block"))
    found = met.mapInArrow(run, "anchor bigint, win bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= job.k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
         tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``anchors``, which are some of ``vectors`` (see ``whole_vectors`` for the columns of both)."""
    tiles, n_tiles = _numbered(packed(vectors, tile_rows))
    anchors = anchors.select("id", "label", "vec")
    first = cut(search(tiles, n_tiles, anchors.withColumn("extra", F.array().cast("array<bigint>")),
                       Search(True, positives), block_rows))
    # a window per positive, in their order; as many as there are positives at most
    ends = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    ends = ends.select(F.col("anchor").alias("id"), F.col("p.score").alias("extra"))
    second = search(tiles, n_tiles, anchors.join(ends, "id"), Search(False, negatives), block_rows)
    of = first.select("anchor", (F.col("rank") - 1).cast("bigint").alias("win"), F.col("id").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    return second.join(of, ["anchor", "win"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
