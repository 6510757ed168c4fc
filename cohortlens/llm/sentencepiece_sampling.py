"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

A text is a path through a lattice of vocabulary pieces whose probabilities are those of a unigram
model.  Adding Gumbel noise to the log probabilities of all segmentations and taking the ``k`` largest
samples ``k`` distinct ones without replacement.  The noise is drawn top-down: a node stands for all
segmentations that begin with some pieces, its mass is known from the backward sums of the lattice,
and its largest perturbed value is a Gumbel variable.  A best-first (A*) search over these values, whose
bound is exact, opens the node of the largest value until it is a whole segmentation; at each piece
of the path the alternatives wait as one node with their own value, cut off at their parent's.  All
noise comes from a hash of the row's key, the sample and the place, so a row always gets the same
result.

``log_inclusion`` is the log probability that the segmentation is among the ``k``, given the first value
that is not (1 where there are no more than ``k`` segmentations).

A text falls into units before its runs of spaces and around line breaks and tabs, but not between two
bytes that stand side by side in any piece of the vocabulary, so no piece crosses a unit's end.  The
lattice of a unit is made once and kept while there is room.  Characters without a piece are written
as bytes.  Decoding gives back every text exactly.

Results for odd input: a null or empty text has one segmentation, of no pieces, with probability 1;
texts with fewer segmentations than ``samples`` get fewer rows; repeated rows get equal samples; a null
key is a key; an empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T

SLICE_BYTES = 1 << 18
KEPT_ARCS = 1_500_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with log probabilities, in a trie over bytes.

    A model that scores its pieces by rank (merge order) gets probabilities that fall with the rank
    as 1 / (rank + 2.7), as word frequencies do.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        score = np.full(size, -np.inf)
        self.byte_id = np.full(256, -1, np.int32)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[self.bytes_of[-1][0]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())
                score[i] = model.get_score(i)
        plain = np.flatnonzero(np.isfinite(score))
        if np.array_equal(score[plain], np.round(score[plain])):
            order = np.argsort(-score[plain], kind="stable")
            weight = 1 / (np.arange(len(plain)) + 2.7)
            score[plain[order]] = np.log(weight / weight.sum())
        self.score = score
        self.byte_score = score[plain].min() - 1.0
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        #: pairs of bytes that stand side by side in some piece
        self.joined = np.zeros((256, 256), bool)
        nodes, edges, pieces = 1, {}, {}
        for i in plain:
            own = np.frombuffer(self.bytes_of[i], np.uint8)
            self.joined[own[:-1], own[1:]] = True
            node = 0
            for byte in self.bytes_of[i]:
                key = node * 256 + byte
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                node = edges[key]
            pieces[node] = i
        keys = np.array(sorted(edges))
        self.edge_keys, self.edge_nodes = keys, np.array([edges[k] for k in keys])
        self.root = self.step(np.zeros(256, np.int64), np.arange(256))
        self.node_piece = np.full(nodes, -1, np.int32)
        self.node_piece[list(pieces)] = list(pieces.values())

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node behind each edge, -1 without one."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
        return np.where(self.edge_keys[at] == key, self.edge_nodes[at], -1)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each item and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class Lattices:
    """Lattices of units.  A state is a place in a unit; its arcs are contiguous, longest first.

    ``low`` (first arc of a state); ``up_to`` (probability of an arc and those before it), ``log_p``,
    ``next`` (state, -1 at the unit's end), ``piece`` (-1: written as bytes), ``length`` (bytes),
    ``state``.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.arcs = self.states = 0
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.up_to = self.log_p = np.empty(0)
        self.next = self.piece = self.length = self.state = self.low = np.empty(0, np.int32)

    def of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first state of each unit.

        Lattices of units met twice here are kept while there is room; the others last until the next
        call.
        """
        distinct, index, inverse, times = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True)
        first = np.zeros(len(distinct), np.int64)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            known = self.hashes[at] == distinct
            first[known] = self.first[at[known]]
        lasting = ~known & (times > 1) & (self.arcs < KEPT_ARCS)
        arcs, states = self.arcs, self.states
        for new, keep in ((lasting, True), (~known & ~lasting, False)):
            new = np.flatnonzero(new)
            if not len(new):
                continue
            first[new], arcs, states = self._add(data, start[index[new]], end[index[new]], arcs, states)
            if keep:
                self.arcs, self.states = arcs, states
                sort = np.argsort(np.concatenate([self.hashes, distinct[new]]))
                self.first = np.concatenate([self.first, first[new]])[sort]
                self.hashes = np.concatenate([self.hashes, distinct[new]])[sort]
        return first[inverse]

    def _room(self, arcs: int, states: int) -> None:
        def wider(array, kind, size):
            if len(array) >= size:
                return array
            out = np.empty(size + size // 4, kind)
            out[:len(array)] = array
            return out
        for name in ("up_to", "log_p"):
            setattr(self, name, wider(getattr(self, name), np.float64, arcs))
        for name in ("next", "piece", "length", "state"):
            setattr(self, name, wider(getattr(self, name), np.int32, arcs))
        self.low = wider(self.low, np.int32, states + 1)

    def _add(self, data, start, end, arcs: int, states: int) -> tuple[np.ndarray, int, int]:
        """Writes lattices behind the given numbers of arcs and states: their first states and the
        numbers after them."""
        v = self.vocabulary
        unit, place = _ragged(end - start)
        where = start[unit] + place
        head = (data[where] & 0xC0) != 0x80  # first byte of a character
        state_at = np.cumsum(head) - 1
        unit, where = unit[head], where[head]
        n, stop = len(where), end[unit]
        flat = np.flatnonzero(head)
        size = np.diff(np.append(flat, len(head)))  # bytes of the character
        found, counts = [], np.zeros(n, np.int64)  # arcs by length, and how many a state has
        active, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(active):
            fits = where[active] + depth < stop[active]
            active, node = active[fits], node[fits]
            byte = data[where[active] + depth]
            node = v.step(node, byte) if depth else v.root[byte]
            active, node = active[node >= 0], node[node >= 0]
            depth += 1
            own = v.node_piece[node]
            whole = own >= 0
            found.append((active[whole], depth, own[whole], counts[active[whole]]))
            counts[active[whole]] += 1
        has_own = np.zeros(n, bool)
        for s, length, _, _ in found[:4]:
            has_own[s[size[s] == length]] = True
        bare = np.flatnonzero(~has_own)
        found.append((bare, size[bare], np.full(len(bare), -1), counts[bare]))
        counts[bare] += 1
        # each state's arcs lie together, the longest first
        low = np.concatenate([[0], np.cumsum(counts)])
        state = np.repeat(np.arange(n), counts)
        length, piece = np.empty(low[-1], np.int64), np.empty(low[-1], np.int64)
        for s, size_, own, rank in found:
            at = low[s + 1] - 1 - rank
            length[at], piece[at] = size_, own
        score = np.where(piece >= 0, v.score[piece], v.byte_score * length)
        past = flat[state] + length
        following = np.where(where[state] + length < stop[state],
                             state_at[np.minimum(past, len(head) - 1)], -1)
        # backward sums, by the number of characters left
        left = np.append(np.flatnonzero(np.diff(unit)), n - 1)[unit] - np.arange(n) + 1
        by_left = np.argsort(left, kind="stable")
        edges = np.concatenate([[0], np.cumsum(counts[by_left])])
        order = np.repeat(low[by_left] - edges[:-1], counts[by_left]) + np.arange(low[-1])
        value, onward = score[order], following[order]
        mass = np.zeros(n + 1)  # mass[-1]: the end of a unit
        groups = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            lo, hi = edges[a], edges[b]
            part = value[lo:hi] + mass[onward[lo:hi]]
            cuts = edges[a:b] - lo
            most = np.maximum.reduceat(part, cuts)
            total = np.add.reduceat(np.exp(part - np.repeat(most, counts[by_left[a:b]])), cuts)
            mass[by_left[a:b]] = most + np.log(total)
        log_p = score + mass[following] - mass[state]
        up_to = np.exp(log_p)
        left_over = np.flatnonzero(counts > 1)
        for k in range(1, int(counts.max())):  # within states, so that it depends on the unit alone
            nth = low[left_over] + k
            up_to[nth] += up_to[nth - 1]
            left_over = left_over[counts[left_over] > k + 1]
        up_to[low[1:] - 1] = np.inf  # the last one is taken at the latest
        log_p[low[:-1][counts == 1]] = 0.0
        self._room(arcs + len(state), states + n)
        new = slice(arcs, arcs + len(state))
        self.up_to[new], self.log_p[new], self.piece[new], self.length[new] = up_to, log_p, piece, length
        self.state[new] = state + states
        self.next[new] = np.where(following >= 0, following + states, -1)
        self.low[states:states + n + 1] = low + arcs
        firsts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) + states
        return firsts, arcs + len(state), states + n

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a way from each start state to its unit's end: arcs of all ways in order, and how
        many each has.  A start of -1 is an end."""
        at = np.flatnonzero(start >= 0)
        state, key = start[at], seed[at]
        who, taken = [], []
        while len(at):
            u = _uniform(key)
            arc = self.low[state].astype(np.int64)
            more = np.flatnonzero(u > self.up_to[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] > self.up_to[arc[more]]]
            who.append(at)
            taken.append(arc)
            state = self.next[arc]
            goes = state >= 0
            at, state, key = at[goes], state[goes], key[goes] + _STEP
        counts = np.zeros(len(start), np.int64)
        for at in who:
            counts[at] += 1
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for nth, (at, arc) in enumerate(zip(who, taken, strict=True)):
            out[offsets[at] + nth] = arc
        return out, counts


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from keys."""
    return ((T.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _cut_gumbel(mass: np.ndarray, bound: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gumbel values of nodes of the given log masses, cut off at a bound."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(_uniform(key))) - mass)


class _Paths:
    """One segmentation of some texts of a slice: arcs in order, their bounds per text, the unit of
    each arc, and the perturbed values of what waits beside each arc."""

    def __init__(self, arcs, bounds, units, log_p):
        self.arcs, self.bounds, self.units, self.log_p = arcs, bounds, units, log_p
        # log probability of what stands before each arc; summed by text, as a row must not depend
        # on those beside it
        sums = [np.cumsum(log_p[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.total = np.array([x[-1] if len(x) else 0.0 for x in sums])
        self.before = np.concatenate([*sums, np.zeros(0)]) - log_p
        self.waiting = np.full(len(arcs), -np.inf)
        self.taken: dict[int, list[int]] = {}

    def best(self) -> np.ndarray:
        out = np.full(len(self.bounds) - 1, -np.inf)
        full = np.flatnonzero(np.diff(self.bounds))
        if len(full):
            out[full] = np.maximum.reduceat(self.waiting, self.bounds[:-1][full])
        return out

    def wait(self, since: np.ndarray, bound: np.ndarray, key: np.ndarray) -> None:
        """Draws the values beside all arcs from ``since`` (per text) on."""
        text, place = _ragged(np.diff(self.bounds))
        p = np.exp(self.log_p)
        with np.errstate(divide="ignore"):
            mass = self.before + np.log1p(-np.minimum(p, 1.0))
        new = (place >= since[text]) & (p < 1.0)
        where = np.flatnonzero(new)
        keys = key[text[where]] + place[where].astype(np.uint64) * _STEP
        self.waiting[where] = _cut_gumbel(mass[where], bound[text[where]], keys)


def sample_slice(texts: T.Texts, keys: np.ndarray, lattices: Lattices, samples: int) -> list[tuple]:
    """(text, sample, ids, log_p, value, log_inclusion) of the sampled segmentations."""
    n = len(texts)
    sizes = np.diff(texts.bounds)
    lead = (sizes > 0).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + lead)])
    data = np.full(bounds[-1], 0x20, np.uint8)  # a space goes ahead of each text
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1][sizes > 0]] = False
    data[inner] = texts.data
    # units begin at texts, and at spaces after other characters and at and after line breaks and tabs
    # where no piece goes on
    space, alone = data == 0x20, (data == 0x0A) | (data == 0x0D) | (data == 0x09)
    begins = alone.copy()
    begins[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
    places = np.flatnonzero(begins[1:])
    begins[1 + places] = ~lattices.vocabulary.joined[data[places], data[places + 1]]
    begins[bounds[:-1][sizes > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    first = np.searchsorted(start, bounds)
    state = lattices.of(T.PrefixHash(data).of(start, end), data, start, end) if len(start) else start
    home, nth = _ragged(np.diff(first))

    def seed(sample: int, kind: int) -> np.ndarray:
        return T.mix(keys + T.mix(np.array([2 * sample + kind + 1], np.uint64)))

    arcs, counts = lattices.walk(state, T.mix(seed(0, 0)[home] + nth.astype(np.uint64)))
    path = _Paths(arcs, np.concatenate([[0], np.cumsum(counts)])[first],
                  np.repeat(np.arange(len(start)), counts), lattices.log_p[arcs])
    value = -np.log(-np.log(_uniform(seed(0, 1))))
    path.wait(np.zeros(n, np.int64), value, seed(0, 1) ^ _STEP)
    paths, found = [path], [(np.arange(n), path, value)]
    for sample in range(1, samples + 1):
        best = np.stack([p.best() for p in paths])
        source, top = best.argmax(axis=0), best.max(axis=0)
        if sample == samples:
            break
        who = np.flatnonzero(np.isfinite(top))
        key, walk_key = seed(sample, 1), seed(sample, 0)
        pieces, units_of, since = [], [], np.zeros(n, np.int64)
        starts, walkers, seeds = [], [], []
        for t in who:
            parent = paths[source[t]]
            lo, hi = parent.bounds[t], parent.bounds[t + 1]
            at = lo + int(np.argmax(parent.waiting[lo:hi]))
            alt = _open(parent, at, lo, top[t], key[t], lattices)
            unit = parent.units[at]
            pieces.append(np.append(parent.arcs[lo:at], alt))
            units_of.append(parent.units[lo:at + 1])
            since[t] = at - lo + 1
            starts.append(np.append(lattices.next[alt], state[unit + 1:first[t + 1]]))
            walkers.append(np.arange(unit, first[t + 1]))
            seeds.append(T.mix(walk_key[t] + (walkers[-1] - first[t]).astype(np.uint64)))
        if not len(who):
            continue
        arcs, counts = lattices.walk(np.concatenate(starts), np.concatenate(seeds))
        ways = np.concatenate([[0], np.cumsum([len(w) for w in walkers])])
        ends = np.concatenate([[0], np.cumsum(counts)])[ways]
        units = np.repeat(np.concatenate(walkers), counts)
        for k in range(len(who)):
            pieces[k] = np.concatenate([pieces[k], arcs[ends[k]:ends[k + 1]]])
            units_of[k] = np.concatenate([units_of[k], units[ends[k]:ends[k + 1]]])
        lengths = np.zeros(n, np.int64)
        lengths[who] = [len(p) for p in pieces]
        arcs = np.concatenate(pieces)
        path = _Paths(arcs, np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(units_of),
                      lattices.log_p[arcs])
        path.wait(since, np.where(np.isfinite(top), top, 0.0), key ^ _STEP)
        paths.append(path)
        found.append((who, path, top))
    rows = []
    for sample, (who, path, value) in enumerate(found):
        ids, id_bounds = _ids(path, data, bounds, lattices)
        for t in who:
            log_p = float(path.total[t])
            rows.append((t, sample, ids[id_bounds[t]:id_bounds[t + 1]], log_p, float(value[t]),
                         _log_inclusion(log_p - top[t])))
    return rows


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _open(path: _Paths, at: int, low: int, value: float, key: np.uint64, lattices: Lattices) -> int:
    """Takes one of the alternatives that wait at an arc; the others wait on, cut off at ``value``."""
    state = lattices.state[path.arcs[at]]
    arcs = np.arange(lattices.low[state], lattices.low[state + 1])
    taken = path.taken.setdefault(at, [int(path.arcs[at])])
    arcs = arcs[~np.isin(arcs, taken)]
    p = np.exp(lattices.log_p[arcs])
    draw = T.mix(np.array([key]) + np.array([at - low], np.uint64) * _STEP)
    alt = arcs[min(int(np.searchsorted(np.cumsum(p), _uniform(draw)[0] * p.sum())), len(arcs) - 1)]
    taken.append(int(alt))
    rest = p[arcs != alt].sum()
    path.waiting[at] = -np.inf
    if rest > 0:
        mass = path.before[at] + np.log(rest)
        path.waiting[at] = _cut_gumbel(np.array([mass]), np.array([value]), T.mix(draw))[0]
    return int(alt)


def _ids(path: _Paths, data: np.ndarray, bounds: np.ndarray, lattices: Lattices):
    """Piece ids of a path, characters without a piece as the ids of their bytes, and their bounds."""
    piece, length = lattices.piece[path.arcs], lattices.length[path.arcs].astype(np.int64)
    text, _ = _ragged(np.diff(path.bounds))
    run = np.cumsum(length) - length
    full = np.diff(path.bounds) > 0
    base = np.zeros(len(full), np.int64)
    base[full] = run[path.bounds[:-1][full]]
    where = bounds[text] + run - base[text]
    counts = np.where(piece >= 0, 1, length)
    arc, place = _ragged(counts)
    ids = np.where(piece[arc] >= 0, piece[arc],
                   lattices.vocabulary.byte_id[data[np.minimum(where[arc] + place, len(data) - 1)]]
                   if len(data) else piece[arc])
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])[path.bounds]


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    """The pieces of a model file, kept per worker; lattices last as long as a task."""
    return Vocabulary(path)


def encode(docs: DataFrame, samples: int = 2, model: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", seed: int = 0, decoded: bool = False) -> DataFrame:
    """Id, ``sample`` (0 is the largest value), ``pieces`` (ids, four bytes each, little-endian),
    ``n_pieces``, ``log_prob``, ``value`` (perturbed) and ``log_inclusion``.

    With ``decoded`` also the text that the pieces decode to, as :func:`decode` would add it.
    """
    path = model or default_model()
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.lit(seed), docs[id_col]).alias("key"),
                       docs[text_col].alias("text"))
    names = [id_col, "sample", "pieces", "n_pieces", "log_prob", "value", "log_inclusion"]
    names += ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary_of(path))
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            for texts in T.slices(batch.column(2), SLICE_BYTES):
                found = sample_slice(texts, keys[texts.first:texts.first + len(texts)], lattices, samples)
                home, sample, ids, log_p, value, inclusion = zip(*found, strict=True)
                columns = [
                    batch.column(0).take(pa.array(np.array(home) + texts.first)),
                    pa.array(sample, pa.int32()), pa.array([i.tobytes() for i in ids], pa.binary()),
                    pa.array([len(i) for i in ids], pa.int64()), pa.array(log_p, pa.float64()),
                    pa.array(value, pa.float64()), pa.array(inclusion, pa.float64())]
                if decoded:
                    columns.append(pa.array([decode_ids(i, lattices.vocabulary).decode() for i in ids],
                                            pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, sample int, pieces binary, n_pieces bigint, "
                                "log_prob double, value double, log_inclusion double"
                                + ", decoded string" * decoded)


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text of piece ids."""
    sizes = np.diff(vocabulary.offsets)[ids]
    piece, place = _ragged(sizes)
    return vocabulary.data[vocabulary.offsets[ids[piece]] + place][1:].tobytes()


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``decoded`` (text) to rows with ``pieces``."""
    path = model or default_model()
    rows = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    names = rows.columns
    place = names.index("pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            texts = [decode_ids(np.frombuffer(p, np.int32), vocabulary).decode() if p is not None
                     else None for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*fields, "decoded string"]))
