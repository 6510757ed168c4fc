"""Hard negatives and the packed R-tree against brute force."""

import math
import random

import numpy as np
import pytest

from cohortlens.llm import hard_negatives as H


def steps(vec):
    most = min(H.LIMIT, math.floor(math.sqrt(2 ** 62 / max(len(vec), 1))))
    return [max(-most, min(most, math.floor(256 * x))) if abs(256 * x) < 1e300 else int(math.copysign(most, x)) for x in vec]


def brute(rows, anchors, positives=5, negatives=5):
    taken = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        row = (label, steps(vec))
        taken[i] = min(taken.get(i, row), row)
    out = []
    for a in sorted(taken):
        if not anchors(a):
            continue
        score = {i: sum(x * y for x, y in zip(taken[a][1], v)) for i, (_, v) in taken.items() if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        same = [i for i in order if taken[i][0] == taken[a][0]][:positives]
        for p in same:
            found = [i for i in order if taken[i][0] != taken[a][0]
                     and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 0, b"x") for i, y, v in rows],
                                 "vec_id bigint, embedding array<double>, label int, id string, n int, vec binary")


def odd_rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(9)]
    rows = [(i, rng.randrange(4), [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(i, i % 3, centres[0]) for i in range(600, 900)]  # equal vectors: ties
    rows += [(5, 1, centres[1]), (5, 0, centres[2]), (5, 0, centres[2]), (None, 1, centres[0]), (1001, None, centres[0]),
             (1002, 1, None), (1003, 1, [0.1, None]), (1004, 1, [float("nan")]), (1005, 1, [float("inf"), 1.0]),
             (1006, 2, []), (1007, 2, [0.5]), (1008, 2, centres[3] + [9.0]), (1010, 77, centres[4]), (-10, 3, centres[5]),
             (1020, 0, [0.0] * 12)]
    return rows


@pytest.mark.parametrize("tile, block", [(8192, 512), (64, 7)])
def test_mining_matches_brute_force(spark, tile, block):
    rows = odd_rows()
    vectors = H.cut(H.whole_vectors(frame(spark, rows)))
    got = H.mine(vectors, vectors.where("id % 10 = 0"), tile_rows=tile, block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_mining_of_large_values_and_empty_tables(spark):
    rows = [(i, i % 2, [(-1.0) ** i * 10.0 ** (k % 9), 1e300 if i == 3 else 0.25 * i]) for i, k in enumerate(range(40))]
    vectors = H.whole_vectors(frame(spark, rows))
    assert sorted(map(tuple, H.mine(vectors, vectors.where("id % 4 = 0")).collect())) == brute(rows, lambda i: i % 4 == 0)
    none = H.whole_vectors(frame(spark, [(1, None, None)]))
    assert H.mine(none, none).count() == 0
    assert H.mine(vectors, vectors.where("id < 0")).count() == 0


def test_boxes_bound_their_rows_and_prune():
    rng = np.random.default_rng(0)
    vecs = np.concatenate([rng.normal(c, 3, (500, 6)) for c in rng.normal(0, 300, (8, 6))]).round().astype(np.int32)
    order = H.str_order(vecs, 32)
    assert sorted(order) == list(range(len(vecs)))
    vecs = vecs[order].astype(np.float64)
    tree = H.Boxes(vecs, 32, 4)
    anchors = vecs[:20]
    least, most = tree.bounds(anchors, 1 << 40)
    scores = anchors @ vecs.T
    for leaf in range(len(tree.low) - tree.leaves_at):
        part = scores[:, leaf * 32:(leaf + 1) * 32]
        assert (least[:, tree.leaves_at + leaf] <= part.min(axis=1)).all()
        assert (most[:, tree.leaves_at + leaf] >= part.max(axis=1)).all()
    ids = np.arange(len(vecs))
    for n in range(20):
        window = H.Best(5, -(1 << 63), 1 << 63)
        seen = H.best_first(tree, vecs, ids, np.ones(len(vecs), bool), anchors[n], least[n], most[n], [window])
        want = sorted(zip(-scores[n], ids, strict=True))[:5]
        assert sorted((-s, -i) for s, i in window.heap) == want
        assert seen < (len(tree.low) - tree.leaves_at) / 4
