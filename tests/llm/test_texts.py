"""Decontamination, substring dedup and the n-gram join against brute force."""

import random
import re
from collections import Counter
import string

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortlens.llm import decontamination, ngram_join, substring_dedup

from . import tables

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(pairs, items):
    out = []
    for i, text in pairs:
        words, hit, found = item_words(text), set(), set()
        for item, item_text in items:
            own = item_words(item_text)
            size = min(13, len(own))
            grams = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in grams:
                    hit |= set(range(k, k + size))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(words), len(hit), len(found), ",".join(sorted(found)),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    passage = tables.words(rng, 40, "q")
    items = [(1, " ".join(passage)), (2, "Short ITEM here"), (3, None), (4, "!!"), (10, " ".join(passage[5:30])),
             (11, "Short, item: HERE"), (None, " ".join(passage[20:34])), (12, "solo"), (1, " ".join(passage)),
             (13, " ".join(["rep"] * 20))]
    pairs = [*tables.odd_pairs(), (30, "x " * 20 + " ".join(passage[3:16]).upper() + " y" * 20),
             (31, " ".join(passage[3:15])), (32, "this short item HERE, solo."), (33, "rep " * 15),
             (34, "-".join(passage)), (35, " ".join(passage[:13] + tables.words(rng, 800) + passage[27:])),
             (36, " ".join(tables.words(rng, 300) + passage[10:23])), (30, None)]
    docs = tables.docs(spark, pairs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(docs, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)
                   for r in got.collect()), key=str) == sorted(contaminated(pairs, items), key=str)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (c[0] for c in contaminated(pairs, items) if not c[-1]), key=str)


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = tables.docs(spark, [(1, "a b c"), (2, None)])
    assert {r.n_hit for r in decontamination.contamination(docs, bench).collect()} == {0}
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def without_repeats(pairs, length=50):
    first = {}
    for i, text in pairs:
        data, rank = (text or "").encode(), -1 if i is None else i
        for k in range(len(data) - length + 1):
            s = data[k:k + length]
            first[s] = min(first.get(s, rank), rank)
    out = []
    for i, text in pairs:
        data, rank = (text or "").encode(), -1 if i is None else i
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < rank:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdé fgh") for _ in range(3000))
    pairs = [*tables.odd_pairs(), (40, base), (39, base[500:900] + "#" + base[100:149] + "#" + base[2000:2050]),
             (41, "!" + base[:51]), (42, base[700:1500][::-1]), (43, base[:60] + "?" + base[60:]),
             (44, "ab" * 200), (45, "ab" * 40 + "c"), (46, "z" * 49), (47, "z" * 49), (48, "y" * 50), (49, "y" * 50),
             *[(100 + k, f"{k} " * 9 + base[1000:1030] + "|" * k + base[1030:1200] + f" {k}" * 7) for k in range(40)]]
    rng.shuffle(pairs)
    got = substring_dedup.dedup(tables.docs(spark, pairs)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == sorted(
        without_repeats(pairs), key=str)
    assert substring_dedup.dedup(tables.docs(spark, [])).count() == 0


def test_substring_dedup_of_texts_with_nul(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh") for _ in range(60))
    pairs = [(1, shared), (2, "xx\0" + shared + "\0"), (3, "\0" * 40 + shared), (4, "\0" * 45), (5, "\0" * 80),
             (6, shared[:49] + "\0"), (7, "\0" + shared[:50] + "\0\0"), (8, "\1" + shared[5:])]
    got = substring_dedup.dedup(tables.docs(spark, pairs)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        without_repeats(pairs))


def test_column_rounds_sort_and_measure_common_prefixes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, (12, 50)).astype(np.uint8)
    every = np.ones(50, bool)
    for column, order, common in substring_dedup.column_rounds(12, 50, lambda c: (symbols[c], every)):
        suffixes = [bytes(symbols[column:, k]) for k in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[k - 1], suffixes[k]
            shared = next((n for n in range(len(a)) if a[n] != b[n]), len(a))
            # at the last column all suffixes share what lies behind it: nothing
            assert common[k] == shared


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def grouped(pairs):
    sets = [sets_of(t) for _, t in pairs]
    root = list(range(len(pairs)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))]


def chains(rng):
    """Chains of copies, each a little further from the first, and texts at the threshold."""
    out = []
    for c in range(6):
        words = tables.words(rng, rng.choice([6, 12, 40, 150, 600]), f"c{c}_")
        for step in range(8):
            out.append((1000 + 10 * c + step, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
    shared = tables.words(rng, 103, "s")
    for extra in range(20, 45):
        out.append((2000 + extra, " ".join(shared + [f"e{extra}_{k}" for k in range(extra)])))
    long = tables.words(rng, 3000, "l")
    for k in range(4):
        out.append((3000 + k, " ".join(long[:100] + tables.words(rng, 2500, f"k{k}_"))))
    return out


@pytest.mark.parametrize("with_popular", [False, True])
def test_ngram_join_matches_brute_force(spark, with_popular):
    rng = random.Random(11)
    pairs = [*tables.odd_pairs(), *chains(rng)]
    if with_popular:  # one passage in very many texts, and very many near copies of one text
        passage, copy = tables.words(rng, 60, "pop"), tables.words(rng, 80, "copy")
        pairs += [(5000 + k, " ".join(passage + [f"own{k}_{j}" for j in range(25 + k % 7)])) for k in range(150)]
        pairs += [(6000 + k, " ".join([*copy[:k % 70], f"edit{k}", *copy[k % 70:]])) for k in range(150)]
    rng.shuffle(pairs)
    docs = tables.docs(spark, pairs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()), key=str)
    assert got == sorted(grouped(pairs), key=str)


def test_large_tiles_are_split_and_keep_their_pairs(spark, monkeypatch):
    """Runs of a large group of near copies: each pair of groups once, none of the group with itself."""
    monkeypatch.setattr(ngram_join, "_PART", 40)
    rng = random.Random(3)
    rows = [(run, rng.randrange(80, 120), node, 1 + run, 7 if node < 90 else node) for run in range(3)
            for node in rng.sample(range(100), 80)]
    members = spark.createDataFrame(rows, "run bigint, n bigint, node bigint, times bigint, root bigint").withColumn(
        "lead", F.lit(1).cast("bigint"))
    dealt = [r.asDict() for r in ngram_join._dealt(members).collect()]
    met, walked = Counter(), 0
    for lead in {r["lead"] for r in dealt}:
        tile = sorted((r for r in dealt if r["lead"] == lead), key=lambda r: (r["run"], r["n"], r["node"]))
        assert len(tile) < 100  # not the 240 rows of the whole
        run, n, node, times, root, kind = (
            np.array([r[c] for r in tile]) for c in ("run", "n", "node", "times", "root", "kind"))
        walked += sum(int((high - low).sum()) for *_, low, high in ngram_join._bands(run, n, kind, 75))
        for x, y, t in zip(*ngram_join._pairs_of_tile(run, n, root, node, times, kind, 75), strict=True):
            met[int(x), int(y)] += int(t)
    want = Counter()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] < b[2] and a[4] != b[4] and 75 * max(a[1], b[1]) <= 100 * min(a[1], b[1]):
                want[a[2], b[2]] += a[3]
    assert met == want and walked < 3 * 80 * 15


def test_leaders_are_found_by_run_and_joined(spark):
    """The first members of a run lie in no task with all its other members."""
    rows = [(run, 100, node, 1, node) for run in range(4) for node in range(300)]
    runs = spark.createDataFrame(rows, "run bigint, n bigint, node bigint, times bigint, root bigint").drop("root")
    heads = ngram_join._heads(runs.withColumn("root", F.col("node")), range(1, 17)).collect()
    assert sorted((h.run, sorted(x.place for x in h.heads)) for h in heads) == [(k, [*range(17)]) for k in range(4)]
    pairs = ngram_join._leader_pairs(runs, None, 75, range(0, 1))
    assert sorted((p.a, p.b) for p in pairs.collect()) == []  # met at 4 keys only, which is too few
    often = runs.withColumn("times", F.lit(100).cast("bigint"))
    pairs = ngram_join._leader_pairs(often, None, 75, range(0, 1))
    assert sorted((p.a, p.b) for p in pairs.collect()) == [(0, k) for k in range(1, 300)]
    pairs = ngram_join._leader_pairs(often, None, 75, range(1, 3))
    assert sorted((p.a, p.b) for p in pairs.collect()) == sorted(
        [(0, 1), (0, 2)] + [(a, k) for a in (1, 2) for k in range(a + 1, 300)])


def test_ngram_join_keeps_one_of_each_group(spark):
    pairs = tables.odd_pairs()
    docs = tables.docs(spark, pairs)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, c in grouped(pairs) if i == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    empty = tables.docs(spark, [])
    assert ngram_join.groups(empty).count() == ngram_join.keep_one(empty).count() == 0
