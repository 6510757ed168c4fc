"""The conversation trie against a brute-force trie, and its radix tree."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversation_trie as trie
from cohortlens.llm.radix_tree import Direct, Indexed, Sorted, Tree

EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ids in members.items():
        cost = (len(ids) - 1) * (words_of(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    return sorted(
        ((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]),
          leaves[node], saved[node],
          hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
         for node, ids in members.items()), key=str)


def odd_conversations():
    rng = random.Random(11)
    rows = [(0, 0, "user", "hot first turn"), (0, 1, "assistant", "a b  c"), (0, 2, "user", "x"), (0, 3, "user", "y z"),
            (1, None, None, None), (1, 1, "user", "q"), (1, 1, "assistant", "tie"), (1, 1, "user", "q"),
            (2, 5, "user", "userx"), (3, 5, "userx", ""), (4, 5, "use", "rx"),
            (None, 1, "user", "no conversation"), (-3, 0, "user", "neg"), (-3, 1, "user", "neg 2"),
            (-20, 0, "user", "negative base"), (-25, 0, "user", "n"), (-25, 1, "user", "n m"), (-25, 2, "u", "é日本🙂 k")]
    for c in range(100, 400):
        turns = rng.randrange(1, 7)
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hot", "hot", "hot hot", f"w{rng.randrange(9)} v"]))
                 for t in range(turns)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(5)]
    rows += [(500, t, "user", f"long {t % 70}") for t in range(250)]
    rows.append((600, 0, "user", "word " * 200_000))
    rng.shuffle(rows)
    return rows


def turns_frame(spark, rows):
    return spark.createDataFrame(
        [(c, t, r, x, "clash", 1, None) for c, t, r, x in rows],
        "conv_id bigint, turn bigint, role string, text string, key string, base int, parts string")


def nodes(frame):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")) for r in frame.collect()), key=str)


@pytest.mark.parametrize("chunk, last", [(20_000, 1024), (40, 64)])
def test_trie_matches_brute_force_in_any_chunks(spark, chunk, last):
    rows = odd_conversations()
    convs = trie.with_shared_heads(trie.conversation_keys(turns_frame(spark, rows)))
    keys = trie.distinct_keys(convs)
    assert nodes(trie.trie(keys, chunk, last)) == brute(rebuilt(rows))


def test_trie_of_empty_tables_and_turnless_conversations(spark):
    assert nodes(trie.trie(trie.distinct_keys(trie.with_shared_heads(
        trie.conversation_keys(turns_frame(spark, [])))))) == []
    # conversation 21 lies at a base whose conversation does not exist: its first h turns are gone
    rows = [(c, 0, "user", "a") for c in range(21, 40)]
    got = nodes(trie.trie(trie.distinct_keys(trie.with_shared_heads(
        trie.conversation_keys(turns_frame(spark, rows))))))
    assert got == brute(rebuilt(rows))
    assert any(not t for t in rebuilt(rows).values())


def test_members_of_a_hot_key_are_hashed_in_pieces(spark):
    n = 30_000
    convs = spark.range(n).select(
        F.lit(0).cast("bigint").alias("base"), F.col("id").alias("conv_id"),
        F.array(F.struct(F.unhex(F.lit("00" * 16)).alias("id"), F.lit(3).alias("words"))).alias("turns"))
    got = nodes(trie.trie(trie.distinct_keys(convs)))
    digest = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert got == sorted([(0, 0, None, n, 1, 1, 3 * (n - 1), EMPTY), (0, 1, 0, n, 0, 1, 3 * (n - 1), digest)], key=str)


def test_chunks_of_any_size_give_the_same_nodes():
    rng = random.Random(2)
    for _ in range(40):
        alphabet = [bytes([rng.randrange(256) if rng.random() < 0.5 else 7 for _ in range(16)]) for _ in range(5)]
        counts = {a: rng.randrange(4) for a in alphabet}
        seqs = sorted({b"".join(rng.choice(alphabet) for _ in range(rng.randrange(5))) for _ in range(40)})
        rows = []
        for n, key in enumerate(seqs):
            turns = [key[i:i + 16] for i in range(0, len(key), 16)]
            rows.append((key, [counts[t] for t in turns], [trie._end(key, 1 + n % 3, 10 * n, f"sha{n}")]))
        whole, further = trie.chunk_nodes(rows, True)
        assert not further
        done, level = [], rows
        while True:
            last = len(level) <= 3
            size, later = 3 if last else rng.randrange(3, 9), []
            for i in range(0, len(level), size):
                found, more = trie.chunk_nodes(level[i:i + size], last)
                done += found
                later += more
            if last:
                break
            level = later
        asked = {r[8]: r[0] for r in done if r[8] is not None}
        got = [[*r[:2], asked[r[9]] if r[9] is not None else r[2], *r[3:8]] for r in done]
        assert sorted(got, key=str) == sorted((r[:8] for r in whole), key=str)


def test_radix_tree_layouts_grow_and_split():
    tree = Tree(lambda a, b: a + b)
    keys = [bytes([b, 1, 2, 3]) for b in range(200)] + [b"\x05\x01\x09", b"", b"\x05"]
    layouts = []
    for k in keys:
        tree.put(k, [k])
        layouts.append((type(tree.root.children), getattr(tree.root.children, "room", None)))
    tree.put(b"\x05", ["again"])
    assert [layouts[n] for n in (0, 4, 16, 48)] == [(Sorted, 4), (Sorted, 16), (Indexed, None), (Direct, None)]
    found, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        if node.value:
            found.append((node.key[:node.end], node.value))
        kids = list(node.kids())
        assert kids == sorted(kids, key=lambda k: k.key[node.end]) and all(k.start == node.end for k in kids)
        stack += kids
    assert sorted(k for k, _ in found) == sorted(set(keys))
    assert dict(found)[b"\x05"] == [b"\x05", "again"]
