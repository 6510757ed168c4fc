"""Small tables of odd rows: nulls, empty and very long texts, ties, repeats, clashing names."""

import random

EXTRA = ("id string, row string, n int, key string, lines string, `drop` string, kept_id string, "
         "bad_id string, text_hash string, spans string, found string, kept boolean, node string")
SCHEMA = f"doc_id bigint, text string, lang string, n_chars bigint, {EXTRA}"


def docs(spark, pairs):
    rows = [(i, t, "en", None if t is None else len(t), *["x", "x", 1, "x", "x", "x", "x", "x", "x",
                                                           "x", "x", True, "x"]) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(5000)}" for _ in range(n)]


def complementary(length):
    """Two unequal words whose sums modulo 2 ** 64 agree under any base: Thue-Morse and its inverse."""
    bits = [bin(n).count("1") % 2 for n in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def odd_pairs():
    rng = random.Random(7)
    base = " ".join(words(rng, 120))
    passage = " ".join(words(rng, 30, "p"))
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "),
        (7, "one two"), (8, "One  TWO"), (9, "a\n" * 30), (None, base + " tail"), (None, None),
        (10, " ".join(words(rng, 9)) + " " + passage), (11, passage + "\n" + " ".join(words(rng, 40))),
        (12, " ".join(words(rng, 30_000))), (13, "x" * 60_000), (14, "é日本🙂 " * 40), (15, "12 34 !!"),
        *[(16 + n, word) for n, word in enumerate(complementary(1024) + complementary(4096))],
        (20, "\n".join(complementary(8192))), (21, " ".join(complementary(2048) * 3)),
    ]
