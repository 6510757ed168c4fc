"""Quality rules, URL filters and line dedup."""

import hashlib
import re
import string
from collections import Counter

from cohortlens.llm import line_dedup, quality_rules, url_filters

from . import tables

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def measured(text):
    """The quality rules, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def covered(size):
        grams = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
        counts = Counter(grams)
        return {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(size)}

    seen, dups, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            dups += 1
            dup_chars += sum(map(len, own))
        seen.add(line)
    repeat = len(covered(5))
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    good = 100 * dup_chars <= 20 * chars
    for size, pct in ((5, 25), (7, 24), (10, 22)):
        good &= 100 * sum(len(words[i]) for i in covered(size)) <= pct * chars
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dups, repeat, failed,
            good and not failed)


def test_quality_rules_match_brute_force(spark):
    line = "some words that stand in this line again"
    pairs = [*tables.odd_pairs(),
             (20, "\n".join([line, "a b c", line, "d e f g h i", "# $ % |"])),
             (21, " ".join(f"w{i % 9} v{i}" for i in range(60))),
             (22, "a very-very-long-word-that-is-repeated b\n" * 2 + " ".join(f"t{i}" for i in range(40)))]
    docs = tables.docs(spark, pairs)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed, r.kept) for r in quality_rules.measure(docs).collect()), key=str)
    assert got == sorted(((i, *measured(t)) for i, t in pairs), key=str)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (i for i, t in pairs if measured(t)[-1]), key=str)


def test_quality_rules_on_empty_table(spark):
    docs = tables.docs(spark, [])
    assert quality_rules.measure(docs).count() == quality_rules.keep_good(docs).count() == 0


def deduped(pairs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = {}
    for n, (_, text) in enumerate(pairs):
        for line in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(line, []).append(n)
    def rank(i):
        return (i is not None, i or 0)
    out = []
    for i, text in pairs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs
                or rank(i) == max(rank(pairs[n][0]) for n in holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup_matches_brute_force(spark):
    common = "This LINE is long enough to be looked at by the rule"
    pairs = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\n{common}\nend") for i in range(30, 37)]
    pairs += [(36, pairs[-1][1]), (None, common), (50, "short\nshort"), (51, "short"), (52, None), (53, ""),
              (54, "\n\n"), (55, "x" * 40 + "\n" + "é" * 40), *[(60 + k, "y" * 39 + "\n" + "z" * 40) for k in range(5)]]
    pairs += tables.odd_pairs()
    docs = tables.docs(spark, pairs)
    rows = line_dedup.dedup(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(deduped(pairs), key=str)
    out = line_dedup.drop_lines(docs, chars_col="n_chars")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted(
        ((i, t, len(t)) for i, _, _, t in deduped(pairs)), key=str)
    assert line_dedup.dedup(tables.docs(spark, [])).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    line = "a line that is long enough to be looked at"
    few = [(1, line), (1, line + "\nx"), (1, line + "\ny"), (1, line + "\nz"), (2, line), (None, line), (None, line)]
    docs = tables.docs(spark, few)
    assert {r.n_dropped for r in line_dedup.dedup(docs).collect()} == {0}
    many = tables.docs(spark, [*few, (3, line), (4, line), (5, line)])
    got = [(r.row.doc_id, r.n_dropped) for r in line_dedup.dedup(many).collect()]
    assert all(n == (i != 5) for i, n in got) and len(got) == 10


RULES = (url_filters.Rule("block", "net"), url_filters.Rule("allow", "example.net", "/en/"))


def test_url_parts_and_rules(spark):
    cases = [
        (1, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://a.example.net/de/", "a.example.net", "/de/", "net/", "block"),
        (3, "http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        (4, "http://net?x://y/", "net", "", None, "allow"),
        (5, None, "", "", None, "allow"), (6, "no scheme/en/", "", "", None, "allow"),
        (7, "x://h.org#frag/en/", "h.org", "", None, "allow"), (None, "", "", "", None, "allow"),
        (8, "ftp://É.org:80/a#b", "É.org:80", "/a", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "x", "x") for c in cases],
                                  "page_id bigint, url string, host string, bad string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = sorted((tuple(r) for r in url_filters.judge(pages, none, RULES).collect()), key=str)
    assert got == sorted(((c[0], *c[2:]) for c in cases), key=str)
    assert url_filters.judge(pages.limit(0), none, RULES).count() == 0


def test_reputation_blocks_bad_hosts_and_spares_unknown_ones(spark):
    rows, labels = [], []
    for host, n, bad in (("spam.one.org", 40, 38), ("good.one.org", 40, 1), ("few.two.org", 2, 2),
                         ("good.two.org", 200, 4), ("new.one.org", 0, 0)):
        for k in range(max(n, 1)):
            rows.append((len(rows), f"https://{host}/{k}"))
            if k < n:
                labels.append((len(rows) - 1, int(k < bad)))
    labels += [(0, None), (None, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    outcomes = spark.createDataFrame(labels, "page_id bigint, bad int")
    verdicts = {r.host: r.verdict for r in url_filters.judge(pages, outcomes).collect()}
    assert verdicts == {"spam.one.org": "block", "good.one.org": "allow", "few.two.org": "allow",
                        "good.two.org": "allow", "new.one.org": "allow"}


def test_url_levels(spark):
    from pyspark.sql import functions as F
    hosts = ["a.b.example.co.uk", "example.com", "localhost", "10.0.0.1", "x.y.org:8080", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select(
        url_filters.domain_of(F.col("host")).alias("d"), url_filters.suffix_of(F.col("host")).alias("s"))
    assert [tuple(r) for r in rows.collect()] == [
        ("example.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"),
        ("10.0.0.1", ""), ("y.org", "org"), ("", "")]


def test_digest_is_of_kept_lines(spark):
    text = "a\nb"
    row = line_dedup.dedup(tables.docs(spark, [(1, text)])).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
