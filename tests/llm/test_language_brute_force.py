"""Language identification against Kneser-Ney written with dictionaries: entropy, choice and score of every row."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cohortlens.llm import language_id as L
from cohortlens.llm import textbytes as T

ORDER = 4
WORDS = {
    "de": "der die und ist nicht über straße schön wir können ein haus mit fenster".split(),
    "en": "the and this is not over street nice we can a house with windows".split(),
    "fr": "le la et ce n'est pas sur rue très beau nous pouvons une maison été".split()}
ODD = ["", None, "   ", "123 !?", " the", "the ", "  the\n\nand ", "x", "Ünter", "été\x00nous", "中文 the",
       "THE AND", "the" * 3000]


def _letters(text):
    """Folded text: letters in lower case, one space between them, at the end if something follows."""
    out = ""
    for char in text or "":
        low = char.lower()
        char = (low if len(low) == 1 else char) if char.isalpha() else " "
        if char != " " or (out and out[-1] != " "):
            out += char
    return out


def _grams(text):
    whole = " " * (ORDER - 1) + _letters(text)
    return [whole[k:k + ORDER] for k in range(len(whole) - ORDER + 1)]


class Model:
    """Interpolated Kneser-Ney of one language: lower orders count the distinct grams in front."""

    def __init__(self, texts, alphabet):
        levels = {ORDER: Counter(g for t in texts for g in _grams(t))}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        self.levels, self.alphabet, self.discount = levels, alphabet, {}
        self.total, self.kinds = defaultdict(int), defaultdict(int)
        for n, counts in levels.items():
            once = sum(c == 1 for c in counts.values())
            twice = sum(c == 2 for c in counts.values())
            self.discount[n] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            for gram, count in counts.items():
                self.total[gram[:-1], n] += count
                self.kinds[gram[:-1], n] += 1

    def probability(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / self.alphabet
        below = self.probability(gram[1:])
        total = self.total.get((gram[:-1], n), 0)
        if not total:
            return below
        discount = self.discount[n]
        return (max(self.levels[n].get(gram, 0) - discount, 0)
                + discount * self.kinds[gram[:-1], n] * below) / total

    def entropy(self, text):
        grams = _grams(text)
        return -sum(math.log(self.probability(g)) for g in grams) / max(len(grams), 1)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = []
    for lang, words in sorted(WORDS.items()):
        for _ in range(60):
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))
            rows.append((lang, rnd.choice(["", " ", "\n", "- "]) + text + rnd.choice(["", ".", "  "])))
    rnd.shuffle(rows)
    return rows


def _models(corpus):
    counts = {}
    for lang in WORDS:
        grams = Counter(g for name, t in corpus if name == lang for g in _grams(t))
        counts[lang] = grams
    symbols = {c for grams in counts.values() for g in grams for c in g}
    return {lang: Model([t for name, t in corpus if name == lang], len(symbols) + 1) for lang in WORDS}


def test_every_row_as_brute_force(spark, corpus):
    """``fit`` leaves rows out of the counts; of those that it counts the brute force learns, too."""
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(corpus)],
                                 "doc_id BIGINT, lang STRING, text STRING")
    models = L.fit(docs)
    aside = {r.doc_id for r in docs.selectExpr(
        "doc_id", "pmod(xxhash64('aside', text), 8) = 0 AS aside").where("aside").collect()}
    assert 0 < len(aside) < len(corpus) / 2
    own = _models([row for i, row in enumerate(corpus) if i not in aside])
    texts = [t for _, t in corpus] + ODD
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(3)
    got = {r.doc_id: r for r in L.predict(rows, models).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row = got[i]
        if not _letters(text).strip():
            assert (row.lang_pred, row.score, row.entropy, row.rejected) == ("und", 0.0, None, False)
            continue
        want = {lang: own[lang].entropy(text) for lang in sorted(own)}
        least = min(want.values())
        assert row.entropy == pytest.approx(least, rel=1e-4, abs=1e-5), text
        assert want[row.lang_pred] == pytest.approx(least, rel=1e-4, abs=1e-5), text
        weight = min(len(_grams(text)), 100) * models.temperature
        raised = {lang: math.exp(-(e - least) * weight) for lang, e in want.items()}
        assert row.score == pytest.approx(max(raised.values()) / sum(raised.values()), rel=1e-2), text


def test_probabilities_of_a_context_sum_to_one(corpus):
    own = _models(corpus)
    symbols = sorted({c for m in own.values() for g in m.levels[ORDER] for c in g})
    for model in own.values():
        for context in ("", " ", "   ", "the", "ist", "zz"):
            seen = sum(model.probability(context + c) for c in symbols)
            unseen = model.probability(context + "中")
            assert seen + unseen == pytest.approx(1, abs=1e-9)


def test_a_text_is_read_without_its_neighbours():
    """What lies before a text in its batch must not change it."""
    for text in (" the", "the", "\n\nthe ", "", " ", "1"):
        alone = L._characters(next(T.slices(pa.array([text]))), ORDER)
        for before in ("x", "x ", "1", ""):
            code, first, letters = L._characters(next(T.slices(pa.array([before, text, "y"]))), ORDER)
            assert code[first[1]:first[2]].tolist() == alone[0].tolist(), (before, text)
            assert letters[1] == alone[2][0]
        assert "".join(map(chr, alone[0])) == " " * (ORDER - 1) + _letters(text)
