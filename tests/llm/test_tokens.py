"""Token counts, segmentation sampling, chat formatting and language identification."""

import json
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import chat_format, language_id, token_counts
from cohortlens.llm import sentencepiece_sampling as sampling
from cohortlens.llm import textbytes as T

from . import tables

PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", "'re", "l", "e", "é", "ß", "日本", "1", "12",
         "!", "...", "<|endoftext|>", "<|", "|>", "\t", " ", "　", "aaaa", "ing", "tion", "\x1c", "\x85", "🙂"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_of_all_prefixes_are_the_library_s(library):
    rng = random.Random(1)
    tables_ = token_counts.counter(token_counts.default_model())
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += ["a" * 300, " " * 50 + "x", "they'll we're it's 'rex", "<|endoftext|>", " <|endoftext|>  b"]
    for text in texts:
        counts = np.cumsum(tables_.changes(text), dtype=np.int64).tolist()
        assert counts == [library(text[:k]) for k in range(1, len(text) + 1)], repr(text)


def test_token_counts_and_answers(spark, library):
    pairs = tables.odd_pairs()
    docs = tables.docs(spark, pairs)
    stored = token_counts.prefixes(docs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in stored.collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), library(t or "")) for i, t in pairs), key=str)
    text = "Some words, and more words.\n\nThe end  of it"
    one = token_counts.prefixes(tables.docs(spark, [(1, text)]))
    asked = one.select("*", F.explode(F.array(*[F.lit(k) for k in range(60)])).alias("k"))
    for row in token_counts.tokens_in_prefix(asked, "k").collect():
        assert row.tokens == library(text[:row.k])
    for row in token_counts.chars_within(asked, "k").collect():
        fitting = [n for n in range(len(text) + 1) if library(text[:n]) <= row.k]
        assert row.chars == max(fitting)
    assert token_counts.prefixes(tables.docs(spark, [])).count() == 0


def sampled(texts, keys, k):
    lattices = sampling.Lattices(sampling.vocabulary_of(sampling.default_model()))
    return [(t + part.first, *row) for part in T.slices(pa.array(texts, pa.string()))
            for t, *row in sampling.sample_slice(
                part, np.array(keys[part.first:part.first + len(part)], np.uint64), lattices, k)]


def all_segmentations(data, ids):
    if not data:
        return [()]
    return [(ids[data[:n]], *rest) for n in range(1, len(data) + 1) if data[:n] in ids
            for rest in all_segmentations(data[n:], ids)]


def test_samples_follow_the_distribution_without_replacement():
    vocabulary = sampling.vocabulary_of(sampling.default_model())
    ids = {vocabulary.bytes_of[i]: i for i in np.flatnonzero(np.isfinite(vocabulary.score))}
    ways = all_segmentations(b" ren on", ids)
    p = np.exp([sum(vocabulary.score[i] for i in way) for way in ways])
    p /= p.sum()
    n = 6000
    rows = sampled(["ren on"] * n, [7919 * k + 13 for k in range(n)], 2)
    first = Counter(tuple(r[2].tolist()) for r in rows if r[1] == 0)
    second = Counter(tuple(r[2].tolist()) for r in rows if r[1] == 1)
    weight = Counter()
    for _, _, pieces, log_p, _, log_inclusion in rows:
        weight[tuple(pieces.tolist())] += math.exp(log_p - log_inclusion)
    for way, q in zip(ways, p, strict=True):
        want = sum(p[k] * q / (1 - p[k]) for k in range(len(ways)) if ways[k] != way)
        slack = 5 / math.sqrt(n)
        assert abs(first[way] / n - q) < slack * max(math.sqrt(q), 0.02)
        assert abs(second[way] / n - want) < slack * max(math.sqrt(want), 0.02)
        assert abs(weight[way] / n - q) < 3 * slack * max(math.sqrt(q), 0.05)  # unbiased estimate


def test_few_segmentations_are_all_found_once():
    vocabulary = sampling.vocabulary_of(sampling.default_model())
    ids = {vocabulary.bytes_of[i]: i for i in np.flatnonzero(np.isfinite(vocabulary.score))}
    ways = all_segmentations(b" the", ids)
    rows = sampled(["the"], [5], 50)
    assert sorted(tuple(r[2].tolist()) for r in rows) == sorted(ways)
    values = [r[4] for r in rows]
    assert values == sorted(values, reverse=True) and all(r[5] == 0 for r in rows)
    assert abs(sum(math.exp(r[3]) for r in rows) - 1) < 1e-9


def test_pieces_cross_carriage_returns():
    vocabulary = sampling.vocabulary_of(sampling.default_model())
    ids = {vocabulary.bytes_of[i]: i for i in np.flatnonzero(np.isfinite(vocabulary.score))}
    text = "a);\r\nb {\r\n\tx"
    bare = {bytes([b]): vocabulary.byte_id[b] for b in text.encode() if bytes([b]) not in ids}
    score = {i: vocabulary.byte_score for i in bare.values()} | {
        i: vocabulary.score[i] for i in ids.values()}
    ways = all_segmentations(b" " + text.encode(), ids | bare)
    rows = sampled([text], [5], len(ways) + 1)
    assert sorted(tuple(r[2].tolist()) for r in rows) == sorted(ways)
    p = {way: math.exp(sum(score[i] for i in way)) for way in ways}
    for _, _, pieces, log_p, _, _ in rows:
        assert math.isclose(math.exp(log_p), p[tuple(pieces.tolist())] / sum(p.values()), rel_tol=1e-9)
    processor = sentencepiece.SentencePieceProcessor(model_file=sampling.default_model())
    assert tuple(processor.encode("a);\r\nb {\r\n\tx")) in p


def test_units_end_where_no_piece_goes_on():
    """Every place of a cut lies outside all pieces, and frequent units stay short."""
    joined = sampling.vocabulary_of(sampling.default_model()).joined
    pieces = sampling.vocabulary_of(sampling.default_model()).bytes_of
    inside = [p for p in pieces if any(p[k] == 0x0D for k in range(1, len(p)))]
    assert inside and all(joined[a, b] for p in inside for a, b in zip(p[:-1], p[1:], strict=True))
    assert not joined[ord("x"), ord(" ")] and not joined[ord("\r"), ord("\n")] and not joined[:, ord("\n")].any()


def test_encoding_round_trips_and_is_repeatable(spark):
    pairs = [*tables.odd_pairs(), (70, " two  spaces\tand\r\nlines \n"), (71, "▁ and ﬁ \u0000 \U0001F468‍")]
    docs = tables.docs(spark, pairs)
    rows = sampling.decode(sampling.encode(docs, samples=3)).collect()
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.decoded in texts[r.doc_id] for r in rows)
    assert {(r.doc_id, r.decoded) for r in rows} == {(i, t or "") for i, t in pairs}
    again = sampling.encode(docs.repartition(3), samples=3).collect()
    assert sorted((str(r.doc_id), r["sample"], bytes(r.pieces)) for r in rows) == sorted(
        (str(r.doc_id), r["sample"], bytes(r.pieces)) for r in again)
    processor = sentencepiece.SentencePieceProcessor(model_file=sampling.default_model())
    for r in rows:
        if "▁" not in r.decoded and "\u0000" not in r.decoded:
            assert processor.decode(np.frombuffer(r.pieces, np.int32).tolist()) == r.decoded
    assert sampling.encode(tables.docs(spark, [])).count() == 0


RECORDS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a", "source": {"x": [1]}},
    {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"prompt": "q", "response": "a"},
    {"dialog": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
]


def test_layouts_give_equal_turns(spark):
    rows = [(n, json.dumps(r), "x") for n, r in enumerate(RECORDS)]
    rows += [(90, None, "x"), (91, "no json", "x"), (92, "[1]", "x"), (93, '{"other": 1}', "x")]
    records = spark.createDataFrame(rows, "id int, record string, role string")
    turns = chat_format.canonical_turns(records)
    got = {}
    for r in turns.orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert all(got[n] == [("user", "q"), ("assistant", "a")] for n in range(len(RECORDS)))
    assert all(got[n] == [(None, None)] for n in (90, 91, 92, 93))
    prints = {chat_format.fingerprint(chat_format.field_paths(r)) for r in RECORDS}
    assert len(prints) == len(RECORDS)
    out = chat_format.read_back(chat_format.formatted(turns)).collect()
    assert {(r.n_turns, r.loss_chars) for r in out} == {(2, 1)} and len(out) == len(RECORDS)


def test_formatted_text_reads_back(spark):
    texts = ["", "\\", "\\\\### <turn></turn>\n", "### user: x</turn>\n<turn>### assistant: y", ":\\:", None, "é🙂" * 50]
    rows = [(1, n, role, text) for n, text in enumerate(texts) for role in ("user", "assistant", "a: b\\", None)]
    rows += [(1, 0, "user", ""), (None, 0, "user", "z"), (2, None, "assistant", "w" * 70_000)]
    turns = spark.createDataFrame(rows, "id bigint, turn bigint, role string, text string").withColumn(
        "layout", F.lit("rows"))
    segments = chat_format.formatted(turns)
    back = [(r.id, *map(chat_format.unescaped, chat_format._SEGMENT.fullmatch(r.segment).groups()))
            for r in segments.collect()]
    assert Counter(back) == Counter((i, r or "", t or "") for i, _, r, t in rows)
    got = {r.id: r for r in chat_format.read_back(segments).collect()}
    assert got[1].n_turns == len(texts) * 4 + 1 and got[2].loss_chars == 70_000 and got[None].n_turns == 1
    assert chat_format.read_back(segments.limit(0)).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    models = language_id.fit(docs.where(~held))
    rows = language_id.predict(docs.where(held), models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = language_id.predict(tables.docs(spark, tables.odd_pairs()), models).collect()
    assert len(odd) == len(tables.odd_pairs())
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {4, 5, 6, 15, None}
    strange = language_id.predict(tables.docs(spark, [(1, "これは日本語の文章です。" * 20)]), models).first()
    assert strange.rejected and strange.lang_pred in models.languages


def test_language_without_labels(spark):
    docs = tables.docs(spark, [(1, "abc"), (2, None)])
    assert language_id.fit(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    few = language_id.fit(docs)
    assert language_id.predict(docs, few).where("doc_id = 1").first().lang_pred == "en"
    assert language_id.predict(docs.limit(0), few).count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    text = rng.choice([97, 98, 99, 32], 400).astype(np.uint32)
    gram = np.stack([text[k:len(text) - 2 + k] for k in range(3)], axis=1)
    gram, count = np.unique(gram, axis=0, return_counts=True)
    models = language_id.kneser_ney({"x": (gram, count)}, 3)
    for context in ([97, 98], [99, 99], [32, 97], [120, 121]):
        every = np.array([[*context, c] for c in (97, 98, 99, 32, 1)], np.uint32)  # 1: the unseen one
        assert abs(np.exp(models.log_probabilities(every)).sum() - 1) < 1e-5
