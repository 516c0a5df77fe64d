import math

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from landheat.llm import langid

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(word, odds, vocab, lang):
    inside, ending, _ = vocab

    def ways(i):
        if i == len(word):
            return 1.0
        return sum(odds[(ending if j == len(word) else inside).get(word[i:j], 0), lang] * ways(j) for j in range(i + 1, min(len(word), i + langid.PIECE_BYTES) + 1))

    return math.log(ways(0))


def test_forward_sums_all_segmentations(monkeypatch):
    vocab = langid.vocabulary(PATH)
    odds = np.random.default_rng(1).random((vocab[2], 3))
    odds[0] = 0
    odds /= odds.sum(axis=0)
    words = ["there", "été", "a", "thereof", "straße"]
    got = langid.word_scores([w.encode() for w in words], odds, vocab)
    want = [[brute(w.encode(), odds, vocab, k) for k in range(3)] for w in words]
    assert np.allclose(got, want)
    assert np.allclose([langid._long_word(w.encode(), odds, vocab) for w in words], want)


def test_expected_counts_cover_each_byte():
    vocab = langid.vocabulary(PATH)
    odds = np.full((vocab[2], 2), 1.0 / vocab[2])
    odds[0] = 0
    used = langid.expected_counts([b"hello", b"world"], np.array([2.0, 3.0]), np.array([0, 1]), odds, vocab)
    size = np.zeros(vocab[2])
    for one in vocab[:2]:
        for piece, k in one.items():
            size[k] = len(piece)
    assert np.allclose(size @ used, [10, 15])


def test_pieces_of_any_length():
    vocab = langid.vocabulary(PATH)
    inside, ending, size = vocab
    assert b"international" in ending and langid.longest(vocab) > langid.PIECE_BYTES
    odds = np.random.default_rng(2).random((size, 2))
    odds[0] = 0
    odds /= odds.sum(axis=0)
    words = [b"international", b"internationally", b"performance"]

    def ways(word, i, lang):  # over the whole vocabulary, whatever a piece's length
        if i == len(word):
            return [(1.0, ())]
        steps = [(j, (ending if j == len(word) else inside).get(word[i:j])) for j in range(i + 1, len(word) + 1)]
        return [(odds[k, lang] * p, (k, *rest)) for j, k in steps if k for p, rest in ways(word, j, lang)]

    every = [[ways(w, 0, k) for k in range(2)] for w in words]
    want = [[math.log(sum(p for p, _ in e)) for e in pair] for pair in every]
    assert np.allclose(langid.word_scores(words, odds, vocab), want)
    assert np.allclose([langid._long_word(w, odds, vocab) for w in words], want)
    used = np.zeros((size, 2))
    for pair, lang in zip(every, (0, 1, 0)):
        for p, pieces in pair[lang]:
            np.add.at(used[:, lang], list(pieces), 2 * p / sum(q for q, _ in pair[lang]))
    assert np.allclose(langid.expected_counts(words, np.full(3, 2.0), np.array([0, 1, 0]), odds, vocab), used)


def test_long_runs_count(monkeypatch):
    vocab = langid.vocabulary(PATH)
    odds = np.random.default_rng(3).random((vocab[2], 2))
    odds[0] = 0
    odds /= odds.sum(axis=0)
    words = [("今日は良い天気ですね" * 20).encode(), b"international", b"thereof" * 9]
    size = np.zeros(vocab[2])
    for one in vocab[:2]:
        for piece, k in one.items():
            size[k] = len(piece)
    args = np.array([2.0, 3.0, 1.0]), np.array([0, 1, 1]), odds, vocab
    used = langid.expected_counts(words, *args)
    assert np.allclose(size @ used, [2 * 600, 3 * 13 + 63])
    monkeypatch.setattr(langid, "LONG_WORD", 5)
    alike = langid.expected_counts(words, *args)
    monkeypatch.setattr(langid, "LONG_WORD", 63)
    assert np.allclose(langid.expected_counts(words, *args), used) and np.allclose(alike, used)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.n > 150 and r.ok > 0.95 and 0 <= r.lo <= r.hi <= 1


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the cat and the hat", "en"), (4, "the cat and the hat", "en"), (None, "le chat et la souris", "fr"), (6, "x" * 100000, "fr"), (7, "the the", None), (8, "le la le la", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.LanguageModel.fit(docs)
    got = model.predict(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und"
    assert by[4].lang_pred == "en" and by[None].lang_pred == "fr" and by[8].lang_pred == "fr" and by[7].lang_pred == "en"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.LanguageModel.fit(docs.limit(0)).predict(docs).collect()} == {"und"}


def test_rows_without_an_id_are_learned_from(spark):
    """The sample goes by texts: ids that are null or shared neither hide a language nor let all its rows in."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('de', 'en')")
    blank = docs.withColumn("doc_id", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.lit(7)).cast("long"))
    fitted = langid.LanguageModel.fit(blank, train_docs=20)
    assert all(fitted.odds[:, k].max() > 0.02 for k in range(2))
    got = fitted.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.9
    repeated = blank.filter("lang = 'de'").limit(1).crossJoin(spark.range(5000)).drop("id").unionByName(blank.filter("lang = 'en'"))
    assert langid.LanguageModel.fit(repeated, train_docs=20).odds[:, 0].max() > 0.02


def test_scores_match_brute_force(spark):
    """The query's score, from sums over all segmentations of each run of letters, one by one."""
    rows = list(enumerate(["the of and", "und die der", "", None, "12 !", "Straße über", "a", "la casa de", "international-information"]))
    model = langid.LanguageModel.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rounds=2)
    inside, ending, _ = langid.vocabulary(model.path)

    def likelihood(run, lang):
        total = [1.0] + [0.0] * len(run)
        for stop in range(1, len(run) + 1):
            known = ending if stop == len(run) else inside
            total[stop] = sum(total[k] * model.odds[known[run[k:stop]], lang] for k in range(stop) if run[k:stop] in known)
        return total[-1]

    got = model.predict(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        runs = [x.encode() for x in regex.findall(r"\p{L}+", (rows[r.doc_id][1] or "").lower())]
        if not runs:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = np.log(model.shares) + [sum(math.log(likelihood(x, k)) for x in runs) for k in range(len(model.langs))]
        odds = np.exp(logs - logs.max())
        assert r.lang_pred == model.langs[int(odds.argmax())]
        assert r.score == pytest.approx(odds.max() / odds.sum(), rel=1e-9)
