import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landheat.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, dup, known = text.split("\n"), 0, set()
    for line in lines:
        if WORDS.search(line):
            dup += line in known
            known.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), n < 20 or 100 * len(marked) > 30 * n


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for k, r in got.items()} == want
    assert not any(r.kept and r.base_failed for r in got.values())
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = [(got[k].score >= 0.5) == bool(q) for k, q in known.items() if k in got]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words(seed):
    rng = np.random.default_rng(seed)
    words = [str(x).encode() for x in rng.integers(0, 2 + seed, 60)]
    text = b" ".join(words).decode()
    assert quality.repeated_words(words) == brute(text)[4]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n \t"), (4, "a" * 100000), (5, "é😀 # x y\n" * 30), (5, "é😀 # x y\n" * 30), (None, "w " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("features", F.lit("clash")).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(1, 0, 0), (5, None, None), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got))) == sorted(str((i, *brute(t))) for i, t in rows)
    assert quality.judged(docs.limit(0), labels).count() == 0
    assert {r.kept for r in quality.judged(docs, labels.limit(0)).collect() if not r.base_failed} <= {True}


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.4) & (rng.random(800) > 0.2)).astype(float)
    model = quality.BoostedTrees.fit(x, y, [1, -1, 0], trees=30)
    base = rng.random((50, 3))
    for feature, sign in ((0, 1), (1, -1)):
        line = np.repeat(base, 40, axis=0)
        line[:, feature] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.margin(line).reshape(50, 40), axis=1)
        assert (steps * sign >= -1e-12).all()

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + int(row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return total

    assert np.allclose(model.margin(base), [walk(r) for r in base])
    assert ((model.probability(x) > 0.5) == y.astype(bool)).mean() > 0.8
