import math
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from landheat.llm import queries, search
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    profiles = [(i, Counter(words(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in profiles]
    n_docs, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in profiles for w in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), n in zip(profiles, lengths):
            m = 25 + (75 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if unnamed else doc, -s) for k, (s, unnamed, doc) in enumerate(sorted(found)[:top], 1)]
    return out


def lines(rows):
    return sorted(repr(tuple(r)) for r in rows)


def made(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "漢字", "A1b2", "x"]
    odds = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 120), p=odds / odds.sum()))) for i in rng.permutation(n)]
    docs += [(n + k, docs[0][1]) for k in range(40)] + [(n + 50, None), (n + 51, ""), (n + 52, "-- !"), (None, docs[1][1]), (None, docs[1][1]), (docs[2][0], docs[2][1])]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for k in range(25)]
    items += [(90, docs[0][1]), (91, None), (92, ""), (93, "nowhere"), (94, "x x x x\x00X"), (90, "w1"), (None, "w2 w3"), (95, "ünder Ünder")]
    return docs, items


@pytest.mark.parametrize("seed,part", [(1, 1 << 21), (2, 400), (3, 100)])
def test_ranks_match_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(search, "PART_POSTINGS", part)
    docs, items = made(seed)
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    asked = spark.createDataFrame(items, ITEMS)
    assert lines(search.ranked(df, asked).collect()) == lines(brute(docs, items))
    assert lines(search.ranked(df, asked, top=3, block_bytes=200).collect()) == lines(brute(docs, items, 3))


@pytest.mark.parametrize("first", [1, 7, 64])
def test_index_visits_strata_in_order_of_bounds(monkeypatch, first):
    """Same best as scores of all documents, whatever the size of a visit; strata that can't reach it are not visited."""
    monkeypatch.setattr(search, "FIRST_VISIT", first)
    rng = np.random.default_rng(first)
    m = rng.integers(25, 400, 2000)
    doc, term = np.repeat(np.arange(2000), 6), rng.integers(0, 40, 12000)
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    tf = rng.integers(1, 9, len(doc))
    index = search.StratifiedIndex(np.arange(2000), np.zeros(2000, bool), m, doc, term, tf)
    visited = []
    monkeypatch.setattr(search, "ranges", lambda a, b, f=search.ranges: visited.append(int(b.sum())) or f(a, b))
    for _ in range(20):
        query = np.unique(rng.integers(0, 45, 4))
        weights = rng.integers(0, 9000, len(query))
        scores = np.zeros(2000, np.int64)
        for t, w in zip(query, weights):
            own = term == t
            scores[doc[own]] += w * search.impact(tf[own], m[doc[own]])
        best = search.Best(10)
        visited.clear()
        index.best(query, weights, best)
        order = [i for i in np.lexsort((np.arange(2000), -scores))[:10] if scores[i] > 0]
        assert list(zip(best.ids, best.scores)) == [(i, scores[i]) for i in order]
        assert sum(visited[1:]) < np.isin(term, query).sum()


def test_odd_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(spark.createDataFrame([(1, None), (2, "?")], DOCS), items).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, "t"), (2, "c", 4, "u")], "doc_id long, text string, item int, score string")
    named = spark.createDataFrame([("q", "a c a", 1)], "item_id string, text string, rank int")
    assert lines(search.ranked(clash, named).collect()) == lines(brute([(1, "a b"), (2, "c")], [("q", "a c a")]))


def test_long_text(spark):
    docs = [(1, "deep " * 40_000 + "sea"), (2, "deep sea"), (3, "other")]
    items = [(1, "deep sea " * 3000)]
    got = search.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert lines(got) == lines(brute(docs, items))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    found = con.execute(queries.ORACLE_SQL["op12_lexical_search"])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES["op12_lexical_search"](spark, SF)
    assert lines(df.select(*columns).collect()) == lines(found.fetchall())


@pytest.mark.parametrize("postings", [0, 60, 1 << 22])
def test_a_partition_in_parts(monkeypatch, postings):
    """A task that indexes its documents part by part finds the same best."""
    monkeypatch.setattr(search, "POSTINGS", postings)
    rng = np.random.default_rng(5)
    ids = [np.unique(rng.integers(0, 30, 9)).tolist() for _ in range(120)]
    tfs = [rng.integers(1, 6, len(i)).tolist() for i in ids]
    m = np.sort(rng.integers(25, 60, 120))
    doc_ids = [None if k % 40 == 0 else k for k in range(120)]
    rows = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(m), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "m", "ids", "tfs"])
    queries = SimpleNamespace(value=[(4, np.array([1, 3, 29]), np.array([500, 90, 7])), (6, np.array([2]), np.array([40]))])
    got = [r for b in search._search((rows.slice(k, 7) for k in range(0, 120, 7)), queries, 10) for r in b.to_pylist()]
    want = []
    for item, query, weights in queries.value:
        scores = [sum(w * int(search.impact(np.int64(dict(zip(i, t))[q]), np.int64(x))) for q, w in zip(query, weights) if q in i) for i, t, x in zip(ids, tfs, m)]
        order = sorted((-s, d is None, d or 0) for s, d in zip(scores, doc_ids) if s > 0)[:10]
        want += [{"item": item, "doc_id": None if none else d, "score": -s} for s, none, d in order]
    assert got == want
