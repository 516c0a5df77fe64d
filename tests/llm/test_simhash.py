import numpy as np
import xxhash
from pyspark.sql import functions as F

from landheat.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, prints):
    n = len(ids)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: min(groups[root(i)]) for i in range(n)}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints)}


def test_planted_prints_at_every_depth(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 64)
    monkeypatch.setattr(simhash, "CELL_ROWS", 40)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    base[:300] = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))  # a dense ball
    prints = set(base.tolist())
    for p in base[300:600].tolist():
        q = p
        for k in rng.choice(64, rng.integers(1, 7), replace=False):
            q ^= 1 << int(k)
        prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_components(signed, prints)
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    roots = {r.node: r.root for r in simhash.components(simhash.trie_self_join(frame)).collect()}
    assert {s: roots.get(s, s) for s in signed} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "a B"), (7, "word " * 50000), (8, "é x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1][1:] == by[2][1:] == by[3][1:] == ("0" * 16, 1)
    assert by[None][2] == 4 and by[None][1] == by[4][1]
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 7, 8] and kept.count(None) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_hot_fingerprints(spark):
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 3 else f"text {i} of its own {i * 7919} words") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert sorted(map(tuple, simhash.near_duplicates(docs, hot_rows=5).collect())) == want and len(want) == 60


def test_no_text_is_lost(spark):
    a, b = "the quick brown fox jumps over the lazy dog by the river", "entirely other words stand in this second text of ours"
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (None, b, 1), (None, "a third text that no other row has at all", 2), (None, "a third text that no other row has at all", 2), (7, None, 1), (8, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").withColumn("__key", F.lit("clash"))
    got = simhash.deduplicated(docs, keep_unnamed=False)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(3, a), (5, b), (0, rows[4][1]), (7, "")])
    assert sorted((r.doc_id or 0, r.text or "") for r in simhash.deduplicated(docs).collect()) == sorted([(3, a), (5, b), (0, b), *2 * [(0, rows[4][1])], (7, "")])
    two = docs.filter("doc_id = 5")
    assert sorted(r.text for r in simhash.deduplicated(two).collect()) == sorted([a, b])
    assert simhash.deduplicated(docs.limit(0)).count() == 0
