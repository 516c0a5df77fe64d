import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landheat.llm import mixing
from landheat.llm.common import written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Water filling, one round at a time."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / whole for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, docs):
    by, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        by[d.source] += len(WORDS.findall(d.text or ""))
    want = brute_targets(by)
    source = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= mixing.BLOCK_WORDS + 1, (s, n, want[s])
    assert sum(want.values()) == pytest.approx(sum(by.values()))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = mixing.Mix(docs).taken().collect()
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len(WORDS.findall(r.text or "")) for r in rows}
    check(got, rows)
    again = mixing.Mix(docs.repartition(5)).taken().collect()
    assert sorted(again) == sorted(got)


def test_slots_give_what_is_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mix = mixing.Mix(docs)
    slots = mix.slots().groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).collect()
    assert {r.doc_id: r.n for r in slots} == {r.doc_id: r.taken for r in mix.taken().collect() if r.taken}
    texts = defaultdict(int)
    for r in mix.documents(docs).collect():
        texts[r.doc_id] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    assert dict(texts) == {r.doc_id: r.n for r in slots}


def test_permutation_is_one(spark):
    for size in (1, 2, 7, 100):
        rows = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(1).cast("long"), F.lit("a"), F.lit(size).cast("long")).alias("x"))
        assert sorted(r.x for r in rows.collect()) == list(range(size))


def test_many_shards_keep_to_quotas(spark):
    sources = spark.createDataFrame([("a", 50, 120), ("b", 900, 700)], "key string, blocks long, quota long").collect()
    rows = mixing.shard_counts(spark, sources, slots=16).collect()
    for key, quota in (("a", 120), ("b", 700)):
        own = sorted((r.first, r.n) for r in rows if r.key == key)
        at = 0
        for first, n in own:
            assert first == at
            at += n
        assert at == quota


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "one two", "b"), (4, "one two", "b"), (None, "w " * 30000, "c"), (6, "\t\n", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("block", F.lit(2)).withColumn("n_chars", F.length("text"))
    mix = mixing.Mix(docs)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 6)} == {0}
    mixed = written(mix.documents(docs), "mixed")
    assert mixed.columns == docs.columns
    words = sum(len(WORDS.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.Mix(docs.limit(0)).taken().count() == 0


def test_any_column_names(spark):
    """Columns named like the operator's own keep their values and change nothing."""
    names = ["__spans", "__k", "spans", "doc", "turn", "mark", "row_id", "one", "p.x", "passes"]
    rows = [(k, f"w{k} " * (40 * k + 3), "ab"[k % 2]) for k in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    got = mixing.Mix(odd).documents(odd)
    assert got.columns == odd.columns
    found = [r.asDict() for r in got.collect()]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names)
    want = mixing.Mix(plain).documents(plain).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted((r.doc_id, r.text) for r in want)


def test_many_sources_make_few_rows():
    """A shard has at most a row per slot, however many sources there are, and a task makes few at once."""
    n, slots = 100_000, 1024
    shards = pa.RecordBatch.from_arrays([pa.array(range(200))], names=["id"])
    batches = list(mixing._draws(iter([shards]), [f"s{k}" for k in range(n)], [1 / n] * n, slots, 42))
    assert max(b.num_rows for b in batches) <= mixing.DRAWN_ROWS
    drawn = defaultdict(int)
    for b in batches:
        for shard, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            assert k > 0
            drawn[shard] += k
    assert dict(drawn) == dict.fromkeys(range(200), slots)
    odds = [0.5, 0.0, 0.25, 0.25]
    alike = mixing._drawn(1, 2, np.repeat(odds, 500) / 500, 1000).reshape(4, 500).sum(axis=1)
    assert alike[1] == 0 and abs(alike - 1000 * np.array(odds)).max() < 90
