import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landheat.llm import packing


def whole_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, want, capacity):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for k, ids in want.items():
        parts = sorted(got[k], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        for i, r in enumerate(parts):
            own = ids[i * capacity : (i + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (i * capacity, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert sum(r.length for r in parts) == len(ids)
    gapless(rows, capacity)


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def brute_best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= x]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= x
        else:
            free.append(capacity - x)
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_as_good_as_best_fit_over_pieces(seed):
    lengths = np.random.default_rng(seed).integers(1, 65, 700).tolist()
    slots = packing.plan(Counter(lengths), 64)
    assert sum(n for _, _, n, _, _ in slots) == len(lengths)
    used = {f + k for _, _, n, f, _ in slots for k in range(n)}
    assert len(used) == brute_best_fit(lengths, 64)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), whole_ids([r.text for r in rows])))
    got = packing.best_fit(docs).collect()
    check(got, want, 2048)
    total = sum(map(len, want.values()))
    assert len({r.sequence_id for r in got}) <= 1.02 * total / 2048 + 1


def test_edges(spark):
    odd = "ΑΣ’s don't Été ́x <|endoftext|>\x1cİ\t'll\r\n!?…  1234 \x85 ﬁ"
    rows = [(1, None), (2, ""), (3, odd), (3, odd), (None, "a b"), (5, "word! " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("rank", F.lit(0))
    got = packing.best_fit(docs).collect()
    gapless(got, 2048)
    ids = whole_ids([t for _, t in rows])
    want = Counter((d, len(i[:2048]), zlib.crc32(np.array(i[:2048], "<u4").tobytes())) for (d, _), i in zip(rows, ids))
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got if r.piece == 0) == want
    assert sum(r.length for r in got) == sum(map(len, ids))
    assert packing.best_fit(docs.limit(0)).count() == 0
