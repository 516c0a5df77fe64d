import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from landheat.llm import toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(7)
    n_terms, examples = 60, []
    for i in range(700):
        terms = np.sort(rng.choice(n_terms, rng.integers(1, 9), replace=False))
        values = rng.random(len(terms))
        examples.append((i, int(rng.integers(2)), terms, values / np.linalg.norm(values)))
    index = toxicity.BlockMaxIndex.build(examples, n_terms, block=16)
    dense = np.zeros((len(index.ids), n_terms))
    by = {e[0]: e for e in examples}
    for row, i in enumerate(index.ids):
        dense[row, by[i][2]] = by[i][3]
    for _ in range(60):
        terms = np.sort(rng.choice(n_terms, rng.integers(1, 7), replace=False))
        values = rng.random(len(terms))
        values /= np.linalg.norm(values)
        cosine = dense[:, terms] @ values
        want = np.argsort(-cosine, kind="stable")[: toxicity.NEIGHBOURS]
        which, found = index.nearest(terms, values)
        assert np.allclose(found, cosine[want][cosine[want] > 0])
        assert np.allclose(cosine[which], found)


def test_held_out_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(clean) < 0.03 and np.mean(toxic) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows for b in rows if a.toxic > b.toxic]
    assert np.mean(pairs) > 0.85


def corpus(spark):
    good = [(i, f"calm words number {i} about gardens and rivers") for i in range(0, 300, 2)]
    bad = [(i, f"you foul grubword number {i} vexers") for i in range(1, 120, 2)]
    extra = [(900, None), (901, ""), (902, "GRUBWORD! vexers"), (903, "grubword " * 30000), (902, "GRUBWORD! vexers"), (None, "calm rivers")]
    docs = spark.createDataFrame(good + bad + extra, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(5)).withColumn("evidence", F.lit(0))
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in good] + [(i, 1, 1) for i, _ in bad] + [(None, 1, 1), (900, 0, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_edges(spark):
    docs, labels = corpus(spark)
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == by[903].predicted == 1 and by[902].evidence[0].label == 1
    assert by[900].score == by[901].score < 0.7 and by[None].predicted == 0
    assert {r.doc_id for r in toxicity.accepted(docs, labels).collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.accepted(docs, labels).columns == docs.columns
    assert toxicity.judged(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.judged(docs, labels.limit(0)).collect()} == {0.0}


def test_copies_make_no_terms(spark):
    good = [(i, f"calm words number {i} about gardens and rivers {i * 7919}") for i in range(0, 200)]
    one = "a foul grubword beside oddments like zinc kettles and brass lamps in rows upon rows of dusty shelves"
    bad = [(1000 + i, one) for i in range(60)] + [(2000 + i, f"foul grubword text {i} {i * 31} about roads") for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    model = toxicity.ToxicityModel.fit(docs, labels, docs)
    assert "=grubword" in model.terms and "=zinc" not in model.terms


def test_scores_match_brute_force(spark):
    """Every score from raw texts by plain loops: idf, relevance, cosines with all examples, votes; then the model's line."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.trained(docs, labels)
    texts = {r.doc_id: Counter(toxicity.terms_of(r.text)) for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.filter(~toxicity.held_out(3, 1)).collect() if r.doc_id in texts}
    examples = [i for i in toxic if texts[i]]
    prints = np.array([toxicity.simhash.fingerprint((r.text or "").encode()) for r in docs.collect()], np.uint64).view(np.int64)
    print_of = dict(zip((r.doc_id for r in docs.collect()), prints.tolist()))
    group = dict(zip(examples, toxicity.copy_groups(np.array([print_of[i] for i in examples])).tolist()))
    # examples with equal vectors in a group are one
    merged = {}
    for i in sorted(examples, key=str):
        merged.setdefault((group[i], tuple(sorted(texts[i].items()))), []).append(i)
    entries = [(ids[0], np.mean([toxic[i] for i in ids])) for ids in merged.values()]
    share = {i: 1 / sum(group[j] == group[i] for j, _ in entries) for i, _ in entries}
    n1, n0 = (max(1.0, sum(share[i] * w for i, w in own)) for own in (entries, [(i, 1 - w) for i, w in entries]))
    weight = {}
    for t in {t for i, _ in entries for t in texts[i]}:
        a = sum(share[i] * y for i, y in entries if t in texts[i])
        b = sum(share[i] * (1 - y) for i, y in entries if t in texts[i])
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        idf = math.log((1 + len(texts)) / (1 + sum(t in c for c in texts.values()))) + 1
        weight[t] = idf * (toxicity.FLOOR + toxicity.SLOPE * max(0.0, z - toxicity.CHANCE))

    def vector(counts):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [(vector(texts[i]), y) for i, y in entries]
    for r in model.score(docs).collect():
        v = vector(texts[r.doc_id])
        near = sorted(((sum(x * e.get(t, 0.0) for t, x in v.items()), y) for e, y in vectors), key=lambda x: -x[0])
        near = [x for x in near if x[0] > 1e-12]
        kth = near[: toxicity.NEIGHBOURS]
        assert np.allclose([e.cosine for e in r.evidence], [c for c, _ in kth])
        if not kth:
            assert r.score == model.prior
        elif len(near) <= len(kth) or near[len(kth)][0] < kth[-1][0] - 1e-9:  # a tie at the last place goes by the index
            raw = sum(c * y for c, y in kth) / sum(c for c, _ in kth)
            assert math.isclose(r.score, float(np.interp(raw, *model.points)), abs_tol=1e-9)


def test_ties_at_the_last_neighbour_are_settled_alike(spark):
    index = toxicity.BlockMaxIndex.build([(i, i % 2, np.array([0, 1 + i]), np.array([0.6, 0.8])) for i in range(40)], 41, block=4)
    which, cosine = index.nearest(np.array([0]), np.array([1.0]), 5)
    assert which.tolist() == [0, 1, 2, 3, 4] and np.allclose(cosine, 0.6)


def test_calibration_rises():
    votes, labels = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0, 1.0])
    at, value = toxicity.calibration(votes, labels, np.ones(6), 0.1)
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1
    assert toxicity.calibration(np.zeros(0), np.zeros(0), np.zeros(0), 0.3)[1].tolist() == [0.3]
