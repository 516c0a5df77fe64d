import re

import corpus_pipeline
from landheat.llm import secrets, simhash, toxicity
from landheat.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, SF)
    rejected = {r.doc_id for r in toxicity.judged(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    single = stage["simhash_near_dedup"](spark, kept, SF)
    groups = simhash.near_duplicates(kept).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    masked = stage["secret_scans"](spark, single, SF)
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r.text for r in masked.collect()}
    assert before.keys() == after.keys()
    changed = {k for k in before if before[k] != after[k]}
    assert changed == {r.doc_id for r in secrets.scan(single).filter("spans != ''").collect()}
    mixed = stage["mixing"](spark, masked, SF)
    assert mixed.columns == docs.columns
    own = {k: set(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in after.items()}
    rows = mixed.collect()
    assert rows and all(set(r.text.split(" ")) - {""} and set(re.findall(r"[^\x20\x09-\x0D]+", r.text)) <= own[r.doc_id] for r in rows)
    packed = stage["packing"](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert len(packed) >= len(rows)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_stages_on_odd_rows(spark):
    text = "plain words stand here in a row and say nothing that anyone would mind at all"
    rows = [(1, text, "a"), (2, text, "a"), (2, "quite another text of its own with token=abcdefghijklmnop in it", None), (None, text, "b"), (None, None, None), (5, "", "a"), (5, "", "a"), (6, "word " * 30000, "b"), (-1, "deadbeefdeadbeefdeadbeef", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    stage = dict(corpus_pipeline.STAGES)
    kept = written(stage["toxicity"](spark, docs, SF), "kept")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    single = written(stage["simhash_near_dedup"](spark, kept, SF), "single")
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in single.collect()) == [(-1, "deadb"), (1, "plain"), (2, "quite"), (5, ""), (6, "word ")]
    masked = written(stage["secret_scans"](spark, single, SF), "masked")
    assert {r.doc_id: r.text for r in masked.collect() if r.doc_id in (-1, 2)} == {-1: "[SECRET]", 2: "quite another text of its own with [SECRET] in it"}
    mixed = written(stage["mixing"](spark, masked, SF), "mixed")
    assert mixed.columns == docs.columns and 5 not in {r.doc_id for r in mixed.collect()}
    assert all(r.n_chars == len(r.text) and r.size == "clash" for r in mixed.collect())
    assert {r.doc_id for r in stage["packing"](spark, mixed, SF).collect()} == {r.doc_id for r in mixed.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
