import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from landheat.llm import fim, queries
from tests.conftest import SF

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(doc_id, text, rate=50, spm_share=80):
    text = text or ""
    units = TOKEN.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm_share:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "one two three",
    "  leading and trailing \n\n",
    " \t\n ",
    "",
    None,
    "ñandú über wide 漢字 😀 end",
    "a <P> b",
    "<S>",
    "x <M>",
    "< P> <p> << <P S>",
    "nul \x00 and \x1c \x1f marks",
    "p" * 70_000 + " tail",
    "w " * 50_000,
    "ends in <",
    "> begins",
]


def lines(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("rate,share", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_outputs_match_brute_force(spark, rate, share):
    rows = [(i * 100 + k, t) for i, t in enumerate(TEXTS) for k in range(8)] + [(None, t) for t in TEXTS] + [(7, "same id"), (7, "same id"), (7, "another text")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fim.fill_in_middle(docs, rate, share).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert lines(tuple(r)[:6] for r in got) == lines(brute(*r, rate, share) for r in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    if rate == 100:
        assert {r.form for r in got} == {"plain", "spm" if share else "psm"}


def test_small_parts_of_a_batch_agree():
    import pyarrow as pa

    from landheat.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    for most in (1, 20, 1 << 20):
        parts = list(common.sized_slices(iter([batch, batch.slice(0, 0)]), 1, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == TEXTS
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in parts)


def test_odd_tables(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "n", "h", 5)], "doc_id long, text string, n string, h1 string, output int")
    assert [tuple(r) for r in fim.fill_in_middle(docs).collect()] == [brute(1, "a b c")]
    named = spark.createDataFrame([("k", "a b c")], "doc_id string, text string")
    assert [tuple(r) for r in fim.fill_in_middle(named).collect()] == [brute("k", "a b c")]


def test_no_shuffle(spark):
    plan = queries.QUERIES["op11_fill_in_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "doc_id" in plan and "n_chars" not in plan


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(queries.ORACLE_SQL["op11_fill_in_middle"])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES["op11_fill_in_middle"](spark, SF)
    assert lines(tuple(r) for r in df.select(*columns).collect()) == lines(found.fetchall())
