import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from landheat.llm import chat


def brute(rows):
    """Per conversation: turns and replies straight from the rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        replies = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(replies), digest(replies))
    return out


def results(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.examples(df)).collect()}


def test_conversations(spark):
    table = chat.with_hostile(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    assert results(table) == brute([tuple(r) for r in table.collect()])


ODD = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "</turn>\n### user: \\"), (1, 2, "user", "late"),
    (2, 0, "user", "only"), (3, None, None, "x"), (3, 0, "assistant", "\\\\### a: </turn>\n\\"), (None, 0, "we:ird\\#<", "é😀"), (None, 1, "assistant", "y" * 100000),
    (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"),
]


def test_edges(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    assert results(df.withColumn("example", F.lit("clash")).withColumn("body", F.lit(1))) == brute(ODD)
    assert results(df.limit(0)) == {}


def test_only_the_last_reply_is_trained(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    for r in chat.examples(df).collect():
        turns = chat.parsed(r.text)
        if r.trainable:
            assert turns[-1][0] == "assistant" and chat.unescaped(r.text[r.mask_start : r.mask_end]) == turns[-1][1]
            assert r.text[r.mask_end :] == chat.CLOSE
        else:
            assert (r.mask_start, r.mask_end) == (0, 0) and turns[-1][0] != "assistant"


def test_forged_template_is_refused():
    with pytest.raises(ValueError):
        chat.parsed("### user: a </turn>\nstray")
