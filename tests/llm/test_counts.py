import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from landheat.llm import counts, queries
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(PATH)


def brute(doc_id, text):
    text = text or ""
    n = len(TOKENIZER.encode(text, add_special_tokens=False).ids)
    return doc_id, len(text.encode()), n, n > 512


TEXTS = [
    "",
    None,
    "Don't we'll 'tis it's'll",
    "  two  three   four \n\n five\t six seven  eight \x1c nine\x85 ten  ",
    " \n \n  x",
    "\n\n",
    "     ",
    "a<|endoftext|>b <|endoftext|> <|endoftext|><|endoftext|>  c",
    "<|endoftext|>",
    "<|endoftext",
    "漢字かな交じり文" * 200,
    "x" * 50_000,
    "ab1 " * 5_000,
    "\U0001f600 \U0001f468‍\U0001f469 é ﬁ ½ ² ٣",
    "!\x1c ?\x1d. #$%",
]


def lines(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("shares", [1, 8, 1 << 20])
def test_counts_match_the_tokenizer(spark, monkeypatch, shares):
    monkeypatch.setattr(counts, "SHARES", shares)
    rng = random.Random(3)
    pool = [" ", "  ", "\n", " \n", "\t", "a", "Bc", "'s", "'", "12", "é", "漢", "—", " ", "<|endoftext|>", "\x1c", "word", "　"]
    made = ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(400)]
    rows = list(enumerate(TEXTS + made)) + [(None, "no id"), (None, "no id"), (3, "the id of another"), (4, None)]
    got = counts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert lines(got) == lines(brute(*r) for r in rows)


def test_units_part_as_whole_texts():
    """Pre-tokens of units are those of the whole text, word by word or by the tokenizer."""
    pre = counts.PreTokenizer(PATH)
    rng = random.Random(4)
    pool = [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "B", "é", "ñ", "×", "÷", "ª", "漢", "'s", "'", ".", "~", "7", "²", "\x7f", "—", "”"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randrange(0, 12)))
        units, codes, _, _ = pre.units(pa.array([text]))
        unit, found = pre.pre_tokens(units)
        by = {}
        for k, p in zip(unit.tolist(), found.to_pylist()):
            by.setdefault(k, []).append(p)
        got = [p for c in codes.tolist() for p in sorted(by.get(c, []), key=units[c].as_py().find)]
        want = [text[a:b].encode() for _, (a, b) in pre.parts(text)]
        assert sorted(got) == sorted(want), text


def test_each_pre_token_is_counted_once(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " + "y" * 40) for i in range(50)], SCHEMA).repartition(4)
    rows = counts.pre_tokens(docs, PATH).collect()
    assert len({r.key for r in rows}) == len(rows) == 6
    assert all(len(r.key.encode()) <= 33 for r in rows)
    assert {r.key: (r.n, r.pieces) for r in rows}[" the"] == (50, 1)


def test_odd_tables(spark):
    assert counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "k", 2, 3)], "doc_id long, text string, key string, row int, known int")
    assert lines(counts.token_counts(docs).collect()) == lines([brute(1, "a b")])
    named = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    assert lines(counts.token_counts(named, limit=1).collect()) == lines([("k", 3, 2, True)])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.PreTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_token_counts"](spark, SF).collect()
    assert lines(got) == lines(brute(*r) for r in docs)
