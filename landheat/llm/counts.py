"""Token counts: pieces of each distinct pre-token, counted once and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.llm.common import sized_slices, slices, written

LIMIT = 512
#: A pre-token that makes up more than one in so many is frequent; so there can't be more frequent ones than this.
SHARES = 1 << 20
#: Longer pre-tokens (in bytes) are known by a digest, so that keys are short whatever the texts hold.
KEY_BYTES = 32

_BYTES = pa.large_binary()
#: A blank before a character that surely is no white space: no ASCII control, nor one of the first bytes that the
#: white space beyond ASCII has. A mark that no UTF-8 text holds parts what follows.
_CUT, _MARK = rb" ([^\x00-\x20\x7f\xc2\xe1\xe2\xe3])", b"\xff"
#: Units of letters of ISO 8859-1 and then ASCII marks: at most two pre-tokens.
_LETTERS, _SIGNS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+", rb"[!-/:-@\[-`{-~]"
_WORD = rb"^ ?" + _LETTERS + _SIGNS + rb"*$"


class PreTokenizer:
    """The pre-tokens of texts as a byte-level tokenizer makes them.

    A unit is a stretch of text that begins with a blank in front of other than white space. Its pre-tokens are the
    same whatever stands around it: no pre-token goes on over such a blank, and white space that ends before one is
    parted from it in the same way as at the end of a text. So distinct units, most of them words, are parted once.
    Strings of the tokenizer's added tokens part a text before all else and count as one token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        kind = type(tokenizer.pre_tokenizer).__name__
        if kind != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space or tokenizer.normalizer is not None:
            raise ValueError(f"{path} is no byte-level tokenizer of unchanged texts")
        self.parts = tokenizer.pre_tokenizer.pre_tokenize_str
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path} has added tokens that take white space in or stand alone only")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.names = names

    def spans(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts parted at added tokens: spans, the text of each, and the number of added tokens of each text."""
        held = pa.array(np.zeros(len(texts), bool))
        for name in self.names:
            held = pc.or_(held, pc.match_substring(texts, pattern=name))
        with_any = np.flatnonzero(held.to_numpy(zero_copy_only=False))
        own, tokens = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        if not len(with_any):
            return texts, own, tokens
        found, of = [], []
        for k in with_any.tolist():
            parts = self.added.split(texts[k].as_py())
            tokens[k] = len(parts) - 1
            found += parts
            of += [k] * len(parts)
        rest = texts.filter(pc.invert(held))
        return pa.concat_arrays([rest, pa.array(found, _BYTES)]), np.append(np.delete(own, with_any), of), tokens

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units; the number of one, and of its text, for each place of a unit; added tokens of each text."""
        spans, own, tokens = self.spans(pc.fill_null(texts.cast(_BYTES), b""))
        lists = pc.split_pattern(pc.replace_substring_regex(spans, pattern=_CUT, replacement=_MARK + rb" \1"), pattern=_MARK)
        coded = pc.list_flatten(lists).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), own[pc.list_parent_indices(lists).to_numpy()], tokens

    def pre_tokens(self, units: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(unit, pre-token) pairs: words by their pattern in columns, other units one by one."""
        word = pc.match_substring_regex(units, pattern=_WORD)
        places = np.flatnonzero(word.to_numpy(zero_copy_only=False))
        words = units.filter(word)
        signs = pc.replace_substring_regex(words, pattern=rb"^ ?" + _LETTERS, replacement=b"")
        some = pc.greater(pc.binary_length(signs), 0)
        of, found = [], []
        others = pc.invert(word)
        for k, unit in zip(np.flatnonzero(others.to_numpy(zero_copy_only=False)).tolist(), units.filter(others).to_pylist()):
            text = unit.decode()
            parts = [text[a:b].encode() for _, (a, b) in self.parts(text)]
            found += parts
            of += [k] * len(parts)
        letters = pc.replace_substring_regex(words, pattern=_SIGNS + rb"+$", replacement=b"")
        every = [letters, signs.filter(some), pa.array(found, _BYTES)]
        return np.concatenate([places, places[some.to_numpy(zero_copy_only=False)], np.array(of, np.int64)]), pa.concat_arrays(every)


def keys_of(pre_tokens: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Keys of the pre-tokens, and those that are only known by a digest, which no short one equals as it is longer."""
    long = pc.greater(pc.binary_length(pre_tokens), KEY_BYTES)
    own = pc.if_else(long, pre_tokens, pa.scalar(None, _BYTES))
    if own.null_count == len(own):
        return pre_tokens, own
    digests = [b"#" + hashlib.blake2b(p, digest_size=KEY_BYTES // 2).hexdigest().encode() for p in pre_tokens.filter(long).to_pylist()]
    return pc.replace_with_mask(pre_tokens, long, pa.array(digests, _BYTES)), own


@lru_cache(1)
def _pre_tokenizer(path: str) -> PreTokenizer:
    """One for all tasks of a Python worker."""
    return PreTokenizer(path)


def _seen(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(key, long, n): the pre-tokens of a task's texts, and how often the units with each occur."""
    pre = _pre_tokenizer(path)
    for batch in sized_slices(batches, 0):
        units, codes, _, _ = pre.units(batch.column(0))
        unit, found = pre.pre_tokens(units)
        key, long = keys_of(found)
        times = pa.array(np.bincount(codes, minlength=len(units))[unit])
        yield pa.RecordBatch.from_arrays([key.cast(pa.string()), long.cast(pa.string()), times], names=["key", "long", "n"])


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(key, n, pieces): how many pieces each pre-token has."""
    encode = _pre_tokenizer(path).tokenizer.encode_batch_fast
    for batch in slices(batches, 2000):
        key, long, n = batch.columns
        texts = [k if t is None else t for k, t in zip(key.to_pylist(), long.to_pylist())]
        yield pa.RecordBatch.from_arrays([key, n, pa.array([len(e) for e in encode(texts, add_special_tokens=False)], pa.int64())], names=["key", "n", "pieces"])


def pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(key, n, pieces) of every distinct pre-token of the texts; each is counted in one task, once."""
    found = docs.select("text").mapInArrow(partial(_seen, path=path), "key string, long string, n long")
    distinct = found.groupBy("key", "long").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(partial(_pieces, path=path), "key string, n long, pieces long")


def _frequencies(batches: Iterator[pa.RecordBatch], path: str, frequent) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, row, known, keys, times): pieces of the frequent pre-tokens, and how often each other one occurs.

    A key can come up more than once in a text, by the units it is in.
    """
    pre, (names, pieces) = _pre_tokenizer(path), frequent.value
    row = TaskContext.get().partitionId() << 33
    for batch in sized_slices(batches, 1):
        units, codes, texts, tokens = pre.units(batch.column(1))
        unit, found = pre.pre_tokens(units)
        key, _ = keys_of(found)
        at = pc.fill_null(pc.index_in(key, value_set=names), -1).to_numpy()
        often = at >= 0
        of_unit = np.zeros(len(units), np.int64)
        np.add.at(of_unit, unit[often], pieces[at[often]])
        np.add.at(tokens, texts, of_unit[codes])

        rare_unit, rare_key = unit[~often], np.flatnonzero(~often)
        order = np.argsort(rare_unit, kind="stable")
        rare_unit, rare_key = rare_unit[order], rare_key[order]
        first, n = np.searchsorted(rare_unit, np.arange(len(units))), np.bincount(rare_unit, minlength=len(units))
        place = n[codes] > 0
        pair, times = np.unique(texts[place] * len(units) + codes[place], return_counts=True)
        text, own = pair // max(1, len(units)), pair % max(1, len(units))
        ends = np.cumsum(n[own])
        which = rare_key[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[own] - ends + n[own], n[own])]
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(text, weights=n[own], minlength=batch.num_rows))).astype(np.int32))
        keys = pa.ListArray.from_arrays(offsets, key.take(pa.array(which)).cast(pa.string()))
        turns = pa.ListArray.from_arrays(offsets, pa.array(np.repeat(times, n[own]).astype(np.int64)))
        rows = pa.array(np.arange(row, row + batch.num_rows))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows, pa.array(tokens), keys, turns], names=["doc_id", "n_bytes", "row", "known", "keys", "times"])


def token_counts(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): how many tokens each text has, without one list of ids of a text.

    Pre-tokens that make up more than 1 / SHARES of all (at most SHARES of them, each of 33 bytes or less) are
    broadcast with their counts; the rest meet their counts in a shuffle, where none has a larger share than that.
    A null text is empty and has no tokens; a null doc_id and repeated rows keep their rows; a very long text counts
    as any other, and so does a very long pre-token, which travels under a digest; an empty table gives no rows; other
    columns are ignored, whatever their names. Strings of the vocabulary's special tokens count as these tokens, as
    the tokenizer's library has it by default.
    """
    path = vocab_path or public_tokenizers.path("byte_bpe_50k.json")
    spark: SparkSession = docs.sparkSession
    known = written(pre_tokens(docs, path), "pre-tokens")
    total = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(SHARES) > F.lit(total)
    own = known.filter(often).select("key", "pieces").toArrow()
    keys, pieces = own.column(0).combine_chunks().cast(_BYTES), own.column(1).to_numpy()
    frequent = spark.sparkContext.broadcast((keys, pieces))

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"doc_id {kind}, n_bytes long, row long, known long, keys array<string>, times array<long>"
    counted = written(rows.mapInArrow(partial(_frequencies, path=path, frequent=frequent), schema), "frequencies")
    pairs = counted.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", "p.keys", "p.times")
    rest = pairs.join(known.filter(~often), F.col("keys") == F.col("key")).groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n_tokens = F.col("known") + F.coalesce("rest", F.lit(0))
    return counted.join(rest, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
