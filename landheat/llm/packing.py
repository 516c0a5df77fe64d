"""Best-fit packing: documents become token pieces, and a plan made over the length histogram gives each its place."""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.llm.common import running_total, slices, written

CAPACITY = 2048
#: Distinct words in one generation of those whose ids a worker remembers; it keeps two.
CACHE_WORDS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: ASCII marks and signs; at the end of a word of letters they are a run of characters of their own.
MARKS = string.punctuation
#: How the vocabulary marks a token that ends a word; words that are encoded as one text.
WORD_END, LINE_WORDS = "</w>", 2048


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, found word by word.

    The tokenizer never joins what white space parts, so ids of a text are those of its words in turn, and each
    distinct word is encoded once. Words are kept in two generations: when the young one is full it becomes the old
    one, whose words move up again as they are met, so common words stay.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = partial(tokenizer.encode_batch_fast, add_special_tokens=False)
        #: By token id: whether it ends a word.
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith(WORD_END)]] = True
        self.cache_words, self.young, self.old = cache_words, {"": b""}, {}

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        for k in range(0, len(texts), 64):
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[k : k + 64]]
            if len(self.young) > self.cache_words:
                self.young, self.old = {"": b""}, self.young
            self._learn({w for words in split for w in words}.difference(self.young))
            known = self.young.__getitem__
            for words in split:
                yield b"".join(map(known, words))

    def _learn(self, new: set[str]) -> None:
        young, old = self.young, self.old
        letters, others = set(), set()
        joined = []
        for w in new:
            if w in old:
                young[w] = old[w]
                continue
            core = w.rstrip(MARKS)
            if not plain(core):
                others.add(w)
                continue
            low, mark = core.lower(), w[len(core) :]
            if low in old:
                young.setdefault(low, old[low])
            elif low not in young:
                letters.add(low)
            if mark and mark not in young:
                others.add(mark)
            if mark or low != w:
                joined.append((w, low, mark))
        for some in _lists(letters):
            own = self._line(some)
            if own is None:
                others.update(some)
            else:
                young.update(zip(some, own))
        for some in _lists(others):
            young.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, self.encode(some)))
        young.update((w, young[low] + young[mark]) for w, low, mark in joined)

    def _line(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of letters, encoded as one text: each is one run of characters, and so has one token that ends it.

        One long text costs half of many short ones. None if the ends do not match the words one by one.
        """
        ids = np.array(self.encode([" ".join(words)])[0].ids, "<u4")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(words) or stops[-1] != 4 * len(ids):
            return None
        line = ids.tobytes()
        return [line[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def _lists(words: set[str]) -> Iterator[list[str]]:
    every = list(words)
    for k in range(0, len(every), LINE_WORDS):
        yield every[k : k + LINE_WORDS]


def plain(word: str) -> bool:
    """Letters whose case no neighbour changes: one run of characters, with the same ids in lower case and by itself.

    The tokenizer starts a new run where letters end, and reads letters in lower case; beyond U+00FF a character's case
    can depend on its neighbours.
    """
    return word.isalpha() and (word.isascii() or max(word) < "\u0100")


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker."""
    return WordTokenizer(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = word_tokenizer(path)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1).to_pylist())):
            ids += end
            for piece, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocab_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end id, cut only where over capacity."""
    path = vocab_path or public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=path, capacity=capacity, end_id=end_id), PIECES.replace("doc_id long", f"doc_id {kind}"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit in decreasing order, over counts: (length, first_rank, n, first_sequence, offset).

    Sequences with the same free space are kept as runs of consecutive numbers; a run takes as many pieces of one
    length at once as it has sequences. So the work depends on the number of lengths, not on that of pieces.
    """
    free: list[int] = []  # the free spaces that occur, ascending
    runs: dict[int, list[tuple[int, int]]] = {}
    slots: list[tuple[int, int, int, int, int]] = []
    new = 0

    def put(space: int, first: int, n: int) -> None:
        if space not in runs:
            runs[space] = []
            insort(free, space)
        runs[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                n = -(-left // (capacity // length))
                put(capacity, new, n)
                new += n
                continue
            space = free[at]
            first, n = runs[space].pop()
            take = min(n, left)
            if n > take:
                runs[space].append((first + take, n - take))
            if not runs[space]:
                del runs[space], free[at]
            slots.append((length, rank, take, first, capacity - space))
            if space > length:
                put(space - length, first, take)
            rank, left = rank + take, left - take
    return slots


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each piece its sequence_id and offset. cut is read several times: hand over a written table.

    Only the histogram, at most one count per length up to `capacity`, comes to the driver, and only the plan, whose
    size depends on the number of lengths alone, is broadcast. A piece takes the slot of its rank within its length.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, first_rank long, n long, first_sequence long, offset long")
    ranked = running_total(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1).cast("long"), "rank").alias("p")
    s = F.broadcast(slots).alias("s")
    fits = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(s, fits)
    return placed.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def best_fit(docs: DataFrame, vocab_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens; one row per piece.

    A null or empty text is the end id alone; a text of over `capacity` tokens is cut into whole pieces and a rest; a
    null doc_id keeps its row; repeated rows get places of their own, and rows that tie in id, piece and ids take
    adjoining ranks in no fixed order; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return packed(written(pieces(docs, vocab_path, capacity, end_id), "pieces"), capacity)
