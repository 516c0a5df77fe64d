"""Language identification: unigram piece models per language, each word scored over all its segmentations."""

from __future__ import annotations

import json
import string
from collections import Counter, deque
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.llm.common import held_out, slices, written

#: Documents per language that a model is fitted on, at most about.
TRAIN_DOCS = 1500
#: Languages at most: a model holds a number per piece and language.
MOST_LANGS = 500
#: Bytes of a piece up to which a table holds all places of a word (the few longer ones are listed one by one), and bytes
#: of a word from which it is scored on its own.
PIECE_BYTES, LONG_WORD = 10, 48
#: Words whose scores a task remembers; beyond that it starts afresh.
CACHE_WORDS = 200_000
#: Documents whose new words are scored together.
CHUNK_DOCS = 1000
ROUNDS = 3
#: Added to a piece's expected count, so that no piece is impossible in any language.
PRIOR = 0.01

LETTERS = regex.compile(r"\p{L}+")


class Vocabulary(tuple):
    """Ids of the pieces inside a word, of those that end one, and the number of ids."""

    @cached_property
    def trie(self) -> "Trie":
        return Trie(self)


class Trie:
    """The beginnings of pieces as numbered nodes in flat arrays, so that many words go down it together.

    An edge is a key node * 256 + byte in a sorted array; `top` holds the nodes of beginnings of two bytes. inside and
    ending hold a node's piece, 0 for none.
    """

    def __init__(self, vocab: Vocabulary):
        nodes: dict[bytes, int] = {b"": 0}
        for one in vocab[:2]:
            for piece in one:
                for n in range(1, len(piece) + 1):
                    nodes.setdefault(piece[:n], len(nodes))
        self.inside, self.ending = (np.array([one.get(x, 0) for x in nodes], np.int32) for one in vocab[:2])
        edges = sorted((nodes[x[:-1]] * 256 + x[-1], k) for x, k in nodes.items() if x)
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges))
        self.first = np.array([nodes[bytes([b])] for b in range(256)])
        self.top = np.array([nodes.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])

    def walk(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, rows, nodes): the rows of raw whose first n bytes begin a piece, as long as there are any."""
        rows = np.arange(len(raw))
        yield 1, rows, self.first[raw[:, 0]]
        for n in range(2, raw.shape[1] + 1):
            if n == 2:
                node = self.top[raw[:, 0].astype(np.int64) * 256 + raw[:, 1]]
                known = node >= 0
                rows, node = rows[known], node[known]
            else:
                key = node * 256 + raw[rows, n - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                rows, node = rows[known], self.to[at[known]]
            if not len(rows):
                return
            yield n, rows, node


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """Ids of the pieces inside a word and of those that end one, from a byte-level BPE file, and the number of ids.

    The file writes a byte that prints as itself and the others, in order, as the characters from U+0100 on. Id 0 is
    no piece. All single bytes are pieces, so every word has a segmentation.
    """
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    byte = {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    inside: dict[bytes, int] = {}
    ending: dict[bytes, int] = {}
    for piece in sorted(pieces, key=pieces.get):
        end = piece.endswith("</w>")
        own = piece.removesuffix("</w>")
        if own and all(c in byte for c in own):
            key = bytes(byte[c] for c in own)
            (ending if end else inside).setdefault(key, len(inside) + len(ending) + 1)
    for b in range(256):
        for one in (inside, ending):
            one.setdefault(bytes([b]), len(inside) + len(ending) + 1)
    return Vocabulary((inside, ending, len(inside) + len(ending) + 1))


def longest(vocab: tuple) -> int:
    """Bytes in the vocabulary's longest piece."""
    return max(max(map(len, one)) for one in vocab[:2])


def _lattice(words: list[bytes], length: int, vocab: Vocabulary) -> tuple[np.ndarray, list[tuple]]:
    """The places of pieces in words of the same length.

    ids[w, i, n-1] is the piece of n bytes at byte i, up to PIECE_BYTES; longer ones are listed as (i, n, words that
    have one there, their pieces), by i.
    """
    most = min(PIECE_BYTES, length)
    raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)
    ids = np.zeros((len(words), length, most), np.int32)
    longer = []
    for i in range(length):
        for n, rows, node in vocab.trie.walk(raw[:, i:]):
            piece = (vocab.trie.ending if i + n == length else vocab.trie.inside)[node]
            if n <= most:
                ids[rows, i, n - 1] = piece
            elif piece.any():
                longer.append((i, n, rows[piece > 0], piece[piece > 0].astype(np.int64)))
    return ids, longer


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for length, which in groups.items():
        for k in range(0, len(which), 4096):
            yield length, which[k : k + 4096]


#: Probabilities are multiplied by this per byte, so that products over a word stay within a double's range.
SCALE = 2.0**7


def word_scores(words: list[bytes], odds: np.ndarray, vocab: tuple) -> np.ndarray:
    """log P(word | language) summed over all segmentations (forward algorithm); odds[piece, language]."""
    out, most = np.zeros((len(words), odds.shape[1])), longest(vocab)
    for length, which in _by_length(words):
        own = [words[k] for k in which]
        if length > LONG_WORD:
            for k, w in zip(which, own):
                out[k] = _long_word(w, odds, vocab, most)
            continue
        ids, longer = _lattice(own, length, vocab)
        ahead = [np.ones((len(own), odds.shape[1]))]
        for j in range(1, length + 1):
            total = np.zeros_like(ahead[0])
            for n in range(1, min(PIECE_BYTES, j) + 1):
                total += ahead[j - n] * odds[ids[:, j - n, n - 1]] * SCALE**n
            for i, n, at, piece in longer:
                if i + n == j:
                    total[at] += ahead[i][at] * odds[piece] * SCALE**n
            ahead.append(total)
        out[which] = np.log(ahead[length]) - length * np.log(SCALE)
    return out


def _long_word(word: bytes, odds: np.ndarray, vocab: tuple, most: int | None = None) -> np.ndarray:
    """The same for one word of any length, in logs; most: bytes in the vocabulary's longest piece."""
    inside, ending, _ = vocab
    most = most or longest(vocab)
    ahead = deque([np.zeros(odds.shape[1])], most)
    for j in range(1, len(word) + 1):
        known = (ending if j == len(word) else inside).get
        ways = [(a, k) for n, a in enumerate(reversed(ahead), 1) if (k := known(word[j - n : j]))]
        total = np.array([a for a, _ in ways]) + np.log(odds[[k for _, k in ways]])
        ahead.append(np.logaddexp.reduce(total))
    return ahead[-1]


def _long_counts(word: bytes, odds: np.ndarray, vocab: tuple, most: int) -> Iterator[tuple[int, float]]:
    """(piece, expected uses) at each place of one word of any length, in logs; odds[piece] of its language."""
    inside, ending, _ = vocab
    size = len(word)
    ahead, back = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    ahead[0] = back[size] = 0
    for j in range(1, size + 1):
        known = (ending if j == size else inside).get
        ways = [(i, k) for i in range(max(0, j - most), j) if (k := known(word[i:j]))]
        ahead[j] = np.logaddexp.reduce(ahead[[i for i, _ in ways]] + np.log(odds[[k for _, k in ways]]))
    for i in range(size - 1, -1, -1):
        ways = [(j, k) for j in range(i + 1, min(size, i + most) + 1) if (k := (ending if j == size else inside).get(word[i:j]))]
        parts = back[[j for j, _ in ways]] + np.log(odds[[k for _, k in ways]])
        back[i] = np.logaddexp.reduce(parts)
        yield from zip([k for _, k in ways], np.exp(ahead[i] + parts - ahead[size]).tolist())


def expected_counts(words: list[bytes], counts: np.ndarray, langs: np.ndarray, odds: np.ndarray, vocab: tuple) -> np.ndarray:
    """Expected uses of each piece in each language over all segmentations of the words (forward and backward)."""
    used, most = np.zeros(odds.size), longest(vocab)
    for length, which in _by_length(words):
        if length > LONG_WORD:
            for k in which:
                for piece, share in _long_counts(words[k], odds[:, langs[k]], vocab, most):
                    used[piece * odds.shape[1] + langs[k]] += share * counts[k]
            continue
        own, lang, times = [words[k] for k in which], langs[which], counts[which]
        ids, longer = _lattice(own, length, vocab)
        longer = [(i, n, at, piece, odds[piece, lang[at]] * SCALE**n) for i, n, at, piece in longer]
        p = odds[ids, lang[:, None, None]] * SCALE ** np.arange(1, ids.shape[2] + 1)
        ahead, back = np.zeros((length + 1, len(own))), np.zeros((length + 1, len(own)))
        ahead[0] = back[length] = 1
        for j in range(1, length + 1):
            for n in range(1, min(PIECE_BYTES, j) + 1):
                ahead[j] += ahead[j - n] * p[:, j - n, n - 1]
            for i, n, at, _, q in longer:
                if i + n == j:
                    ahead[j, at] += ahead[i, at] * q
        for i in range(length - 1, -1, -1):
            for n in range(1, min(PIECE_BYTES, length - i) + 1):
                back[i] += p[:, i, n - 1] * back[i + n]
            for start, n, at, _, q in longer:
                if start == i:
                    back[i, at] += q * back[i + n, at]
        for i in range(length):
            for n in range(1, min(PIECE_BYTES, length - i) + 1):
                share = ahead[i] * p[:, i, n - 1] * back[i + n] / ahead[length] * times
                np.add.at(used, ids[:, i, n - 1].astype(np.int64) * odds.shape[1] + lang, share)
        for i, n, at, piece, q in longer:
            np.add.at(used, piece * odds.shape[1] + lang[at], ahead[i, at] * q * back[i + n, at] / ahead[length, at] * times[at])
    return used.reshape(odds.shape)


def letter_runs(text: str | None) -> list[bytes]:
    low = text.lower().strip(string.punctuation) if text else ""
    if low.isalpha():
        return [low.encode()]
    return [w.encode() for w in LETTERS.findall(low)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update((lang, w) for w in letter_runs(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def _expected(batches: Iterator[pa.RecordBatch], langs: list[str], odds, path: str) -> Iterator[pa.RecordBatch]:
    vocab, place = vocabulary(path), {x: k for k, x in enumerate(langs)}
    for batch in batches:
        lang, word, n = (batch.column(k) for k in range(3))
        used = expected_counts(word.to_pylist(), n.to_numpy().astype(float), np.array([place[x] for x in lang.to_pylist()], np.int64), odds.value, vocab)
        piece, which = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(used[piece, which])], names=["piece", "which", "used"])


class LanguageModel:
    """Piece probabilities of each language over a fixed vocabulary, and the languages' shares of documents."""

    def __init__(self, langs: list[str], odds: np.ndarray, shares: np.ndarray, path: str):
        self.langs, self.odds, self.shares, self.path = langs, odds, shares, path

    @classmethod
    def fit(cls, docs: DataFrame, path: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, most_langs: int = MOST_LANGS) -> "LanguageModel":
        """Expectation maximisation over the distinct words of a bounded sample: about train_docs documents a language.

        docs: the rows to learn from, with text and lang; null texts and langs are left out. A text is in the sample by
        a hash of itself, at a rate that the language's number of distinct texts (within a few percent) sets, and counts
        once however many rows repeat it; ids have no part in it. Only sums per piece and language, bounded by the
        vocabulary, come to the driver; more than most_langs languages are refused.
        """
        spark, path = docs.sparkSession, path or public_tokenizers.path("word_bpe_49k.json")
        docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        texts = F.approx_count_distinct(F.xxhash64("text")).alias("texts")
        counts = {r.lang: (r.n, r.texts) for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), texts).limit(most_langs + 1).collect()}
        if len(counts) > most_langs:
            raise ValueError(f"over {most_langs} languages")
        langs = sorted(counts)
        size = vocabulary(path)[2]
        if not langs:
            return cls([], np.zeros((size, 0)), np.zeros(0), path)
        rate = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, train_docs / max(1, counts[k][1]))))), F.col("lang"))
        sample = docs.filter(F.pmod(F.xxhash64("text", F.lit("lang")), F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text").distinct()
        words = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = written(words, "lang-words")
        odds = np.full((size, len(langs)), 1.0 / size)
        odds[0] = 0
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(odds)
            used = words.mapInArrow(partial(_expected, langs=langs, odds=sent, path=path), "piece int, which int, used double").groupBy("piece", "which").agg(F.sum("used").alias("used")).toPandas()
            sent.destroy()
            odds = np.full_like(odds, PRIOR)
            odds[used["piece"], used["which"]] += used["used"]
            odds[0] = 0
            odds /= odds.sum(axis=0)
        shares = np.array([counts[k][0] for k in langs], float)
        return cls(langs, odds, shares / shares.sum(), path)

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, lang_pred, score): the likeliest language of each whole text and its posterior.

        `und` with score 0 where the text is null or has no letter (or nothing was learned); ties go to the first
        language by name; texts and letter runs of any length are scored whole; repeated rows and null ids keep their
        rows; an empty table gives no rows; other columns are ignored, whatever their names.
        """
        sent = docs.sparkSession.sparkContext.broadcast((self.langs, self.odds, self.shares))
        kind = dict(docs.dtypes)["doc_id"]
        rows = docs.select("doc_id", "text").mapInArrow(partial(_predict, model=sent, path=self.path), f"doc_id {kind}, lang_pred string, score double")
        return rows.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def _predict(batches: Iterator[pa.RecordBatch], model, path: str, cache_words: int = CACHE_WORDS) -> Iterator[pa.RecordBatch]:
    langs, odds, shares = model.value
    vocab = vocabulary(path)
    prior = np.log(shares) if langs else np.zeros(0)
    place: dict[str, int] = {}
    table = np.zeros((1024, len(langs) + 1))  # a word's score for each language, and its number of letter runs
    for batch in slices(batches, CHUNK_DOCS):
        preds, scores = [], []
        if batch.num_rows:
            split = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            if len(place) > cache_words:
                place.clear()
            new = list({w for words in split for w in words if w not in place})
            runs = [letter_runs(w) for w in new]
            owner = np.repeat(np.arange(len(new)), [len(r) for r in runs])
            each = word_scores([w for r in runs for w in r], odds, vocab)
            rows = np.zeros((len(new), len(langs) + 1))
            np.add.at(rows, owner, np.column_stack([each, np.ones(len(each))]))
            base = len(place)
            while base + len(new) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[base : base + len(new)] = rows
            place.update((w, base + i) for i, w in enumerate(new))
            for words in split:
                total = table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
                if not langs or total[-1] == 0:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                ll = total[:-1] + prior
                best = int(np.argmax(ll))
                preds.append(langs[best])
                scores.append(float(1 / np.exp(ll - ll[best]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    return LanguageModel.fit(docs.filter(~held_out(4, 2)), path).predict(docs)
