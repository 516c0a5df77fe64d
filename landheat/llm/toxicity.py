"""Toxicity by nearest labelled examples: exact TF-IDF cosines from a block-max inverted index, and calibrated votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.llm import simhash
from landheat.llm.common import held_out, slices, written

#: Labelled examples of each class that are learned from, at most.
EXAMPLES = 3000
#: A term weighs FLOOR, and SLOPE more for each standard error beyond CHANCE that toxic examples have it more often.
FLOOR, SLOPE, CHANCE = 0.05, 0.1, 2.0
#: Standard errors, and examples that are not near-copies, from which a term is called telling (in reports only).
LEAST_Z, LEAST_DOCS = 5.0, 3
NEIGHBOURS, BLOCK, FOLDS = 15, 64, 5
THRESHOLD = 0.7
#: A term of over one in so many examples is frequent; texts whose frequent terms are multiplied at once.
FREQUENT, TEXTS = 16, 128
#: Terms: runs of word characters other than digits and underscores, in lower case.
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Finder:
    """Counts the terms of a vocabulary in whole texts."""

    def __init__(self, terms: list[str]):
        self.place = {t: k for k, t in enumerate(terms)}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the text's terms, ascending, and how often it has them."""
        terms = terms_of(text)
        found = np.sort(np.fromiter(map(self.place.get, terms, repeat(-1)), np.int64, len(terms)))
        found = found[np.searchsorted(found, 0) :]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        return found[first], np.diff(first, append=len(found))


@lru_cache(2)
def finder(sent) -> Finder:
    """One per broadcast vocabulary for all tasks of a Python worker."""
    return Finder(sent.value.to_pylist())


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100):
        texts = batch.column(2).to_pylist()
        prints = np.fromiter((simhash.fingerprint((t or "").encode()) for t in texts), np.uint64, len(texts)).view(np.int64)
        found = [Counter(terms_of(t)) for t in texts]
        columns = [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(prints), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "fingerprint", "terms", "counts"])


def copy_groups(prints: np.ndarray) -> np.ndarray:
    """A number for each of a bounded set of fingerprints, shared by those that SimHash links."""
    distinct, group = np.unique(prints, return_inverse=True)
    label = np.arange(len(distinct))
    for third in range(len(simhash.THIRDS)):
        if len(distinct):
            links = simhash.node_links(pd.DataFrame({"third": third, "node": 0, "fingerprint": distinct}), depth=0, budget=4)
            label = simhash.unite(label, np.searchsorted(distinct, links["a"]), np.searchsorted(distinct, links["b"]))
    return np.unique(label[group], return_inverse=True)[1]


def _term_docs(batches: Iterator[pa.RecordBatch], vocab) -> Iterator[pa.RecordBatch]:
    find = finder(vocab)
    seen = np.zeros(len(find.place), np.int64)
    for batch in slices(batches):
        own = [find.counts(t)[0] for t in batch.column(0).to_pylist()]
        seen += np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64), minlength=len(seen))
    which = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(seen[which])], names=["term", "docs"])


@dataclass
class Examples:
    """Distinct term vectors of the labelled examples: `terms` and `counts` of example i lie at starts[i] .. starts[i+1]-1.

    Near-copies have the same `group`, and each counts 1/n of its group of n in a term's relevance. Those with equal
    vectors are one example, under their least id; `labels` is the toxic share among them, `rows` how many there are.
    """

    ids: list[str]
    labels: np.ndarray
    rows: np.ndarray
    group: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, found: pa.Table) -> tuple["Examples", pa.Array]:
        """Examples and the vocabulary, all of their terms in order, from (doc_id, toxic, fingerprint, terms, counts) by doc_id."""
        lists, counts = (found[c].combine_chunks() if len(found) else pa.array([], found.schema.field(c).type) for c in ("terms", "counts"))
        lists, counts = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (lists, counts))
        counts = counts.flatten().to_numpy()
        words = lists.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order))
        every = place[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
        ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
        ids, toxic, groups = found["doc_id"].to_pylist(), found["toxic"].to_pylist(), copy_groups(found["fingerprint"].to_numpy())
        same: dict[tuple, int] = {}
        first, labels, vectors = [], [], []
        for i in range(len(ids)):
            if ends[i] == ends[i + 1]:
                continue
            own = every[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
            own = tuple(x[np.argsort(own[0])] for x in own)
            k = same.setdefault((int(groups[i]), own[0].tobytes(), own[1].tobytes()), len(first))
            if k == len(first):
                first.append(i)
                labels.append([])
                vectors.append(own)
            labels[k].append(toxic[i])
        none = np.zeros(0, np.int64)
        return cls(
            [ids[i] for i in first], np.array([np.mean(x) for x in labels]), np.array([len(x) for x in labels], float), groups[first] if first else none,
            np.cumsum([0, *(len(t) for t, _ in vectors)]), np.concatenate([t for t, _ in vectors]) if vectors else none, np.concatenate([n for _, n in vectors]) if vectors else none,
        ), words.dictionary.take(order)

    def shares(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each of the examples `which` counts as a toxic one and as another; a group of near-copies counts 1."""
        size = np.bincount(self.group[which], minlength=int(self.group.max(initial=-1)) + 1)
        own = np.zeros(len(self.ids))
        own[which] = 1 / size[self.group[which]]
        return own * self.labels, own * (1 - self.labels)

    def standard_errors(self, n_terms: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By term: by how many standard errors toxic ones among the examples `which` have it more often; how many have it."""
        toxic, other = self.shares(which)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        with_t, with_o = (np.bincount(self.terms, x[owner], n_terms) for x in (toxic, other))
        n1, n0 = max(1.0, toxic.sum()), max(1.0, other.sum())
        share = (with_t + with_o) / (n1 + n0)
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        return (with_t / n1 - with_o / n0) / spread, with_t + with_o

    def weights(self, idf: np.ndarray, which: np.ndarray) -> np.ndarray:
        """A term's idf times its relevance by the examples `which`; above 0 for all terms."""
        return idf * (FLOOR + SLOPE * np.maximum(0, self.standard_errors(len(idf), which)[0] - CHANCE))

    def indexed(self, weight: np.ndarray, which: np.ndarray) -> "BlockMaxIndex":
        return BlockMaxIndex.build([(self.ids[i], float(self.labels[i]), *self.vector(i, weight)) for i in which.tolist()], len(weight))

    def vector(self, i: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = self.terms[self.starts[i] : self.starts[i + 1]], self.counts[self.starts[i] : self.starts[i + 1]]
        return terms, unit(terms, counts, weight)


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The TF-IDF weights (1 + log tf) * weight of a text's terms, to length 1."""
    value = (1 + np.log(counts)) * weight[terms]
    return value / math.sqrt(float(value @ value)) if len(value) else value


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. last[i]-1 of all i in turn."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class BlockMaxIndex:
    """Postings of rare terms, cut into cells of one block of examples each with the largest weight beside it.

    The terms of over one in FREQUENT examples have a full row each instead, so what they add to the cosines of all
    examples is one matrix product for many texts.
    """

    ids: list
    labels: np.ndarray
    n_blocks: int
    row: np.ndarray  # of a frequent term in `dense`, -1 of a rare one
    dense: np.ndarray  # [frequent term, example]
    cells: np.ndarray  # first cell of each term
    block: np.ndarray  # of a cell
    most: np.ndarray  # of a cell
    starts: np.ndarray  # first posting of each cell
    examples: np.ndarray
    values: np.ndarray
    edges: np.ndarray  # first example of each block

    @classmethod
    def build(cls, examples: list[tuple], n_terms: int, block: int = BLOCK) -> "BlockMaxIndex":
        """examples: (id, label, terms, values). Those alike in their strongest term share blocks, so bounds are tight."""
        examples = [e for e in examples if len(e[2])]
        examples.sort(key=lambda e: (int(e[2][np.argmax(e[3])]), -float(e[3].max()), str(e[0])))
        n = len(examples)
        n_blocks = max(1, -(-n // block))
        term = np.concatenate([np.zeros(0, np.int32), *(e[2] for e in examples)])
        owner = np.repeat(np.arange(n, dtype=np.int64), [len(e[2]) for e in examples])
        value = np.concatenate([np.zeros(0), *(e[3] for e in examples)])
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) * FREQUENT > n)
        row = np.full(n_terms, -1)
        row[often] = np.arange(len(often))
        dense, full = np.zeros((len(often), n)), row[term] >= 0
        dense[row[term[full]], owner[full]] = value[full]
        term, owner, value = term[~full], owner[~full], value[~full]
        order = np.lexsort((owner, term))
        term, owner, value = term[order], owner[order], value[order]
        cell, starts = np.unique(term.astype(np.int64) * n_blocks + owner // block, return_index=True)
        most = np.maximum.reduceat(value, starts) if len(starts) else np.zeros(0)
        cells = np.searchsorted(cell, np.arange(n_terms + 1) * n_blocks)
        labels = np.array([e[1] for e in examples], float)
        return cls([e[0] for e in examples], labels, n_blocks, row, dense, cells, cell % n_blocks, most, np.append(starts, len(term)), owner, value, np.arange(0, n, block))

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """[vector, example]: what the frequent terms add to each cosine."""
        own = np.zeros((len(vectors), len(self.dense)))
        for x, (terms, values) in zip(own, vectors):
            at = self.row[terms]
            x[at[at >= 0]] = values[at >= 0]
        return own @ self.dense

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0 and their cosines; ties go to the first in the index.

        A block's bound is the most that its examples have from frequent terms, and its cells' largest weights for the
        rare ones. The blocks with the highest bounds are scored first; then all whose bound reaches the k-th best cosine
        found. What is left can't hold a nearer example, so the answer is exact. frequent: this vector's row of that.
        """
        if not len(terms) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        score = self.frequent([(terms, values)])[0] if frequent is None else frequent
        rare = self.row[terms] < 0
        terms, values = terms[rare], values[rare]
        first, last = self.cells[terms], self.cells[terms + 1]
        cell, weight = ranges(first, last), np.repeat(values, last - first)
        block = self.block[cell]
        bound = np.maximum.reduceat(score, self.edges) + np.bincount(block, self.most[cell] * weight, self.n_blocks)
        lead = np.argsort(-bound, kind="stable")[: 2 + k // BLOCK]
        wanted = np.zeros(self.n_blocks, bool)
        wanted[lead] = True
        score = score + self._rare(cell, weight, wanted[block])
        ends = np.append(self.edges, len(score))
        best = np.concatenate([score[ends[b] : ends[b + 1]] for b in lead])
        least = max(np.partition(best, -k)[-k] - 1e-12 if len(best) > k else 0.0, 1e-9)
        rest = ~wanted & (bound >= least)
        if rest.any():
            score += self._rare(cell, weight, rest[block])
        best = np.flatnonzero(score >= least)
        best = best[np.argsort(-score[best], kind="stable")][:k]
        return best, score[best]

    def _rare(self, cell: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """What rare terms add to the cosines, in the blocks of the wanted cells."""
        cell = cell[wanted]
        first, last = self.starts[cell], self.starts[cell + 1]
        at = ranges(first, last)
        return np.bincount(self.examples[at], self.values[at] * np.repeat(weight[wanted], last - first), len(self.ids))

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each vector in turn."""
        for i in range(0, len(vectors), TEXTS):
            some = vectors[i : i + TEXTS]
            for (terms, values), frequent in zip(some, self.frequent(some)):
                yield self.nearest(terms, values, k, frequent)


def vote(index: BlockMaxIndex, which: np.ndarray, cosine: np.ndarray) -> float | None:
    """The toxic share of the neighbours, each with its cosine as weight; None without neighbours."""
    return float(cosine @ index.labels[which] / cosine.sum()) if len(which) else None


def calibration(votes: np.ndarray, labels: np.ndarray, rows: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Points (vote, probability) of a rising line: pool-adjacent-violators over weighted rows, one prior row in each pool."""
    pools: list[list[float]] = []  # weight, toxic weight, sum of votes
    for v, y, w in sorted(zip(votes.tolist(), labels.tolist(), rows.tolist())):
        pools.append([w, w * y, w * v])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0] or pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.zeros(1), np.full(1, prior)
    at, sums, toxic = (np.array(x) for x in zip(*((v / w, w, y) for w, y, v in pools)))
    return at, np.maximum.accumulate((toxic + prior) / (sums + 1))


def _cross_votes(batches: Iterator[pa.RecordBatch], sent, folds: int, k: int) -> Iterator[pa.RecordBatch]:
    """Votes for the examples of a fold by those of the other folds, with term weights learned from these alone."""
    own, idf = sent.value
    for batch in batches:
        for fold in batch.column(0).to_pylist():
            mine = own.group % folds == fold
            rest = np.flatnonzero(~mine)
            weight = own.weights(idf, rest)
            index = own.indexed(weight, rest)
            rows = np.flatnonzero(mine).tolist()
            votes = [vote(index, *near) for near in index.nearest_of([own.vector(i, weight) for i in rows], k)]
            rows, votes = [i for i, v in zip(rows, votes) if v is not None], [v for v in votes if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(votes, pa.float64())], names=["row", "vote"])


class ToxicityModel:
    """Labelled examples in an index over all of their terms; scores whole texts by calibrated votes of the nearest."""

    def __init__(self, vocab, weight: np.ndarray, index: BlockMaxIndex, prior: float, points: tuple[np.ndarray, np.ndarray], terms: tuple[str, ...], k: int):
        #: The vocabulary, broadcast; the number of a term is its place there.
        self.vocab, self.weight, self.index, self.prior, self.points, self.k = vocab, weight, index, prior, points, k
        #: The terms that tell the classes apart, each with "=" before it, for reports; the index holds all others too.
        self.terms = terms

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, corpus: DataFrame, examples: int = EXAMPLES, folds: int = FOLDS, k: int = NEIGHBOURS) -> "ToxicityModel":
        """Learns from the labelled rows handed over: labels (doc_id, toxic) of docs (doc_id, text).

        At most `examples` ids of each class are taken, by a hash of the id, and one text of each (the least by its
        hash). All their terms are indexed; only they, and one count per term, come to the driver, so what it holds and
        sends is bounded by the text of 2 * examples documents. A term's weight is its idf over all documents of
        corpus, times a factor above 0 that rises with how much more often toxic examples have it, where near-copies
        count as one. Votes are calibrated on votes across folds, near-copies in the same fold, weighted back to the
        classes' shares. Null ids and labels are left out; where an id has several labels the largest holds; without
        labels every score is 0.
        """
        spark = docs.sparkSession
        known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        known = written(known, "labels")
        sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
        picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(examples) for c in (0, 1)]
        rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
        rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
        found = rows.mapInArrow(_examples, "doc_id string, toxic int, fingerprint long, terms array<string>, counts array<int>").toArrow().sort_by("doc_id")
        own, terms = Examples.of(found)
        del found
        pa.default_memory_pool().release_unused()
        vocab = spark.sparkContext.broadcast(terms)
        counts = corpus.select("text").mapInArrow(partial(_term_docs, vocab=vocab), "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()
        have = np.zeros(len(terms))
        have[counts["term"]] = counts["docs"]
        idf = np.log((1 + corpus.count()) / (1 + have)) + 1
        every = np.arange(len(own.ids))
        weight = own.weights(idf, every)
        sent = spark.sparkContext.broadcast((own, idf))
        votes = spark.range(0, folds, 1, folds).mapInArrow(partial(_cross_votes, sent=sent, folds=folds, k=k), "row int, vote double").toPandas().sort_values("row")
        sent.destroy()
        at, toxic = votes["row"].to_numpy(), own.labels * own.rows
        # examples stand for their class: as many rows as the class has for each that was taken
        stand = [max(1, sizes.get(c, 0)) / max(1.0, x) for c, x in ((1, toxic.sum()), (0, (own.rows - toxic).sum()))]
        rows_for = (toxic * stand[0], (own.rows - toxic) * stand[1])
        weigh = (rows_for[0] + rows_for[1]) / own.rows
        points = calibration(votes["vote"].to_numpy(), (rows_for[0] / (rows_for[0] + rows_for[1]))[at] if len(at) else at, weigh[at] if len(at) else at, prior)
        z, n = own.standard_errors(len(terms), every)
        telling = np.flatnonzero((np.abs(z) >= LEAST_Z) & (n >= LEAST_DOCS - 1e-9))
        return cls(vocab, weight, own.indexed(weight, every), prior, points, tuple("=" + x for x in terms.take(pa.array(telling)).to_pylist()), k)

    def sent(self, spark: SparkSession):
        return spark.sparkContext.broadcast((self.weight, self.index, self.prior, self.points, self.k))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score, evidence): the calibrated toxic share of the nearest examples, each with its cosine as weight.

        The prior share is the score of empty and null texts and of those that share no term with any example. evidence
        lists the neighbours (id as text, label, cosine), nearest first. Repeated rows and null ids stay; a text of any
        length is counted whole; ties of cosines go to the first example in the index, whose order is fixed.
        """
        kind = dict(docs.dtypes)["doc_id"]
        out = f"doc_id {kind}, score double, evidence array<struct<doc_id: string, label: double, cosine: double>>"
        return docs.select("doc_id", "text").mapInArrow(partial(_scores, vocab=self.vocab, model=self.sent(docs.sparkSession)), out)

    def score_column(self, spark: SparkSession):
        """A function of a text column that gives the score alone, for filters that keep a row's other columns."""
        vocab, sent = self.vocab, self.sent(spark)

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = finder(vocab)
            for part in texts:
                yield pd.Series([s for s, _, _ in scored(find, sent.value, part.tolist())], dtype=float)

        return score


def scored(find: Finder, model: tuple, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """The score of each text, its nearest examples and their cosines."""
    weight, index, prior, points, k = model
    for i in range(0, len(texts), TEXTS):
        counted = [find.counts(t) for t in texts[i : i + TEXTS]]
        for which, cosine in index.nearest_of([(t, unit(t, n, weight)) for t, n in counted], k):
            raw = vote(index, which, cosine)
            yield prior if raw is None else float(np.interp(raw, *points)), which, cosine


def _scores(batches: Iterator[pa.RecordBatch], vocab, model) -> Iterator[pa.RecordBatch]:
    find, index = finder(vocab), model.value[1]
    ids = pa.array(index.ids, pa.string())
    for batch in slices(batches):
        found = list(scored(find, model.value, batch.column(1).to_pylist()))
        which = np.concatenate([np.zeros(0, np.int64), *(w for _, w, _ in found)])
        cosine = np.concatenate([np.zeros(0), *(c for _, _, c in found)])
        near = pa.StructArray.from_arrays([ids.take(pa.array(which)), pa.array(index.labels[which]), pa.array(cosine)], names=["doc_id", "label", "cosine"])
        evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(w) for _, w, _ in found)]), pa.int32()), near)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _, _ in found], pa.float64()), evidence], names=["doc_id", "score", "evidence"])


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model of all documents that learns from the labels that are not held out."""
    return ToxicityModel.fit(docs, labels.filter(~held_out(3, 1)), docs)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per document; see ToxicityModel for odd rows.

    An empty table of documents gives no rows. Columns of docs and labels other than doc_id, text and toxic are ignored,
    whatever their names.
    """
    rows = trained(docs, labels).score(docs)
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, with all columns as they are.

    Each row is judged by its own text: repeated rows go or stay together, null and empty texts have the prior share of
    toxic labels as score, an empty table stays empty, and columns of any name are kept.
    """
    score = trained(docs, labels).score_column(docs.sparkSession)
    return docs.filter(score("text") < THRESHOLD)
