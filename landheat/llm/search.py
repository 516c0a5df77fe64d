"""Ranked lexical search: every item of a query table against all documents, over an index by length strata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landheat.llm.common import sized_slices, written

TOP = 10
#: UTF-8 bytes of the items that one pass over the documents answers; what goes to all tasks is bounded by it.
BLOCK_BYTES = 1 << 24
#: Postings that a task indexes at once, and about how many a partition is given.
POSTINGS, PART_POSTINGS = 1 << 22, 1 << 21
#: Documents of the first strata that a query visits; each next visit takes twice as many.
FIRST_VISIT = 64

#: What each byte of a text counts as in a term: A-Z in lower case, other letters, digits and non-ASCII bytes
#: themselves, all else a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms with repeats, as UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _profiles(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, ids, tfs): number of terms of each document, and those of the vocabulary with their counts."""
    known = vocabulary.value
    for batch in sized_slices(batches, 1, 1 << 21):
        n, ids, tfs = [], [], []
        for text in batch.column(1).to_pylist():
            words = terms(text)
            found = [(known[w], k) for w, k in Counter(words).items() if w in known]
            n.append(len(words))
            ids.append([i for i, _ in found])
            tfs.append([k for _, k in found])
        arrays = (pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n", "ids", "tfs"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class StratifiedIndex:
    """Postings of some documents, by term, then stratum (documents of one m), then tf.

    A run is the postings of one term, stratum and tf; all have one impact, computed once. Runs of a term and stratum
    ascend in tf, and with it in impact, so the last one bounds the term's part of any score in the stratum.
    """

    def __init__(self, doc_ids: np.ndarray, unnamed: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.doc_ids, self.unnamed = doc_ids, unnamed
        norms, stratum = np.unique(m, return_inverse=True)
        self.strata, self.docs_in = len(norms), np.bincount(stratum, minlength=len(norms))
        order = np.lexsort((tf, stratum[doc], term))
        self.doc, term, of, tf = doc[order], term[order], stratum[doc][order], tf[order]
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1]) | (tf[1:] != tf[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(self.start, append=len(order))
        self.of, self.impact = of[self.start], impact(tf[self.start], norms[of[self.start]])
        run_term = term[self.start]
        self.last = np.ones(len(self.start), bool)
        self.last[:-1] = (run_term[1:] != run_term[:-1]) | (self.of[1:] != self.of[:-1])
        self.terms, first = np.unique(run_term, return_index=True)
        self.first = np.append(first, len(run_term))

    def runs(self, query: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of a query's terms, and each one's part of a score."""
        at = np.searchsorted(self.terms, query)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == query[held]
        first, size = self.first[at[held]], self.first[at[held] + 1] - self.first[at[held]]
        runs = ranges(first, size)
        return runs, np.repeat(weights[held], size) * self.impact[runs]

    def best(self, query: np.ndarray, weights: np.ndarray, best: "Best") -> None:
        """Puts into `best` what this index has for a query: strata in falling order of their bounds, until none can tell."""
        runs, parts = self.runs(query, weights)
        if not len(runs):
            return
        of, last = self.of[runs], self.last[runs]
        bound = np.zeros(self.strata, np.int64)
        np.add.at(bound, of[last], parts[last])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        upto, scores, visit = np.cumsum(self.docs_in[order]), np.zeros(len(self.doc_ids), np.int64), FIRST_VISIT
        at = 0
        while at < len(order) and bound[order[at]] >= best.least:
            before = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + visit, side="right")))
            stop = at + int(np.searchsorted(-bound[order[at:stop]], -best.least, side="right"))
            chosen = np.zeros(self.strata, bool)
            chosen[order[at:stop]] = True
            mine = chosen[of]
            size = self.size[runs[mine]]
            docs = self.doc[ranges(self.start[runs[mine]], size)]
            np.add.at(scores, docs, np.repeat(parts[mine], size))
            found = np.unique(docs)
            found = found[scores[found] >= best.least]
            best.take(scores[found], self.doc_ids[found], self.unnamed[found])
            at, visit = stop, 2 * visit


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first to first + size of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Best:
    """The `top` highest scores so far, equal ones by id, rows without an id last; `least` is what a new one has to reach."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.unnamed = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.unnamed, unnamed)
        order = np.lexsort((ids, unnamed, -scores))[: self.top]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]
        if len(order) == self.top:
            self.least = max(1, int(self.scores[-1]))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _search(batches: Iterator[pa.RecordBatch], queries, top: int) -> Iterator[pa.RecordBatch]:
    """The best of a task's documents for each query: (item, doc_id, score)."""
    asked = queries.value
    best = [Best(top) for _ in asked]
    held: list[tuple[np.ndarray, ...]] = []

    def visit() -> None:
        sizes = np.cumsum([0, *(len(h[0]) for h in held)])
        doc = np.concatenate([h[3] + s for h, s in zip(held, sizes)])
        ids, unnamed, m, _, term, tf = (np.concatenate(c) for c in zip(*held))
        index = StratifiedIndex(ids, unnamed, m, doc, term, tf)
        for (_, query, weights), b in zip(asked, best):
            index.best(query, weights, b)
        held.clear()

    for batch in batches:
        doc_ids, m, ids, tfs = batch.columns
        unnamed = doc_ids.is_null().to_numpy(zero_copy_only=False)
        parents = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
        held.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), unnamed, m.to_numpy(), parents, _flat(ids), _flat(tfs)))
        if sum(len(h[3]) for h in held) > POSTINGS:
            visit()
    if held:
        visit()
    for (item, _, _), b in zip(asked, best):
        if len(b.ids):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.ids), pa.int32()), pa.array(b.ids, mask=b.unnamed), pa.array(b.scores)], names=["item", "doc_id", "score"])


def _block(docs: DataFrame, items: list[tuple], id_kind: str, top: int) -> DataFrame:
    """The answers to one block of items: one pass that profiles the documents, one over the index."""
    spark: SparkSession = docs.sparkSession
    asked = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(rows.mapInArrow(partial(_profiles, vocabulary=sent), "doc_id long, n long, ids array<int>, tfs array<long>"), "profiles")
    n_docs, length, postings = profiles.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("ids"))).first()
    held = profiles.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
    weights = {r["id"]: weight(n_docs, r["count"]) for r in held}
    queries = []
    for item, counts in enumerate(asked):
        own = sorted((vocabulary[t], k) for t, k in counts.items() if weights.get(vocabulary[t]))
        if own:
            queries.append((item, np.array([i for i, _ in own]), np.array([weights[i] * k for i, k in own])))

    m = F.expr(f"25 + (75 * n * {n_docs}L) div {length or 1}L").alias("m")
    parts = max(1, -(-(postings or 0) // PART_POSTINGS))
    index = profiles.filter(F.size("ids") > 0).select("doc_id", m, "ids", "tfs").repartitionByRange(parts, "m", F.xxhash64("doc_id", "ids", "tfs"))
    found = index.mapInArrow(partial(_search, queries=spark.sparkContext.broadcast(queries), top=top), "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item int, item_id {id_kind}")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item by score, those with equal scores by doc_id.

    Items are answered in blocks of about block_bytes of text, each by a pass over all documents: the block's terms,
    weights and item ids are what goes to the driver and to all tasks. Documents are dealt by ranges of their
    normaliser m, a frequent one over several tasks; a task indexes them by strata of equal m and visits these in
    falling order of what they can score, until they can't reach the best so far. All documents are indexed and the
    result is exact.

    Null and empty texts have no terms and neither count nor rank; an item without terms, or none of whose terms is
    in a document, has no rows. Repeated documents rank each by itself, and those without an id last among equal
    scores; items that share an id, or have none, are answered each by itself. A very long text is a profile of its
    distinct terms; an item longer than block_bytes is a block of its own. Empty tables give no rows; other columns
    are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    id_kind = dict(items.dtypes)["item_id"]
    asked = items.select("item_id", "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = spark.createDataFrame([], f"item_id {id_kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r.item_id, r.text) for r in mine.filter(F.col("text").isNotNull()).collect()]
        if rows:
            own = _block(docs, rows, id_kind, top)
            out = own if blocks == 1 else out.unionByName(own)
    return out
