"""Quality rules: statistics of whole texts, fixed base rules, and boosted trees with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.llm.common import slices

#: Labelled documents that a model is fitted on, at most.
TRAIN_DOCS = 6000
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
WINDOW = 8

#: Features of the trees, and where a larger value may only lower (-1) or only raise (1) the score.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "end_mark_share": 0,
    "punctuation_share": 0,
    "top_word_share": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found at least twice in the text.

    Windows are told apart exactly: words are numbered, then pairs of neighbouring numbers, pairs of those, and so on.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    if len(place) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = ids[: len(ids) - step], ids[step:]
        ids = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        width += step
    twice = np.bincount(ids)[ids] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of the trees."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    raw = np.frombuffer(text.encode(), np.uint8)
    upper, digits = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 48) & (raw <= 57)).sum())
    marks = sum(map(text.count, ".,;:!?"))
    ends = sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines)
    return base, [
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, upper / chars, digits / chars,
        len(seen) / n, n / len(lines), ends / len(lines), marks / n, max(seen.values()) / n,
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array([f for _, f in found], pa.list_(pa.float64()))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of every whole text.

    Null texts count as empty; repeated rows and null ids keep their rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")


@dataclass
class BoostedTrees:
    """Trees as flat node arrays: feature (-1 in leaves), threshold, left child, value; a right child follows its left."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)
    roots: list = field(default_factory=list)
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x: all rows go down a tree together, one level at a time."""
        feature, threshold, left, value = (np.array(a) for a in (self.feature, self.threshold, self.left, self.value))
        total, every = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                node[inner] = left[at] + (x[every[inner], feature[at]] > threshold[at])
            total += value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 8, l2: float = 1.0) -> "BoostedTrees":
        """Newton boosting of the log-loss on binned features.

        A split on a feature with a sign is only taken if its sides' values keep that order, and the values below it
        stay on their side of the middle, so the whole score is monotonic in that feature.
        """
        model = cls()
        p = (y.sum() + 1) / (len(y) + 2)
        model.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), model.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            model.roots.append(len(model.feature))
            model._add(1)
            todo = [(model.roots[-1], np.arange(len(y)), depth, -np.inf, np.inf)]
            while todo:
                node, rows, levels, low, high = todo.pop()
                best = cls._split(binned, grad, hess, rows, edges, signs, low, high, least, l2) if levels and len(rows) >= 2 * least else None
                if best is None:
                    own = np.clip(-grad[rows].sum() / (hess[rows].sum() + l2), low, high) * rate
                    model.value[node] = float(own)
                    margin[rows] += own
                    continue
                j, cut, a, b = best
                model.feature[node], model.threshold[node], model.left[node] = j, float(edges[j][cut]), len(model.feature)
                model._add(2)
                middle = (a + b) / 2
                down = binned[rows, j] <= cut
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
                todo += [(model.left[node], rows[down], levels - 1, *bounds[0]), (model.left[node] + 1, rows[~down], levels - 1, *bounds[1])]
        return model

    def _add(self, n: int) -> None:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.value, 0.0)):
            a.extend([v] * n)

    @staticmethod
    def _split(binned, grad, hess, rows, edges, signs, low, high, least, l2):
        g, h = grad[rows], hess[rows]
        all_g, all_h = g.sum(), h.sum()
        found, most = None, all_g**2 / (all_h + l2) + 1e-6
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl, hl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h))
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gr, hr = all_g - gl, all_h - hl
            left, right = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
            ok = (nl >= least) & (len(rows) - nl >= least) & ((right - left) * signs[j] >= 0)
            gain = np.where(ok, gain, -np.inf)
            cut = int(np.argmax(gain))
            if gain[cut] > most:
                most, found = gain[cut], (j, cut, float(left[cut]), float(right[cut]))
        return found


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> BoostedTrees:
    """Trees learned from a bounded sample of the labels: the train_docs ids that come first by a hash.

    Null ids and labels are left out; where an id has several labels the lowest holds, and of its rows the text with the
    least hash. Only the sample's features, train_docs rows at most, come to the driver. Without labels the score is
    0.5 everywhere, which keeps all.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(train_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = measured(texts)
    rows = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "features").orderBy("doc_id", "features").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return BoostedTrees.fit(x, (rows["quality"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def good_column(spark: SparkSession, model: BoostedTrees):
    """A function of the features column: the probability that the labels call such a text good."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(features: pd.Series) -> pd.Series:
        return pd.Series(sent.value.probability(np.stack(features.to_list()) if len(features) else np.zeros((0, len(FEATURES)))))

    return good


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The base counts, base_failed, kept and the trees' score; one row per document.

    Null and empty texts have counts of 0 and fail; texts of any length are read whole; a score that ties with the
    threshold keeps; repeated rows and null ids keep their rows; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    model = fitted(docs, labels)
    rows = measured(docs).withColumn("score", good_column(docs.sparkSession, model)("features"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
