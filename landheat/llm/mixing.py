"""Mixing sources to target weights: blocks of words, drawn per output shard, joined by their index within a source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landheat.llm.common import running_total, slices, text_key, written

WEIGHTS = (5, 2, 1)
#: Words in a block, slots in an output shard, and how often a source may be passed over.
BLOCK_WORDS, SHARD_SLOTS, MOST_PASSES = 64, 1024, 3
SEED = 17
#: Shards whose running counts meet in one window.
SHARD_GROUP = 4096
#: Rows of draws that a task makes at once.
DRAWN_ROWS = 1 << 17
#: Slots that a task should make, and tasks at most.
TASK_SLOTS, MOST_TASKS = 65_536, 20_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, mark, size): key stands for the source without nulls, mark tells rows of one id apart."""
    return docs.select("doc_id", "source", text_key("source").alias("key"), F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """(key, source_size, target), one row per source.

    Sources by code point, null last, take the weights in turn. All words are shared by weight; a source gets at most
    `passes` times its own, and the excess goes to the others by weight until none is above. Sorted by own words per
    weight, the sources held to their limit come first, so one running sum over the sources finds the level of the rest.
    """
    own = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    # UTF-8 order is code point order; the key of null is the only one without "=" and must come last
    by_name = Window.orderBy(F.col("key") == "null", "key")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    own = own.withColumn("most", F.col("source_size").cast("double") * passes)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "key")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level", (F.sum("source_size").over(every) - before) / weight_left)
    held = F.col("most") <= F.col("level") * F.col("weight")
    # the first source not held to its limit sets the level of all that follow
    own = own.withColumn("level", F.first(F.when(~held, F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return own.select("key", "source_size", shared.alias("target"))


def quotas(shares: DataFrame, block_words: int, passes: int) -> DataFrame:
    """(key, blocks, quota): how many blocks a source has and how many slots it gets, within `passes` times its blocks."""
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.round(F.col("target") * blocks / F.col("source_size")).cast("long")
    return shares.filter("source_size > 0").select("key", blocks.cast("long").alias("blocks"), F.least(quota, blocks.cast("long") * passes).alias("quota"))


def _drawn(seed: int, shard: int, odds: np.ndarray, slots: int) -> np.ndarray:
    """How often a shard draws each source: a multinomial draw, slot by slot where sources outnumber slots."""
    rng = np.random.default_rng([seed, shard])
    if len(odds) <= slots:
        return rng.multinomial(slots, odds)
    return np.bincount(np.searchsorted(np.cumsum(odds)[:-1], rng.random(slots), side="right"), minlength=len(odds))


def _draws(batches: Iterator[pa.RecordBatch], keys: list[str], odds: list[float], slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(shard, key, drawn) of the sources that a shard draws at all, so at most a row per slot; a few shards at a time."""
    names, odds = pa.array(keys, pa.string()), np.array(odds)
    few = max(1, DRAWN_ROWS // max(1, min(slots, len(keys))))
    for batch in slices(batches, few):
        which, drawn, shard = [], [], []
        for s in batch.column(0).to_pylist():
            n = _drawn(seed, s, odds, slots)
            which.append(np.flatnonzero(n))
            drawn.append(n[which[-1]])
            shard.append(np.full(len(which[-1]), s))
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard), pa.int64()), names.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(drawn), pa.int64())], names=["shard", "key", "drawn"])


def shard_counts(spark, sources: list, slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, key, first, n): the multinomial draw of each output shard, with the running number of its first slot.

    A shard's draw depends on the seed and its number only. A draw past a source's quota is void, and what the draws
    leave of a quota goes to one last shard, so every source ends at its quota whatever the noise. sources holds one
    row per source; shards are as many as the quotas fill.
    """
    total = sum(r.quota for r in sources)
    shards = total // slots
    keys, odds = [r.key for r in sources], np.array([r.quota for r in sources], float)
    drawn = spark.range(shards).mapInArrow(partial(_draws, keys=keys, odds=(odds / max(1.0, odds.sum())).tolist(), slots=slots, seed=seed), "shard long, key string, drawn long")
    drawn = written(drawn, "draws")
    group = F.floor(F.col("shard") / SHARD_GROUP)
    drawn = drawn.withColumn("group", group)
    inside = Window.partitionBy("key", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = drawn.groupBy("key", "group").agg(F.sum("drawn").alias("n")).select("key", "group", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    drawn = drawn.withColumn("inside", F.coalesce(F.sum("drawn").over(inside), F.lit(0)))
    drawn = drawn.join(groups, ["key", "group"]).select("shard", "key", (F.col("before") + F.col("inside")).alias("first"), F.col("drawn").alias("n"))
    every = drawn.groupBy("key").agg(F.sum("n").alias("first"))
    own = spark.createDataFrame([(r.key, r.blocks, r.quota) for r in sources], "key string, blocks long, quota long")
    last = own.join(every, "key", "left").select(F.lit(shards).cast("long").alias("shard"), "key", F.coalesce("first", F.lit(0)).alias("first"), F.col("quota").alias("n"))
    found = drawn.unionByName(last).join(F.broadcast(own), "key")
    n = F.least(F.col("n"), F.col("quota") - F.col("first"))
    return found.withColumn("n", n).filter("n > 0").select("shard", "key", "blocks", "first", "n")


def permuted(index: Column, pass_: Column, key: Column, size: Column, seed: int = SEED, rounds: int = 8) -> Column:
    """A pseudorandom permutation of 0 .. size-1 for each source and pass.

    Each round reflects the index at a pivot (x -> pivot - x, modulo size), but only where a hash of the pair says so;
    both of a pair decide alike, so every round is its own inverse and the whole a permutation.
    """

    def swapped(x: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, pass_, F.lit(seed), k), size) - x, size)
        swap = F.pmod(F.xxhash64(key, pass_, F.greatest(x, other), F.lit(seed), k), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.array(*map(F.lit, range(rounds))), index, swapped)


def draws(counts: DataFrame, seed: int = SEED, slots: int = SHARD_SLOTS, tasks: int = 1) -> DataFrame:
    """(shard, slot, key, pass, block): the block that each slot of an output shard holds.

    Runs of slots are cut to at most `slots` and dealt over `tasks`, so no task makes them all, whatever the counts.
    """
    last = F.col("first") + F.col("n") - 1
    runs = counts.select("shard", "key", "blocks", F.explode(F.sequence(F.col("first"), last, F.lit(slots).cast("long"))).alias("from"), last.alias("last")).repartition(tasks, "key", "from")
    slots = runs.select("shard", "key", "blocks", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + slots - 1, F.col("last")))).alias("slot"))
    slots = slots.select("shard", "slot", "key", "blocks", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), (F.col("slot") % F.col("blocks")).alias("at"))
    return slots.select("shard", "slot", "key", "pass", permuted(F.col("at"), F.col("pass"), F.col("key"), F.col("blocks"), seed).alias("block"))


def fragments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds block, start, stop: the words of a document that lie in each block of its source."""
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("block") * block_words) - F.col("at")
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("at")
    return cut.withColumn("start", begin).withColumn("stop", end)


class Mix:
    """A mix of whole documents: block by block, reproducible from its seed whatever the partitions.

    Null, empty and blank texts have no words and are never taken; long texts are cut into blocks like any other; a null
    source is a source of its own; repeated rows are documents of their own, and rows that tie in id and text take the
    adjoining places in their source in no fixed order, which changes none of the sums; an empty table mixes to nothing;
    other columns are ignored, whatever their names. Only one row per source comes to the driver, and more than
    most_sources of them are refused before any window runs over them, so what is broadcast is bounded.
    """

    def __init__(self, docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, slots: int = SHARD_SLOTS, passes: int = MOST_PASSES, seed: int = SEED, most_sources: int = 100_000):
        spark = docs.sparkSession
        self.block_words, self.seed = block_words, seed
        sizes = written(sized(docs), "sizes")
        if sizes.select("key").distinct().limit(most_sources + 1).count() > most_sources:
            raise ValueError(f"over {most_sources} sources")
        self.shares = written(targets(sizes, weights, passes), "targets")
        #: One row per document: doc_id, source, key, mark, size, and where its words begin in its source.
        self.placed = written(running_total(sizes, ["key"], ["doc_id", "mark"], F.col("size"), "at"), "placed")
        sources = quotas(self.shares, block_words, passes).collect()
        tasks = min(MOST_TASKS, -(-sum(r.quota for r in sources) // TASK_SLOTS))
        self.draws = draws(shard_counts(spark, sources, slots, seed), seed, slots, max(1, tasks))

    def slots(self) -> DataFrame:
        """(shard, slot, source, block, pass, doc_id, start, stop): the mix itself, as word ranges of documents."""
        joined = fragments(self.placed, self.block_words).join(self.draws, ["key", "block"])
        return joined.select("shard", "slot", "source", "block", "pass", "doc_id", "start", "stop")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row per document."""
        times = self.draws.groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
        used = fragments(self.placed, self.block_words).join(times, ["key", "block"])
        used = used.groupBy("key", "at").agg(F.sum((F.col("stop") - F.col("start")) * F.col("times")).alias("taken"))
        used = used.withColumn("some", F.lit(True))
        rows = self.placed.withColumn("some", F.col("size") > 0).join(used, ["key", "at", "some"], "left").join(F.broadcast(self.shares), "key")
        return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mixed documents, with the columns of docs: a row per document and pass that took any of its words.

        Where all words were taken the text stays as it is; else it holds the runs of taken words, joined by a space.
        Rows without words do not appear; repeated rows pair off with their places in turn; n_chars, if there, follows the
        text; an empty table gives no rows; all other columns are kept as they are, whatever their names.
        """
        parts = fragments(self.placed, self.block_words).join(self.draws, ["key", "block"])
        spans = parts.groupBy("key", "at", "pass").agg(F.first("doc_id").alias("id"), F.first("mark").alias("mark"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        passes = spans.groupBy("key", "at").agg(F.first("id").alias("id"), F.first("mark").alias("mark"), F.collect_list(F.struct("pass", "size", "spans")).alias("passes"))
        same = ["row_id", "key", "mark"]
        turn = lambda order: F.row_number().over(Window.partitionBy(*same).orderBy(order))
        passes = passes.select(text_key("id").alias("row_id"), "key", "mark", "at", "passes").withColumn("turn", turn("at")).alias("p")
        doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # no column of theirs meets one of ours
        whole = docs.select(doc, text_key("doc_id").alias("row_id"), text_key("source").alias("key"), F.xxhash64("text").alias("mark"))
        whole = whole.withColumn("turn", turn("mark")).alias("d")
        # repeated rows pair off in turn; written as two bounds so that the join needs no further shuffle of the texts
        on = (F.col("d.row_id") == F.col("p.row_id")) & (F.col("d.key") == F.col("p.key")) & (F.col("d.mark") == F.col("p.mark")) & (F.col("d.turn") >= F.col("p.turn")) & (F.col("d.turn") <= F.col("p.turn"))
        rows = whole.join(passes, on).select("doc", F.explode("passes").alias("one"))
        full = (F.size("one.spans") > 0) & (F.aggregate("one.spans", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start) == F.col("one.size"))
        rows = rows.select("doc", F.when(~full, F.col("one.spans")).alias("spans"))
        text = F.col("doc")["text"]
        rows = rows.select("doc", F.when(F.col("spans").isNull(), text).otherwise(_taken_words(text, F.col("spans.start"), F.col("spans.stop"))).alias("text"))
        changed = {"text": F.col("text")}
        if "n_chars" in docs.columns:
            changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
        return rows.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


@F.pandas_udf(T.StringType())
def _taken_words(text: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else taken_words(t, list(zip(a, b))) for t, a, b in zip(text, start, stop)], dtype=object)


def taken_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words start .. stop-1 of each span; white space inside a run of words stays."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return " ".join(text[places[a][0] : places[b - 1][1]] for a, b in runs)
