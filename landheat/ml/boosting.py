"""Gradient-boosted regression trees over binned features: L1 and L2 terms, a default side for missing values.

Rows are binned once and stored in blocks of columns. Tasks add up the gradients of their rows per (node, feature, bin),
and the sums of all tasks pick the splits. Sums are of whole numbers, so the trees do not depend on how the rows are
partitioned. Where the rows fit tasks that can run at once, these grow many trees in one barrier stage: each adds up a
share of the features for all and tells the best splits. Else each level of a tree is one job, and the driver, which sees
no rows, picks the splits.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.sources.raster import file_system
from landheat.sources.shared import removed, table_path

#: Bins of a feature: 0 for missing values, then one more than there are edges.
BINS = 256
#: Rows of a block, and rounds after which the predictions so far are stored with the blocks.
BLOCK_ROWS, STORED_ROUNDS = 1 << 16, 10
#: Rounds of a barrier stage, and rows that one of its tasks keeps at most.
STAGE_ROUNDS, STAGE_ROWS = 100, 1 << 22
#: A barrier stage has a task for so many rows, up to MOST_TASKS: each reads a message of every other at each level.
TASK_ROWS, MOST_TASKS = 50_000, 16
#: Blocks that a task of a barrier stage is dealt, about, and seconds between its looks for a message, from and to.
DEALT_BLOCKS, LOOKS = 16, (0.0005, 0.02)
#: Tasks whose sums the driver adds up itself, as few as they are; those of more are added up in a shuffle.
FEW_TASKS = 4
#: Relative error of the quantiles that the edges are taken at.
ACCURACY = 10_000
#: A split has to gain more than this.
LEAST_GAIN = 1e-9

BLOCK_ARROW = [("n", pa.int32()), *((c, pa.binary()) for c in ("bins", "target", "so_far", "mark", "held"))]
BLOCK = "n int, bins binary, target binary, so_far binary, mark binary, held binary"
#: Blocks after a barrier stage, and one row with its trees and errors instead of a block.
GROWN = f"{BLOCK}, told string"
SUMS = "node int, feature int, bin int, gradient long, rows long"


@dataclass(frozen=True)
class BoostConfig:
    depth: int = 8
    rate: float = 0.05
    rounds: int = 500
    subsample: float = 0.8
    columns: float = 0.8
    least_rows: float = 5
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes in flat arrays; a leaf has feature -1, and an inner node's right child follows its left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    child: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, gain: float, left: float, right: float) -> int:
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node], self.child[node] = feature, bin_, missing_left, gain, len(self.feature)
        for value in (left, right):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.child, -1), (self.gain, 0.0), (self.value, value)):
                column.append(v)
        return self.child[node]

    def nodes(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The node that each row, a column of bins, ends in; from the root, or from the nodes of `start`."""
        feature, at, child, missing = (np.array(x) for x in (self.feature, self.bin, self.child, self.missing_left))
        node, rows = np.zeros(bins.shape[1], np.int64) if start is None else start.copy(), np.arange(bins.shape[1])
        while len(rows := rows[feature[node[rows]] >= 0]):
            own = node[rows]
            b = bins[feature[own], rows]
            left = np.where(b == 0, missing[own], b <= at[own])
            node[rows] = child[own] + ~left
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for NaN, else 1 more than the number of edges below the value."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, side="left") + 1).astype(np.uint8)


def sampled(mark: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Whether a round learns from a row: by a mix of the row's mark, the seed and the round."""
    if share >= 1:
        return np.ones(len(mark), bool)
    with np.errstate(over="ignore"):
        x = mark + np.uint64((seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * 2.0**53


def summed(bins: np.ndarray, columns: list[int], rows: np.ndarray, place: np.ndarray, whole: np.ndarray, n: int) -> np.ndarray:
    """(gradient and count, feature, place, bin) of the named rows, each with its place of n and its gradient."""
    out, base = np.empty((2, len(columns), n * BINS), np.int64), place * BINS
    for k, f in enumerate(columns):
        at = base + bins[f, rows]
        out[0, k] = np.bincount(at, weights=whole, minlength=n * BINS)
        out[1, k] = np.bincount(at, minlength=n * BINS)
    return out.reshape(2, len(columns), n, BINS)


class Block:
    """A stored block as arrays."""

    def __init__(self, row: dict, features: int):
        self.n = row["n"]
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(features, self.n)
        self.target, self.so_far = (np.frombuffer(row[c], "<f8") for c in ("target", "so_far"))
        self.mark, self.held = np.frombuffer(row["mark"], "<u8"), np.frombuffer(row["held"], np.bool_)

    @classmethod
    def joined(cls, blocks: list["Block"], features: int) -> "Block":
        """The rows of all blocks as one."""
        out = cls({"n": 0, "bins": b"", "target": b"", "so_far": b"", "mark": b"", "held": b""}, features)
        out.n = sum(b.n for b in blocks)
        for c in ("bins", "target", "so_far", "mark", "held"):
            setattr(out, c, np.concatenate([getattr(out, c), *(getattr(b, c) for b in blocks)], axis=-1))
        return out

    def after(self, trees: list[Tree]) -> np.ndarray:
        return sum((t.values(self.bins) for t in trees), self.so_far)

    def wrong(self, error: np.ndarray) -> np.ndarray:
        """Squared error of the rows held out, in whole numbers, and their number."""
        own = error[self.held]
        return np.array([np.rint(own * own * 65536.0).astype(np.int64).sum(), len(own)], np.int64)

    def learned(self, round_: int, cfg: BoostConfig) -> np.ndarray:
        return ~self.held & sampled(self.mark, cfg.seed, round_, cfg.subsample)


def _as_blocks(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], base: float, most: int) -> Iterator[pa.RecordBatch]:
    """Columns of features, then target, mark and held, in blocks; batches are gathered up to a block's rows, `most`."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        column = lambda k: t.column(k).to_numpy()  # noqa: E731  nulls become NaN
        bins = np.stack([binned(column(k).astype(float), e) for k, e in enumerate(edges)]) if edges else np.zeros((0, len(t)), np.uint8)
        target, mark, out = column(len(edges)).astype("<f8"), column(len(edges) + 1).astype("<i8"), column(len(edges) + 2).astype(np.bool_)
        row = {"n": len(t), "bins": bins.tobytes(), "target": target.tobytes(), "so_far": np.full(len(t), base).tobytes(), "mark": mark.tobytes(), "held": out.tobytes()}
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(BLOCK_ARROW))

    for batch in batches:
        k = 0
        while k < batch.num_rows:
            held.append(batch.slice(k, most - sum(b.num_rows for b in held)))
            k += held[-1].num_rows
            if sum(b.num_rows for b in held) >= most:
                yield made()
    if held:
        yield made()


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0], features)


def _stored(batches: Iterator[pa.RecordBatch], features: int, trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    """The blocks with the trees' values added to what was predicted so far."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            now = pa.array([Block(one.to_pylist()[0], features).after(trees).tobytes()], pa.binary())
            yield one.set_column(3, "so_far", now)


@dataclass
class Level:
    """What tasks need to add up one level: the trees not stored yet, the tree at hand and its open nodes."""

    trees: list[Tree]
    tree: Tree
    open: list[int]
    features: int
    columns: list[int]
    round: int
    bits: int
    cfg: BoostConfig


def places(tree: Tree, nodes: list[int]) -> np.ndarray:
    """Of each node of the tree its place among those named, else -1."""
    at = np.full(len(tree.feature), -1)
    at[nodes] = np.arange(len(nodes))
    return at


def _sums(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """SUMS of a task's rows over the open nodes; at the root also the squared error of the rows held out, as node -1."""
    n, at = len(level.open), places(level.tree, level.open)
    (gradient, rows), wrong = np.zeros((2, len(level.columns), n, BINS), np.int64), np.zeros(2, np.int64)
    for block in _blocks(batches, level.features):
        error = block.after(level.trees) - block.target
        if level.open == [0]:
            wrong += block.wrong(error)
        node = at[level.tree.nodes(block.bins)]
        used = np.flatnonzero((node >= 0) & block.learned(level.round, level.cfg))
        own = summed(block.bins, level.columns, used, node[used], np.rint(error[used] * 2.0**level.bits), n)
        gradient, rows = gradient + own[0], rows + own[1]
    k, place, bin_ = np.nonzero(rows)
    out = [place, np.array(level.columns, np.int64)[k], bin_, gradient[k, place, bin_], rows[k, place, bin_]]
    out = [np.append(c, v) for c, v in zip(out, (-1, 0, 0, *wrong))] if wrong[1] else out
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["node", "feature", "bin", "gradient", "rows"])


def shrunk(gradient: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0)


def gathered(level: Level, sums: dict[str, np.ndarray]) -> np.ndarray:
    """SUMS as (gradient and count, feature, open node, bin)."""
    whole = np.zeros((2, len(level.columns), len(level.open), BINS), np.int64)
    place = np.searchsorted(level.columns, sums["feature"]), sums["node"], sums["bin"]
    np.add.at(whole[0], place, sums["gradient"])
    np.add.at(whole[1], place, sums["rows"])
    return whole


def best_splits(sums: np.ndarray, cfg: BoostConfig, bits: int) -> np.ndarray:
    """The best split of each node by the sums (gradient and count, node, bin) of one feature.

    A row per node: gain, last bin that goes left, whether missing values do, gradient and rows on the left, and both of
    the node. Of splits that gain the same it is the first by bin, with missing values on the right before the left.
    """
    nodes, scale = sums.shape[1], 2.0**bits
    total_g, total_h = sums[0].sum(axis=1) / scale, sums[1].sum(axis=1).astype(float)
    out = np.zeros((nodes, 7))
    out[:, 0], out[:, 5], out[:, 6] = -np.inf, total_g, total_h
    if sums.shape[2] < 3:
        return out
    left, missing = sums[:, :, 1:-1].cumsum(axis=2), sums[:, :, :1]
    # without missing values both sides gain the same
    left = np.stack([left, left + missing], axis=3) if missing[1].any() else left[..., None]
    left_g, left_h = (x.reshape(nodes, -1) for x in (left[0] / scale, left[1].astype(float)))
    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
    score = lambda a, b: shrunk(a, cfg.l1) ** 2 / (b + cfg.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[:, None]
    gain = np.where((left_h >= cfg.least_rows) & (right_h >= cfg.least_rows), gain, -np.inf)
    best, at = gain.argmax(axis=1), np.arange(nodes)
    b, side = np.divmod(best, left.shape[3])
    for k, column in enumerate((gain[at, best], b + 1, side, left_g[at, best], left_h[at, best])):
        out[:, k] = column
    return out


def grown(level: Level, found: np.ndarray) -> list[int]:
    """Splits the open nodes of level.tree where that gains something, by the best splits (feature, node, ...); the children
    that are open then. Of features that gain the same the first is taken."""
    cfg, tree, opened = level.cfg, level.tree, []
    leaf = lambda g, n: float(-cfg.rate * shrunk(g, cfg.l1) / (n + cfg.l2))
    if level.open == [0]:
        tree.value[0] = leaf(*found[0, 0, 5:])
    best = found[:, :, 0].argmax(axis=0)
    for k, node in enumerate(level.open):
        gain, bin_, side, left_g, left_h, total_g, total_h = found[best[k], k]
        if gain > LEAST_GAIN:
            first = tree.split(node, level.columns[best[k]], int(bin_), bool(side), float(gain), leaf(left_g, left_h), leaf(total_g - left_g, total_h - left_h))
            opened += [first, first + 1]
    return opened


@dataclass
class Rounds:
    """What the tasks of a barrier stage go on from: the rounds it is for, the held rows' errors before them, bins by
    feature that can occur, rows of a block, and the folder of messages."""

    first: int
    last: int
    errors: list[float]
    bins: list[int]
    bits: int
    cfg: BoostConfig
    block: int
    folder: str


class Peers:
    """Messages between the tasks of a barrier stage, as files in the shared folder: each message by the stage itself, which
    looks for answers once a second, would take longer than a whole tree."""

    def __init__(self, folder: str):
        stage = BarrierTaskContext.get()
        self.own, self.n, self.step = stage.partitionId(), len(stage.getTaskInfos()), 0
        if self.n > 1:
            self.fs, path = file_system(folder)
            self.path = f"{path}/{stage.allGather(uuid.uuid4().hex)[0]}"  # a folder of this attempt, the same to all
            self.fs.create_dir(self.path)

    def _opened(self, name: str) -> pa.NativeFile:
        pause, most = LOOKS
        while True:  # where a task fails, Spark ends all tasks of the stage
            try:
                return self.fs.open_input_file(name)
            except FileNotFoundError:
                time.sleep(pause)
                pause = min(pause * 1.5, most)

    def told(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Tells each task its part; what each has told this one, in their order."""
        if self.n == 1:
            return parts
        self.step += 1
        name = lambda step, k: f"{self.path}/{step}-{k}"
        ends = np.cumsum([8 * (self.n + 1), *(p.nbytes for p in parts)])
        with self.fs.open_output_stream(name(self.step, f"{self.own}.new")) as f:
            for p in (ends, *parts):
                f.write(np.ascontiguousarray(p).data.cast("B") if p.size else b"")
        self.fs.move(name(self.step, f"{self.own}.new"), name(self.step, self.own))
        out = []
        for k, own in enumerate(parts):
            if k != self.own:
                with self._opened(name(self.step, k)) as f:
                    a, b = np.frombuffer(f.read_at(16, 8 * self.own), np.int64)
                    out.append(np.frombuffer(f.read_at(b - a, a), own.dtype))
            else:
                out.append(own.ravel())
        if self.step > 1:  # who has told this step has read the one before
            self.fs.delete_file(name(self.step - 1, self.own))
        return out

    def added(self, own: np.ndarray) -> np.ndarray:
        """Whole numbers of this task added to those of the others."""
        return sum(self.told([own] * self.n)).reshape(own.shape)


class Growing:
    """The rows of a barrier stage's task with their predictions so far, and in the tree at hand the rows learned from
    that are in open nodes: their number among the rows learned from, and their node's place."""

    def __init__(self, block: Block, rounds: Rounds, peers: Peers):
        self.block, self.r, self.peers, self.now = block, rounds, peers, block.so_far

    def sums(self, rows: np.ndarray, place: np.ndarray, n: int) -> list[np.ndarray]:
        """(gradient and count, place, bin) of the rows named, feature by feature; only bins that can occur."""
        out = [np.zeros((2, n, w), np.int64) for w in self.widths]
        for k in range(0, len(rows), self.exact):
            own, base = rows[k : k + self.exact], place[k : k + self.exact]
            whole = self.whole[own]
            for bins, w, sums in zip(self.bins, self.widths, out):
                at = base * w
                at += bins[own]
                sums[0] += np.bincount(at, weights=whole, minlength=n * w).reshape(n, w).astype(np.int64)
                sums[1] += np.bincount(at, minlength=n * w).reshape(n, w)
        return out

    def shared(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        """Of this task's share of the features the sums over all tasks."""
        n, own = self.peers.n, sums[self.peers.own :: self.peers.n]
        if n == 1:
            return own
        empty = np.zeros(0, np.int64)
        every = sum(self.peers.told([np.concatenate([empty, *(s.ravel() for s in sums[k::n])]) for k in range(n)]))
        cuts = np.cumsum([s.size for s in own])[:-1]
        return [part.reshape(s.shape) for part, s in zip(np.split(every, cuts), own)]

    def found(self, own: list[np.ndarray], nodes: int) -> np.ndarray:
        """The best splits (feature, node, ...) by all tasks' shares."""
        n, out = self.peers.n, np.empty((len(self.widths), nodes, 7))
        best = np.array([best_splits(s, self.r.cfg, self.r.bits) for s in own]).reshape(-1, nodes, 7)
        for k, told in enumerate(self.peers.told([best] * n)):
            out[k::n] = told.reshape(-1, nodes, 7)
        return out

    def tree(self, round_: int) -> Tree:
        cfg, block, features = self.r.cfg, self.block, len(self.r.bins)
        columns, tree = columns_of(round_, features, cfg), Tree()
        learned = block.learned(round_, cfg)
        used = np.flatnonzero(learned)
        self.widths, self.bins = [self.r.bins[c] for c in columns], np.stack([block.bins[c][used] for c in columns])
        self.whole = np.rint((self.now - block.target)[used] * 2.0**self.r.bits)
        # numpy adds up in doubles: all at once if no sum can reach 2 ** 53, else as many rows as can't
        self.exact = max(len(used), 1) if np.abs(self.whole).sum() < 2.0**52 else BLOCK_ROWS
        node, rows, place = np.zeros(len(used), np.int64), np.arange(len(used)), np.zeros(len(used), np.int64)
        opened, sums = [0], self.shared(self.sums(rows, place, 1))
        for depth in range(cfg.depth):
            level = Level([], tree, opened, features, columns, round_, self.r.bits, cfg)
            found = self.found(sums, len(opened))
            opened = grown(level, found)
            if not opened:
                break
            inner = np.flatnonzero(np.array(tree.feature)[level.open] >= 0)
            best = found[found[:, inner, 0].argmax(axis=0), inner]
            rows, place = self.stepped(tree, level, inner, rows, place)
            node[rows] = np.array(opened)[place]
            if depth + 1 == cfg.depth:
                break
            # the lesser child of each node is added up, the other has the rest
            lesser = (2 * best[:, 4] > best[:, 6]).astype(np.int64)
            own = place % 2 == lesser[place // 2]
            least = self.shared(self.sums(rows[own], place[own] // 2, len(inner)))
            at, above, sums = np.arange(len(inner)) * 2, sums, []
            for a, b in zip(above, least):
                sums.append(np.empty((2, len(opened), a.shape[2]), np.int64))
                sums[-1][:, at + lesser], sums[-1][:, at + 1 - lesser] = b, a[:, inner] - b
        value, others = np.array(tree.value), np.flatnonzero(~learned)
        now = self.now.copy()
        now[used] += value[node]
        now[others] += value[tree.nodes(block.bins[:, others])]
        self.now = now
        return tree

    def stepped(self, tree: Tree, level: Level, inner: np.ndarray, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows in those open nodes that were split, and their places among the children."""
        pair = np.full(len(level.open), -1)
        pair[inner] = np.arange(len(inner))
        pair = pair[place]
        if len(inner) < len(level.open):
            goes = np.flatnonzero(pair >= 0)
            rows, pair = rows[goes], pair[goes]
        feature, at, missing = (np.array(x)[level.open][inner] for x in (tree.feature, tree.bin, tree.missing_left))
        first = np.searchsorted(level.columns, feature) * self.bins.shape[1]
        b = self.bins.ravel()[first[pair] + rows]
        left = b <= at[pair]
        gap = np.flatnonzero(b == 0)
        left[gap] = missing[pair[gap]]
        return rows, 2 * pair + ~left


def _together(batches: Iterator[pa.RecordBatch], rounds: Rounds) -> Iterator[pa.RecordBatch]:
    """GROWN after the rounds: all tasks of the stage grow the same trees, each from its own rows and the sums of all."""
    features = len(rounds.bins)
    block, peers = Block.joined(list(_blocks(batches, features)), features), Peers(rounds.folder)
    task = Growing(block, rounds, peers)
    trees, errors, ended = [], list(rounds.errors), False
    for round_ in range(rounds.first, rounds.last):
        wrong, held = peers.added(block.wrong(task.now - block.target))
        if round_ and held:
            errors.append(float(wrong / held / 65536))
        ended = round_ == rounds.cfg.rounds or stopped(errors, rounds.cfg.patience)
        if ended:
            break
        trees.append(task.tree(round_))
    schema = pa.schema([*BLOCK_ARROW, ("told", pa.string())])
    for k in range(0, block.n, rounds.block):
        part = slice(k, k + rounds.block)
        row = {"so_far": task.now[part].tobytes()} | {c: getattr(block, c)[..., part].tobytes() for c in ("bins", "target", "mark", "held")}
        yield pa.RecordBatch.from_pylist([row | {"n": min(rounds.block, block.n - k)}], schema=schema)
    if peers.own == 0:
        yield pa.RecordBatch.from_pylist([{"told": json.dumps({"trees": [asdict(t) for t in trees], "errors": errors, "ended": ended})}], schema=schema)


@dataclass
class BoostedTrees:
    """A fitted model: feature names and edges, the first prediction, the trees, and the error of held rows by round."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    errors: list[float]

    def column(self, inputs: dict[str, Column]) -> Column:
        """The prediction from columns of numbers; nulls and NaN are missing."""
        sent = (self.edges, self.base, self.trees)

        @F.pandas_udf("double")
        def scored(rows: pd.DataFrame) -> pd.Series:
            edges, base, trees = sent
            bins = np.stack([binned(rows.iloc[:, k].to_numpy(float, na_value=np.nan), e) for k, e in enumerate(edges)])
            return pd.Series(sum((t.values(bins) for t in trees), np.full(len(rows), base)))

        return scored(F.struct(*(inputs[f].cast("double").alias(f"f{k}") for k, f in enumerate(self.features))))

    def gains(self) -> np.ndarray:
        """Each feature's share of all that the splits gained."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = np.array(t.feature) >= 0
            np.add.at(total, np.array(t.feature)[inner], np.array(t.gain)[inner])
        return total / total.sum() if total.sum() else total

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "base": self.base, "trees": [asdict(t) for t in self.trees], "errors": self.errors})

    @classmethod
    def from_json(cls, text: str) -> "BoostedTrees":
        d = json.loads(text)
        return cls(d["features"], [np.array(e, float) for e in d["edges"]], d["base"], [Tree(**t) for t in d["trees"]], d["errors"])


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each feature, bins - 2 at most; one pass of mergeable sketches."""
    shares = F.array(*(F.lit(k / (bins - 2)) for k in range(bins - 2)))
    found = rows.agg(*(F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, ACCURACY).alias(f"e{k}") for k, f in enumerate(features))).first()
    return [np.unique(np.array(found[k] or [], float)) for k in range(len(features))]


def stopped(errors: list[float], patience: int) -> bool:
    """Whether the error has not fallen for that many rounds."""
    return bool(errors) and len(errors) - 1 - int(np.argmin(errors)) >= patience


def columns_of(round_: int, features: int, cfg: BoostConfig) -> list[int]:
    """The features that a round takes."""
    rng = np.random.default_rng([cfg.seed, round_])
    return sorted(rng.choice(features, max(1, round(cfg.columns * features)), replace=False).tolist())


def stage_tasks(spark: SparkSession, n: int) -> int:
    """Tasks of a barrier stage over n rows; 0 where they can't all run at once or would keep too many rows."""
    setting = lambda name, other: spark.sparkContext.getConf().get(name, other)
    # a default of partitions that was set tells nothing about how many tasks can run at once
    slots = 1 if setting("spark.default.parallelism", "") else spark.sparkContext.defaultParallelism // int(setting("spark.task.cpus", "1"))
    try:
        file_system(table_path(spark, "messages"))
    except (pa.ArrowException, ValueError, OSError):  # not a store that tasks can write messages to
        slots = min(slots, 1)
    tasks = max(-(-n // STAGE_ROWS), min(-(-n // TASK_ROWS), MOST_TASKS, slots), 1)
    return tasks if tasks <= slots and setting("spark.dynamicAllocation.enabled", "false") != "true" else 0


def fit(rows: DataFrame, features: list[str], target: str, cfg: BoostConfig = BoostConfig(), held: Column | None = None) -> BoostedTrees:
    """Boosts squared error over the rows with a target, in one pass of rounds.

    Rows for which `held` is true are not learned from; the rounds end where their error has not fallen for
    cfg.patience rounds. Each round takes cfg.subsample of the rows, by a hash of their values, and cfg.columns of the
    features. A task of a barrier stage, else the driver, holds sums per open node, feature and bin: 2 ** (depth - 1) *
    features * 256 of them at most (and of FEW_TASKS tasks on the driver, where there are no more).
    Predictions are stored with the rows every STAGE_ROUNDS or STORED_ROUNDS rounds, in the shared folder, so a lost
    executor costs at most that many trees' work; the table before goes.
    """
    spark = rows.sparkSession
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    known = rows.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    known = known.select(*(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)), F.col(target).cast("double").alias("target"), held.alias("held"))
    names = [f"f{k}" for k in range(len(features))]
    known = known.select(*names, "target", F.xxhash64(*names, "target").alias("mark"), "held")
    source = table_path(spark, "training-rows")
    known.write.parquet(source)
    known = spark.read.schema(known.schema).parquet(source)

    learned = known.filter(~F.col("held"))
    edges = edges_of(learned, names)
    n, mean, low, high = learned.agg(F.count(F.lit(1)), F.avg("target"), F.min("target"), F.max("target")).first()
    if not n:
        return BoostedTrees(features, edges, 0.0, [], [])
    base = round(mean, 6)
    reach = 2 * max(high - base, base - low, 1e-6)
    # sums over all rows stay below 2 ** 62, those over a block, which numpy makes in doubles, below 2 ** 53
    bits = min(62 - math.ceil(math.log2(n + 1)), 36 - 1) - math.ceil(math.log2(reach))

    path = table_path(spark, "blocks")
    tasks = stage_tasks(spark, n)
    most = min(BLOCK_ROWS, n // (tasks * DEALT_BLOCKS) + 1) if tasks else BLOCK_ROWS
    (known.coalesce(tasks) if tasks else known).mapInArrow(partial(_as_blocks, edges=edges, base=base, most=most), BLOCK).write.parquet(path)
    removed(spark, source)
    model = BoostedTrees(features, edges, base, [], [])
    return _grown_in_stages(spark, path, model, bits, cfg, tasks, most) if tasks else _grown_by_level(spark, path, model, bits, cfg)


def _grown_in_stages(spark: SparkSession, path: str, model: BoostedTrees, bits: int, cfg: BoostConfig, tasks: int, most: int) -> BoostedTrees:
    """STAGE_ROUNDS rounds a job: a barrier stage whose tasks keep their rows and tell each other their sums."""
    for first in range(0, cfg.rounds + 1, STAGE_ROUNDS):
        folder = table_path(spark, "messages")
        rounds = Rounds(first, min(first + STAGE_ROUNDS, cfg.rounds + 1), model.errors, [len(e) + 2 for e in model.edges], bits, cfg, most, folder)
        blocks = spark.read.schema(GROWN).parquet(path).filter("n is not null").drop("told")
        old, path = path, table_path(spark, "blocks")
        blocks.repartition(tasks).mapInArrow(partial(_together, rounds=rounds), GROWN, barrier=True).write.parquet(path)
        removed(spark, old)
        removed(spark, folder)
        told = json.loads(spark.read.schema(GROWN).parquet(path).filter("told is not null").select("told").first().told)
        model.trees += [Tree(**t) for t in told["trees"]]
        model.errors = told["errors"]
        if told["ended"]:
            break
    removed(spark, path)
    return model


def _grown_by_level(spark: SparkSession, path: str, model: BoostedTrees, bits: int, cfg: BoostConfig) -> BoostedTrees:
    """A job per level; predictions are stored every STORED_ROUNDS rounds."""
    features, fresh = len(model.features), []
    blocks = spark.read.schema(BLOCK).parquet(path)
    few = blocks.rdd.getNumPartitions() <= FEW_TASKS
    for round_ in range(cfg.rounds + 1):
        columns, tree, opened = columns_of(round_, features, cfg), Tree(), [0]
        for _ in range(cfg.depth):
            level = Level(fresh, tree, opened, features, columns, round_, bits, cfg)
            sums = blocks.mapInArrow(partial(_sums, level=level), SUMS)
            if not few:
                sums = sums.groupBy("node", "feature", "bin").agg(F.sum("gradient").alias("gradient"), F.sum("rows").alias("rows"))
            found = sums.toArrow()
            every = {c: found.column(c).to_numpy() for c in found.column_names}
            if opened == [0]:
                told = every["node"] < 0
                if round_ and told.any():
                    model.errors.append(float(every["gradient"][told].sum() / every["rows"][told].sum() / 65536))
                if round_ == cfg.rounds or stopped(model.errors, cfg.patience):
                    removed(spark, path)
                    return model
                every = {c: v[~told] for c, v in every.items()}
            whole = gathered(level, every)
            opened = grown(level, np.array([best_splits(whole[:, k, :, : len(model.edges[c]) + 2], cfg, bits) for k, c in enumerate(columns)]))
            if not opened:
                break
        model.trees.append(tree)
        fresh = [*fresh, tree]
        if len(fresh) == STORED_ROUNDS:
            old, path = path, table_path(spark, "blocks")
            blocks.mapInArrow(partial(_stored, features=features, trees=fresh), BLOCK).write.parquet(path)
            blocks = spark.read.schema(BLOCK).parquet(path)
            removed(spark, old)
            fresh = []
    return model
