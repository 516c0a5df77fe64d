"""Boosted trees against a plain version that splits rows, one node after another."""

import pathlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from landheat.ml import boosting
from landheat.sources.shared import written_folder


def made(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    x[:, 1] = rng.integers(0, 5, n)
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = np.nan if seed == 9 else x[:, 3]
    y = (300 + 3 * np.nan_to_num(x[:, 0], nan=2.0) - 2 * np.nan_to_num(x[:, 1], nan=-3) + np.sin(3 * np.nan_to_num(x[:, 2])) + rng.normal(0, 0.1, n)).round(4)
    return x, y


def table(spark, x, y, held=None):
    rows = [(*(None if np.isnan(v) and k % 2 else float(v) for v in r), float(t), bool(h)) for k, (r, t, h) in enumerate(zip(x, y, np.zeros(len(y), bool) if held is None else held))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, held boolean")


def plain_trees(x, y, edges, base, cfg, columns_of, keep_of):
    """Predictions of all rows, by splitting lists of rows recursively; sums in plain doubles."""
    pred = np.full(len(y), base)
    shrink = lambda g: np.sign(g) * max(abs(g) - cfg.l1, 0)
    score = lambda g, n: shrink(g) ** 2 / (n + cfg.l2)
    for round_ in range(cfg.rounds):
        grad, keep, out = pred - y, keep_of(round_), np.zeros(len(y))

        def grow(own, every, depth):
            g, n = grad[own].sum(), len(own)
            best = (boosting.LEAST_GAIN, None)
            for f in columns_of(round_) if depth < cfg.depth else ():
                miss = np.isnan(x[own, f])
                for e in edges[f]:
                    for side in (False, True):
                        left = np.where(miss, side, x[own, f] <= e)
                        a, b = left.sum(), (~left).sum()
                        if min(a, b) >= cfg.least_rows:
                            gain = score(grad[own][left].sum(), a) + score(grad[own][~left].sum(), b) - score(g, n)
                            if gain > best[0] * (1 + 1e-12) and gain > best[0] + 1e-9 * abs(best[0]):
                                best = (gain, (f, e, side))
            if best[1] is None:
                out[every] = -cfg.rate * shrink(g) / (n + cfg.l2)
                return
            f, e, side = best[1]
            to_left = lambda rows: np.where(np.isnan(x[rows, f]), side, x[rows, f] <= e).astype(bool)
            a, b = to_left(own), to_left(every)
            grow(own[a], every[b], depth + 1)
            grow(own[~a], every[~b], depth + 1)

        grow(np.flatnonzero(keep), np.arange(len(y)), 0)
        pred += out
    return pred


@pytest.mark.parametrize("seed,l1,l2", [(1, 0.1, 1.0), (9, 20.0, 0.0)])
def test_scores_match_a_plain_version(spark, seed, l1, l2):
    x, y = made(600, seed)
    cfg = boosting.BoostConfig(depth=3, rate=0.3, rounds=12, subsample=1.0, columns=0.75, least_rows=5, l1=l1, l2=l2)
    df = table(spark, x, y)
    model = boosting.fit(df, ["a", "b", "c", "d"], "y", cfg)
    assert len(model.trees) == 12 and model.errors == []
    columns = lambda r: sorted(np.random.default_rng([cfg.seed, r]).choice(4, 3, replace=False).tolist())
    want = plain_trees(x, y, model.edges, model.base, cfg, columns, lambda r: np.ones(len(y), bool))
    rows = df.withColumn("pred", model.column({c: F.col(c) for c in "abcd"})).collect()
    assert np.allclose([r.pred for r in rows], want, atol=1e-6)


def test_trees_do_not_depend_on_partitions(spark):
    x, y = made()
    held = np.arange(len(y)) % 5 == 0
    cfg = boosting.BoostConfig(depth=4, rate=0.3, rounds=12, patience=50)
    df = table(spark, x, y, held)
    models = [boosting.fit(rows, ["a", "b", "c", "d"], "y", cfg, F.col("held")) for rows in (df.coalesce(1), df.repartition(7))]
    assert models[0].to_json() == models[1].to_json()
    again = boosting.BoostedTrees.from_json(models[0].to_json())
    assert again.to_json() == models[0].to_json()
    errors = models[0].errors
    assert len(errors) == 12 and errors[-1] < 0.2 * errors[0]
    scored = df.filter("held").withColumn("pred", again.column({c: F.col(c) for c in "abcd"})).agg(F.avg((F.col("pred") - F.col("y")) ** 2)).first()[0]
    assert scored == pytest.approx(errors[-1], abs=1e-4)
    gains = models[0].gains()
    assert gains.sum() == pytest.approx(1) and gains[:2].sum() > 0.8


def test_rounds_end_without_gain(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 4)), rng.normal(size=400)
    cfg = boosting.BoostConfig(depth=3, rate=0.9, rounds=60, patience=3)
    model = boosting.fit(table(spark, x, y, np.arange(400) % 2 == 0), ["a", "b", "c", "d"], "y", cfg, F.col("held"))
    best = int(np.argmin(model.errors))
    assert len(model.trees) == len(model.errors) == best + 4 < 60
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(written_folder(spark))
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    assert not [n for n in names if n.startswith(("blocks", "training-rows"))]


def test_odd_tables(spark):
    df = table(spark, *made(50))
    cfg = boosting.BoostConfig(depth=2, rounds=2)
    assert boosting.fit(df.limit(0), ["a", "b"], "y", cfg).trees == []
    alike = boosting.fit(df.withColumn("y", F.lit(5.0)), ["a", "b"], "y", cfg)
    assert df.limit(1).select(alike.column({c: F.col(c) for c in "ab"})).first()[0] == 5.0
    only_null = boosting.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", cfg)
    assert all(t.feature == [-1] for t in only_null.trees)
    one = boosting.fit(df.withColumn("y", F.when(F.col("a") > 0, F.lit(None)).otherwise(F.col("y"))), ["a", "b", "c", "d"], "y", cfg)
    assert len(one.trees) == 2


def test_samples_are_shares():
    mark = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for share in (0.1, 0.8, 1.0):
        assert abs(boosting.sampled(mark, 42, 3, share).mean() - share) < 0.02
    assert (boosting.sampled(mark, 42, 3, 0.5) != boosting.sampled(mark, 42, 4, 0.5)).any()


def test_stages_grow_the_trees_of_levels(spark, monkeypatch):
    x, y = made(4000)
    held = np.arange(len(y)) % 5 == 0
    cfg = boosting.BoostConfig(depth=5, rate=0.3, rounds=8, patience=50)
    df = table(spark, x, y, held).repartition(5)
    monkeypatch.setattr(boosting, "STAGE_ROUNDS", 3)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    told = []
    for tasks in (0, 1, 3):
        monkeypatch.setattr(boosting, "stage_tasks", lambda *_, tasks=tasks: tasks)
        told.append(boosting.fit(df, ["a", "b", "c", "d"], "y", cfg, F.col("held")).to_json())
    assert told[0] == told[1] == told[2]


def test_training_takes_a_job_for_many_rounds(spark):
    group = "training-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        boosting.fit(table(spark, *made(500)), ["a", "b"], "y", boosting.BoostConfig(depth=4, rounds=40))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40


def test_stages_have_few_tasks(spark):
    slots = spark.sparkContext.defaultParallelism
    assert boosting.stage_tasks(spark, 1) == 1
    assert boosting.stage_tasks(spark, slots * boosting.STAGE_ROWS) <= slots
    assert boosting.stage_tasks(spark, (slots + 1) * boosting.STAGE_ROWS) == 0


def test_many_rows_are_dealt_over_a_stage(spark):
    slots = spark.sparkContext.defaultParallelism
    assert [boosting.stage_tasks(spark, n) for n in (200_000, 1_600_000, 16_000_000)] == [4, slots, slots]


def test_tasks_of_a_stage_tell_each_other_soon(spark, monkeypatch):
    """Ten trees in three tasks, against a second a level where messages wait for the stage; no message is left."""
    monkeypatch.setattr(boosting, "stage_tasks", lambda *_: 3)
    df = table(spark, *made(900)).cache()
    df.count()
    begin = time.perf_counter()
    assert len(boosting.fit(df, ["a", "b", "c", "d"], "y", boosting.BoostConfig(depth=6, rounds=10)).trees) == 10
    assert time.perf_counter() - begin < 30
    folder = pathlib.Path(written_folder(spark).removeprefix("file:"))
    assert not list(folder.glob("messages-*")) and not list(folder.glob("blocks-*"))


def test_tasks_without_rows(spark, monkeypatch):
    df, cfg = table(spark, *made(30)).limit(3), boosting.BoostConfig(depth=2, rounds=3, subsample=1.0, least_rows=1)
    told = []
    for tasks in (1, 5):
        monkeypatch.setattr(boosting, "stage_tasks", lambda *_, tasks=tasks: tasks)
        told.append(boosting.fit(df, ["a", "b", "c", "d"], "y", cfg).to_json())
    assert told[0] == told[1]


def test_a_lost_task_ends_its_stage(spark, tmp_path):
    def talk(batches):
        peers = boosting.Peers(str(tmp_path))
        if peers.own == 1:
            raise ValueError("lost")
        peers.added(np.zeros(1, np.int64))
        yield from batches

    with pytest.raises(Exception, match="lost"):
        spark.range(9).repartition(3).mapInArrow(talk, "id long", barrier=True).collect()


def test_sums_of_large_numbers_are_whole():
    """Rows whose gradients add up beyond what doubles hold are added up in parts."""
    rng = np.random.default_rng(5)
    n, features = 3 * boosting.BLOCK_ROWS, 2
    row = {"n": n, "bins": rng.integers(0, 3, (features, n)).astype(np.uint8).tobytes(), "target": np.full(n, 2.0**35 - 1).tobytes(), "so_far": np.zeros(n).tobytes()}
    row |= {"mark": rng.integers(0, 2**62, n).astype("<u8").tobytes(), "held": np.zeros(n, bool).tobytes()}
    block = boosting.Block(row, features)
    cfg = boosting.BoostConfig(depth=1, subsample=1.0, columns=1.0)
    alone = type("Alone", (), {"n": 1, "own": 0, "told": lambda self, parts: parts})()
    task = boosting.Growing(block, boosting.Rounds(0, 1, [], [3, 3], 0, cfg, 1000, ""), alone)
    task.tree(0)
    rows = np.arange(n)
    for sums, bins in zip(task.sums(rows, np.zeros(n, np.int64), 1), block.bins):
        assert sums[0, 0].tolist() == [-(2**35 - 1) * int((bins == b).sum()) for b in range(3)]
