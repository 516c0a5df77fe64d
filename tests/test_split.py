"""Exact shares of rows, chosen by counting hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landheat.operators import split


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_shares_are_exact(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("other"))
    for share in (0.0, 0.15, 0.5, 0.999, 1.0):
        got = split.with_first(df, ["id"], share, "first")
        assert got.filter("first").count() == int(n * share) and got.count() == n
    marked = split.with_validation(split.shuffled_split(df, ["id"]), ["id"])
    train, val = marked.filter("split = 'train'").count(), marked.filter("is_val").count()
    assert train == int(n * 0.8) and val == (max(1, int(train * 0.15)) if train else 0)
    assert marked.filter("is_val and split = 'test'").count() == 0


def test_choice_is_alike_on_any_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") % 5).cast("string").alias("s"))
    a, b = (sorted(map(tuple, split.with_first(d, ["id"], 0.3, "x").collect())) for d in (df.coalesce(1), df.repartition(9)))
    assert a == b


def test_rows_that_share_their_keys(spark):
    """Few keys: the border cuts through rows that share one; others decide, and the number stays exact."""
    df = spark.range(500).select((F.col("id") % 4).alias("k"), "id")
    a, b = (split.with_first(d, ["k"], 0.31, "x") for d in (df.coalesce(1), df.repartition(6)))
    assert a.filter("x").count() == 155 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    same = spark.range(100).select(F.lit(1).alias("k"))
    assert split.with_first(same, ["k"], 0.25, "x").filter("x").count() == 25
    assert split.with_first(same, ["k"], 0.5, "x", among=F.lit(None).cast("boolean")).filter("x").count() == 0


@pytest.mark.parametrize("bits,most", [(16, 100_000), (16, 0), (4, 0), (8, 3)])
def test_kth_hash(spark, monkeypatch, bits, most):
    monkeypatch.setattr(split, "PASS_BITS", bits)
    monkeypatch.setattr(split, "MOST_HASHES", most)
    rng = np.random.default_rng(1)
    values = [*rng.integers(-(2**63), 2**63 - 1, 60).tolist(), *[-(2**63)] * 3, *[2**63 - 1] * 4, -1, 0, 0, 1]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(3).cache()
    order = sorted(values)
    for k in (1, 3, 4, 30, len(values) // 2, len(values) - 3, len(values)):
        t = order[k - 1]
        assert split._kth(df, k) == (t, k - order.index(t))
