"""The scale helpers against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from inkwright.operators import scale


def test_join_split_gives_every_pair_once(spark):
    r = random.Random(1)
    a = [(r.choice([1, 1, 1, 2, 3, None]), i) for i in range(40)]
    b = [(r.choice([1, 1, 1, 1, 2, 4, None]), i) for i in range(200)]
    x, y = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    got = sorted(tuple(q) for q in scale.join_split(x, y, ["k"], most=7).collect())
    assert got == sorted((k, i, j) for k, i in a for m, j in b if k is not None and k == m)


def test_small_counts_rows_and_bytes(spark):
    marked = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    df = spark.range(50).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert marked(scale.small(df, 50)) and not marked(scale.small(df, 49)) and not marked(scale.small(df, 50, 2000))
    assert marked(scale.small(df.limit(0), 1))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return self

        get = staticmethod(lambda *_: None)

    fake = type("Session", (), {"conf": Cluster(), "sparkContext": Cluster()})()
    with pytest.raises(ValueError):
        scale.shared_dir(fake)


def test_bind_computes_once(spark):
    got = spark.range(2).select(scale.bind(F.rand(), lambda c: c == c).alias("same")).collect()
    assert all(r.same for r in got)
