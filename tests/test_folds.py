import pytest

from inkwright.operators.folds import Progress, SlidingLog, anchor_clusters, greedy_batches
from inkwright.operators.glossary import match_terms
from inkwright.operators.scale import join_hot, small, stage
from inkwright.functions.text import redact_error
from inkwright.plans import load
from tests.conftest import SF


def test_batches():
    assert greedy_batches([10] * 9, 8, 2500) == [0] * 8 + [1]
    assert greedy_batches([3000, 10, 2495], 8, 2500) == [0, 1, 2]
    assert greedy_batches([], 8, 2500) == []
    with pytest.raises(ValueError):
        greedy_batches([1], 0, 1)


def test_anchors():
    assert anchor_clusters([1, 26, 30, 60], 25) == [1, 30, 60]


def test_sliding_log():
    log = SlidingLog([(60, 2), (3600, 3)])
    assert [log.offer(t)[0] for t in (0, 1, 2, 60, 61, 62)] == [True, True, False, True, False, False]
    log = SlidingLog([(60, 1)])
    assert log.offer(0) == (True, 0) and log.offer(59) == (False, 2) and log.offer(60) == (True, 0)


def test_progress():
    p = Progress()
    assert p.offer(0, 0.0) == [] and p.offer(1, 0.005) == [] and p.offer(2, 0.5) == [(2, 0.5, 2)] and p.offer(3, 1.0) == [(3, 1.0, 0)]


def test_stream_is_batch(spark):
    q = load().queries
    assert {tuple(r) for r in q["rate_limit_batch"](spark, SF).collect()} == {tuple(r) for r in q["rate_limit_stream"](spark, SF).collect()}


def test_match_terms(spark):
    t = spark.createDataFrame([("rank", "秩"), ("norm", "范数"), ("quantitative result", "定量"), ("neural network", "网络"), ("c++", "x")], "en string, zh string")
    d = spark.createDataFrame([(1, "ranking normalized"), (2, "Quantitative results of neural networks; rank."), (3, None), (4, "")], "id int, text string")
    assert sorted((r.id, r.en) for r in match_terms(d, "id", "text", t).collect()) == [(2, "neural network"), (2, "quantitative result"), (2, "rank")]


def test_redaction(spark):
    d = spark.createDataFrame([("token=abc at /etc/x from 10.0.0.1:80",), ("x" * 600,), (None,)], "m string")
    a, b, c = [r[0] for r in d.select(redact_error(d.m)).collect()]
    assert a == "token=[redacted] at [path] from [ip]" and len(b) == 203 and c is None


def test_hot_join(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "id int, k int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert join_hot(rows, groups, ["k"], "n", 300, share=5).count() == 300
    assert stage(rows, "rows").count() == 300 and small(rows, 10).count() == 300
