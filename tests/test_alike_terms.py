"""Terms that begin alike meet only the texts that hold them, so that a glossary of many such terms moves little."""

import pytest

from inkwright.operators import glossary as G
from tests.test_whole import CORE, CORPUS, TERMS, holds, put


def joined_rows(plan):
    """The most rows that a join of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    below = [joined_rows(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([0, *below, *([plan.metrics().apply("numOutputRows").value()] if "Join" in name and plan.metrics().contains("numOutputRows") else [])])


def frames(spark, said):
    texts = spark.createDataFrame(list(enumerate(said)), "term_id long, en string")
    return texts, texts.selectExpr("lower(en) as en", "term_id as place").dropDuplicates(["en"])


def test_terms_that_begin_alike_make_few_pairs(spark):
    texts, terms = frames(spark, [f"Meta-Amber {'waypoint ' * (k % 6)}t{k} loss" for k in range(400)])
    met = G.match_terms(texts, "term_id", "en", terms, few=0)
    assert len(met.collect()) == 400
    assert 400 <= joined_rows(met._jdf.queryExecution().executedPlan()) < 4_000


def test_terms_of_any_length_match_either_way(spark):
    said = TERMS + [" ".join(f"w{i}" for i in range(n)) for n in (2, 7, 8, 9, 10, 30)] + ["w0 w1 w2 w3 w4 w5 w6 w7s", "W0-w1 w2 w3 w4 w5 w6 w7 w8es, a gates", "w0 w1s w2 … ***", "deep s", "s"]
    texts, terms = frames(spark, said)
    want = {(i, en.lower()) for i, text in enumerate(said) for en in said if en.strip() and holds(text, en)}
    for few in (1000, 0):
        got = [(r.term_id, r.en) for r in G.match_terms(texts, "term_id", "en", terms, few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["gloss_audit", "gloss_audit_top", "gloss_match", "gloss_match_top"])
def test_queries_over_terms_that_begin_alike(spark, tmp_path, monkeypatch, name):
    """As where the terms are too many for a broadcast."""
    monkeypatch.setattr(G, "small", lambda df, *_: df)
    put(spark, tmp_path, "corpus", [(k, "f", 0, "cs", 0, k, f"Meta-Amber t{k} Loss", f"词{k}号") for k in range(300)], CORPUS)
    put(spark, tmp_path, "term_records", [(k, f"field: f.cs | en: meta-amber t{k} losses | zh: {f'词{k}号' if k % 3 else '别'}") for k in range(300)], "record_id long, payload string")
    met = CORE.queries[name](spark, str(tmp_path))
    want = range(0, 300, 3) if "audit" in name else range(300)
    assert sorted(r[:2] for r in map(tuple, met.collect())) == [(k, f"meta-amber t{k} loss") for k in want]
    assert 300 <= joined_rows(met._jdf.queryExecution().executedPlan()) < 3_000
