"""A glossary too large for a broadcast, whose keys aren't: one shuffle brings all together, and each row moves about once."""

import random

import pytest

from inkwright.operators import glossary as G
from tests.test_whole import CORE, CORPUS, TERMS, holds, put

LONG = [" ".join(f"w{i}" for i in range(n)) for n in (2, 7, 8, 9, 10)]


def moved_rows(plan):
    """The rows that the shuffles of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return moved_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(moved_rows(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.fixture
def unhinted(spark):
    """No table is broadcast for being small by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# rows of the glossary and the records once, and what is ranked once more; a record has its term in the plural
@pytest.mark.parametrize("name, most", [("gloss_match", 450), ("gloss_match_top", 800), ("gloss_audit", 750), ("gloss_audit_top", 900)])
def test_rows_move_about_once(spark, unhinted, tmp_path, monkeypatch, name, most):
    monkeypatch.setattr(G, "FEW_TERMS", 0)
    monkeypatch.setattr(G, "small", lambda df, *_: df)
    put(spark, tmp_path, "corpus", [(k, "f", 0, "cs", 0, k, f"Meta-Amber t{k} Loss", f"词{k}号") for k in range(300)], CORPUS)
    put(spark, tmp_path, "term_records", [(k, f"field: f.cs | en: meta-amber t{k} losses | zh: {f'词{k}号' if k % 3 else '别'}") for k in range(300)], "record_id long, payload string")
    met = CORE.queries[name](spark, str(tmp_path))
    want = range(0, 300, 3) if "audit" in name else range(300)
    assert sorted(r[:2] for r in map(tuple, met.collect())) == [(k, f"meta-amber t{k} loss") for k in want]
    assert moved_rows(met._jdf.queryExecution().executedPlan()) < most


def glossary(spark, terms):
    """Each term twice, of which the last value and the first place count; rows come as they like."""
    rows = [(i, "f", 0, "x", 0, i, en, "old") for i, en in enumerate(terms)] + [(1000 + i, "f", 1, "x", 0, i, en.upper(), f"词{i}") for i, en in enumerate(terms) if en.lower() == en.upper().lower()]
    return spark.createDataFrame(random.Random(3).sample(rows, len(rows)) + [(9999, "f", 2, "x", 0, 0, None, None)], CORPUS)


def test_terms_of_a_glossary_within_its_own(spark, monkeypatch):
    said = TERMS + LONG + ["w0 w1 w2 w3 w4 w5 w6 w7s", "W0-w1 w2 w3 w4 w5 w6 w7 w8es, a gates", "w0 w1s w2 … ***", "deep s", "s", "gate map gate map gates"]
    both = glossary(spark, said).unionByName(glossary(spark, said))  # repeated rows give no more
    want = sorted(map(tuple, G.match_terms(both, "term_id", "en", G.placed_terms(both)).collect()))
    held = {(i, en.lower()) for i, text in enumerate(said) for en in said if en.strip() and holds(text, en)}
    assert {r[:2] for r in want if r[0] < 1000} == held
    monkeypatch.setattr(G, "FEW_TERMS", 0)
    assert sorted(map(tuple, G.match_glossary(both, cols=("zh", "place")).collect())) == want


def test_terms_within_texts_of_any_length(spark, monkeypatch):
    terms, rng = TERMS + LONG, random.Random(5)
    some = [t for t in terms if len(t) < 12] + ["x", "_", "loss", "W0 w1 w2", "w3 w4 w5 w6 w7 w8s"]
    texts = ["", " ", "gate", *LONG] + ["".join(rng.choice(some) + rng.choice(["", " ", " ", " ", "-", "s ", "es ", "_", "\n"]) for _ in range(n)) for n in (3, 20, 60, 61, 200, 500)]
    # terms at every place around a cut
    texts += ["y " * 100 + "z" * k + " naïve gate, c++ (a+b) map and boxes" + " y" * 60 for k in range(20, 120, 3)]
    d = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)] + [(None, "a gate", "n"), (777, None, "m")], "id long, text string, kept string")
    monkeypatch.setattr(G, "FEW_TERMS", 0)
    assert max(map(len, texts)) > 1000
    got = [tuple(r) for r in G.match_glossary(glossary(spark, terms), d, "id", "text", cols=(), keep=("kept",)).collect()]
    assert len(got) == len(set(got))
    want = {(i, en.lower(), f"k{i}") for i, text in enumerate(texts) for en in terms if en.strip() and holds(text, en)}
    assert set(got) == want | {(None, "gate", "n")}
