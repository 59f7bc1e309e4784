"""Recovery of failed units, folds, and files: against small cases with known results."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from inkwright.functions import pieces, responses
from inkwright.operators import folds, recovery
from inkwright.plans.uploads import evolve
from inkwright.sources import files


def lossy(limit):
    """Loses the last mark of a text with more than `limit` marks."""

    def supply(texts):
        out = []
        for t in texts:
            marks = recovery.MARK.findall(t)
            out.append("译文 " + ("".join(t.rsplit(marks[-1], 1)) if len(marks) > limit else t))
        return out

    return supply


LONG = "word " * 30 + "⟦0⟧ end. " + "more " * 30 + "⟦1⟧ end."


@pytest.mark.parametrize("text,supply,way", [
    ("plain", lossy(0), "kept"), ("a ⟦0⟧", lossy(1), "kept"), (LONG, lossy(1), "split"), ("ab ⟦0⟧ cd ⟦1⟧", lossy(1), "prose"), ("⟦0⟧⟦1⟧", lossy(1), "source"),
    ("x ⟦0⟧", lambda ts: [] if len(ts) > 1 else ["译 " + ts[0]], "kept"),
])
def test_ways(text, supply, way):
    (got, other), _ = recovery.recover(supply, [text, "other"]), None
    assert got[1] == way and recovery.marks_kept(text, got[0])
    assert other[1] == "kept"


def test_a_supplier_that_fails_leaves_the_source():
    def broken(texts):
        if len(texts) > 1:
            raise RuntimeError
        return [""]

    assert recovery.recover(broken, ["a ⟦0⟧", "b", ""]) == [("a ⟦0⟧", "source"), ("b", "source"), ("", "kept")]


def test_translated_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a ⟦0⟧ b"), (2, None), (3, ""), (1, "a ⟦0⟧ b")], "id long, t string").withColumn("way", F.lit("x"))
    got = recovery.translated(df, "id", "t", lambda: lossy(1))
    assert sorted(r.id for r in got.collect()) == [1, 1, 2, 3]
    assert recovery.translated(df.limit(0), "id", "t", lambda: lossy(1)).count() == 0


def test_planners(spark):
    xs = [[("error", "untranslated_block")], [("warning", "text_overlap")], [("error", "other")], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, xs array<struct<severity string, code string>>")
    got = [r.a for r in df.orderBy("i").select(recovery.plan("by_rule", F.col("xs")).alias("a")).collect()]
    assert got == ["retranslate", "repair_layout", "stop", "accept"]
    with pytest.raises(KeyError):
        recovery.plan("nobody", F.col("xs"))


def test_row_groups_against_medians():
    r = random.Random(3)
    for _ in range(50):
        xs = sorted(r.randint(0, 60) / 2 for _ in range(r.randint(0, 30)))
        rows, want = [], []
        for c in xs:
            i = next((i for i, row in enumerate(rows) if abs(c - statistics.median(row)) <= 2.5), None)
            if i is None:
                rows.append([])
                i = len(rows) - 1
            rows[i].append(c)
            want.append(i)
        assert folds.row_groups(xs) == want


def test_coalesced_runs():
    assert folds.coalesce_runs([]) == []
    runs = [(0, 0, 10, 8), (11, 0.5, 20, 9), (22, 1, 30, 9), (40, 1, 50, 9), (49, 1, 60, 9), (49.6, 9, 70, 17)]
    assert folds.coalesce_runs(runs) == [(0, 0, 30, 9), (40, 1, 50, 9), (49, 1, 60, 9), (49.6, 9, 70, 17)]


def test_layers(spark, tmp_path):
    at = f"{tmp_path}/layers"
    rows = [("a", "x", "Gate", "门"), ("a", "x", "b\"q", "引\n号"), ("a", "_meta", "v", "1"), ("b", "x", "Gate", "阀"), ("b", "y", "naïve", "朴素")]
    files.write_layers(spark.createDataFrame(rows, "layer string, field string, en string, zh string"), at)
    assert sorted(map(tuple, files.read_layers(spark, at).collect())) == sorted(r for r in rows if r[1] != "_meta")
    assert "朴素" in "".join(r.value for r in spark.read.text(at).collect())  # letters stay as they are
    assert files.read_layers(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([("[1, 2]",)], "value string").write.mode("append").text(at)
    with pytest.raises(Exception, match="no JSON object"):
        files.read_layers(spark, at).collect()


def test_lines_are_appended_once(spark, tmp_path):
    at = f"{tmp_path}/lines"
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "term string, n int")
    assert files.append_new_lines(df, at, "term") == 2
    spark.createDataFrame([("{broken",), ("[1]",), ('{"term": "c"}',)], "value string").write.mode("append").text(at)
    assert files.append_new_lines(spark.createDataFrame([("b", 9), ("c", 9), ("d", 9)], "term string, n int"), at, "term") == 1
    lines = files.json_lines(spark.read.text(at), "value", "term")
    assert sorted(r.term for r in lines.collect()) == ["a", "b", "c", "d"]


def test_answers_of_any_kind(spark):
    xs = [None, "", "not json", '```json\n["a", "b"]\n```', 'So: {"results": [{"text": "x"}]} ok', '{"translations": [1]}', '"t"', "[]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i")
    lists = [r.v for r in df.select(responses.text_list(responses.json_of(F.col("x"))).alias("v")).collect()]
    assert lists == [None, None, None, ["a", "b"], ["x"], None, None, []]
    plain = [r.v for r in df.select(responses.plain_text(F.col("x")).alias("v")).collect()]
    assert plain[:3] == [None, None, "not json"] and plain[4] == "x" and plain[6] == "t"


def test_split_and_protect(spark):
    xs = [None, "", "short. text", "a" * 90 + ". " + "b" * 90, "a" * 90 + ". " + "b" * 80 + "! " + "c" * 90, "$x$ and https://a.b/c $y$", "⟦0⟧ odd"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i")
    assert [r.p for r in df.select(pieces.split_point(F.col("x")).alias("p")).collect()] == [None, None, None, 92, 92, None, None]
    p, found = pieces.protect(F.col("x"))
    got = df.select("x", p.alias("p"), found.alias("f")).withColumn("back", pieces.restore(F.col("p"), F.col("f"))).collect()
    assert got[5].p == "⟦0⟧ and ⟦1⟧ ⟦2⟧" and got[5].back == xs[5] and got[0].p is None and got[1].back == ""


def test_a_schema_evolves_once(spark):
    df = spark.createDataFrame([(1, "x")], "id int, scope string")
    new = evolve(evolve(df, {"scope": "local", "n": 0}), {"scope": "local", "n": 5})
    assert [tuple(r) for r in new.collect()] == [(1, "x", 0)]
