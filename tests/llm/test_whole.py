"""Whole-job properties of the training-data operators."""

import datetime as dt

from pyspark.sql import functions as F

from inkwright.llm import consensus as C
from inkwright.llm.queries import LLM

T0 = dt.datetime(2026, 1, 1)
PAPERS = "id string, access_scope string, file_size int, translation_status string, translated_filename string, original_filename string, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_votes_matter_in_the_consensus_only(spark, tmp_path):
    """Two rows outvote the most trusted one in p5_consensus; p5_found takes the most trusted row, without an alignment."""
    rows = [(i, "s", 5, status, None, "a.pdf", T0, T0 + dt.timedelta(days=n)) for i, status, n in [("a", "done", 1), ("b", "done", 2), ("c", "failed", 3)]]
    spark.createDataFrame(rows, PAPERS).write.parquet(f"{tmp_path}/papers.parquet")
    got = {q: [tuple(r) for r in LLM.queries[q](spark, str(tmp_path)).collect()] for q in ("p5_found", "p5_consensus")}
    assert got == {"p5_found": [("a", "c", "", "a")], "p5_consensus": [("a", "b", "", "a")]}
    plan = LLM.queries["p5_found"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def test_any_number_of_copy_marks(spark):
    names = ["x.pdf", "x - Copy - Copy - Copy - Copy - Copy.pdf", "x (1) (2) (3) (4) (5).pdf", "Copy of Copy of Copy of Copy of Copy of x.pdf", "x.pdf (1).pdf - Copy.pdf (2).pdf 副本.pdf 副本.pdf", "x" + " - Copy (2)" * 60 + ".pdf"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(C.file_key(F.col("n")).alias("k")).collect()]
    assert got == ["x"] * len(names)
    kept = [("copy.pdf", "copy"), ("(1).pdf", "(1).pdf"), ("photocopy.pdf", "photocopy"), ("x (2024).pdf", "x2024")]
    assert [r.k for r in spark.createDataFrame([(n,) for n, _ in kept], "n string").select(C.file_key(F.col("n")).alias("k")).collect()] == [k for _, k in kept]
