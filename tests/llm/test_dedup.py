import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkwright.llm import consensus as C
from inkwright.llm import format_dedup, history_dedup as H, lookalike as L

T0 = dt.datetime(2026, 1, 1)
UP = "id string, batch_no int, created_at timestamp_ntz, access_scope string, file_size int, content_sha256 string, chunk_digests array<string>, ord string, hkey int"


def brute(rows):
    """Sessions in order against all accepted ones."""
    kept, out = [], set()
    for i, b, t, s, size, sha, ch, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        scope = s.strip().lower() if s is not None else None
        sha = sha.lower().removeprefix("sha256:").replace("-", "").strip() if sha else None
        sha = sha if sha and len(sha) == 64 and sha.strip("0") else None
        own = frozenset(x for x in ch or [] if x is not None)
        hits = {j for j, s2, z2, h2, d2 in kept if scope is not None and s2 == scope and ((sha and sha == h2 and size == z2) or (own and d2 and len(own & d2) * 5 >= len(own | d2) * 4))}
        if b > 0 and hits:
            out |= {tuple(sorted((i, j))) for j in hits}
        else:
            kept.append((i, scope, size, sha, own))
    return out


def uploads(seed, n, longest=40):
    r = random.Random(seed)
    base = [[f"{r.getrandbits(64):016x}" for _ in range(r.randint(1, longest))] for _ in range(12)]
    rows = []
    for k in range(n):
        ch = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            if ch and r.random() < 0.5:
                ch.pop(r.randrange(len(ch)))
            else:
                ch.insert(r.randint(0, len(ch)), r.choice(["common", f"{r.getrandbits(64):016x}", None]))
        sha = r.choice([None, "", "0" * 64, "a" * 64, "SHA256:" + "B" * 64, f"{r.getrandbits(256):064x}"])
        rows.append((f"u{k:05}", r.randint(0, 4), T0 + dt.timedelta(seconds=r.randint(0, 50)), r.choice(["local", " LOCAL", "lab", None]), r.choice([1, 2]), sha, r.choice([ch, ch, ch, None, []]), "x", 1))
    return rows


@pytest.mark.parametrize("seed,n,longest", [(1, 150, 12), (2, 120, 40), (3, 80, 160)])
def test_history(spark, seed, n, longest):
    rows = uploads(seed, n, longest)
    got = H.repeats_of_accepted(spark.createDataFrame(rows, UP))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_batches_one_by_one(spark):
    rows = uploads(5, 120)
    df = spark.createDataFrame(rows, UP)
    h, got = H.UploadHistory.create(df.where("batch_no = 0")), set()
    for b in range(1, 5):
        got |= {tuple(sorted(r)) for r in h.feed(df.where(f"batch_no = {b}")).collect()}
    assert got == brute(rows)


def test_an_index_lives_on(spark, tmp_path):
    """Each batch is fed by another object that opens the folder; a part without its commit isn't seen."""
    rows = uploads(6, 120)
    df = spark.createDataFrame(rows, UP)
    at = f"{tmp_path}/index"
    H.UploadHistory.create(df.where("batch_no = 0"), at, split=50)
    assert H.UploadHistory.open(spark, at).splits > 1
    got = set()
    for b in range(1, 5):
        h = H.UploadHistory.open(spark, at)
        n = max(h._commits()) + 1
        df.select("id").write.parquet(f"{at}/cells/part={n}")  # what a crash left
        got |= {tuple(sorted(r)) for r in h.feed(df.where(f"batch_no = {b}")).collect()}
    assert got == brute(rows)
    with pytest.raises(FileExistsError):
        H._write(spark, f"{at}/commits/0", "")


def test_a_batch_reads_only_its_splits(spark, tmp_path):
    """Ten times the history, ten times the splits: a batch of one session reads no more rows."""
    read = []
    for times in (1, 10):
        old = [(f"u{i:06}", 0, T0, "lab", i, f"{i + 1:064x}", [f"{i}-{k}" for k in range(6)], "x", 1) for i in range(1500 * times)]
        h = H.UploadHistory.create(spark.createDataFrame(old, UP), f"{tmp_path}/{times}", split=400)
        new = H.sessions(spark.createDataFrame([("v", 1, T0, "lab", 7, f"{8:064x}", ["7-0", "7-1", "7-2", "7-3", "7-4", "7-5"], "x", 1)], UP))
        sets = new.select("dkey", "scope", "digests")
        read.append([h._read("by_hash", new).count(), h._read("by_set", new).count(), h._read("cells", H._cells(sets, True)).count()])
        assert h.splits == 30 * times
        assert [tuple(r) for r in h.feed(spark.createDataFrame([("v", 1, T0, "lab", 9, None, ["7-0", "7-1", "7-2", "7-3", "7-4", "7-5"], "x", 1)], UP)).collect()] == [("v", "u000007")]
    assert all(b <= 2 * a + 20 for a, b in zip(*read)) and max(read[1]) < 1500


def test_history_empty(spark):
    assert H.repeats_of_accepted(spark.createDataFrame([], UP)).count() == 0


def test_segments():
    for n in range(1, 61):
        spans = H.segment_spans(n)
        assert sum(s for _, s in spans) == n and all(s > 0 for _, s in spans)
        assert all(H.max_distance(n, m) < len(spans) for m in H.partners(n))


def test_formats(spark):
    a = {"field": "corpus.cs", "en": "Co-Amber kernel", "zh": "共琥珀核"}
    rows = [
        (5, json.dumps(a)), (2, "EN= co amber KERNEL! ;\nfield=corpus.cs;zh=《共琥珀核）"), (9, "zh: 共琥珀核 | field: corpus.cs | en: Co_Amber.Kernel"), (1, json.dumps(a)[:-4]), (3, None), (4, " "),
        (6, json.dumps(a | {"note": "n"})), (7, json.dumps(a | {"en": "co amber kernels"})), (8, '{"en": "x"}'), (10, json.dumps({"field": "f", "en": "\u00b5", "zh": "z"})), (11, "field=f;en=\u039c;zh=Z"), (5, json.dumps(a)), (None, json.dumps(a)),
    ]
    df = spark.createDataFrame(rows, "record_id long, payload string").withColumn("f1", F.lit(1)).withColumn("pairs", F.lit("x"))
    assert sorted(tuple(r) for r in format_dedup.copies(df).collect()) == [(2, 5), (2, 9), (10, 11)]
    assert {tuple(r) for r in format_dedup.copy_counts(df).collect()} == {(2, 3), (6, 1), (7, 1), (10, 2)}
    assert format_dedup.copies(df.limit(0)).count() == 0


def test_long_labels_and_repeated_fields(spark):
    """A label of any length is a label in every layout and place; a field given twice isn't a copy of one given once."""
    long = "a label of more than forty characters, as someone wrote it"
    rows = [
        (1, json.dumps({long: "n", "field": "f", "en": "e", "zh": "z"})), (2, f"{long}: n | field: f | en: e | zh: z"), (3, f"field=f;en=e;zh=z;{long}=n"), (4, f"field=f;{long}=n;zh=z;en=e"),
        (5, "field=f;en=e;zh=z;note=a;note=a;tag=b"), (6, "field=f;en=e;zh=z;note=a;tag=b;tag=b"), (7, "note=A;zh=z;field=f;tag=b;note=a;en=e"),
    ]
    df = spark.createDataFrame(rows, "record_id long, payload string")
    assert sorted(tuple(r) for r in format_dedup.copies(df).collect()) == [(1, 2), (1, 3), (1, 4), (5, 7)]


def test_multisets_compare_by_count(spark):
    got = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), (["a", "b", "a"], ["b", "a", "a"]), ([], []), (["a"], ["a", "a"])], "x array<string>, y array<string>")
    assert [r.e for r in got.select(format_dedup.equal_multisets(F.col("x"), F.col("y")).alias("e")).collect()] == [False, True, True, False]


def test_hot_group(spark):
    df = spark.range(600).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 > 0, F.lit("field=a;en=b;zh=c")).otherwise(F.concat(F.lit("field=a;zh=c;en=b"), F.col("id"))).alias("payload"))
    assert format_dedup.copies(df).count() == 399


def test_lookalikes(spark):
    s = [
        (1, "f", "x", "post-lazy naïve", "核"), (2, "f", "x", "pоst‑lazy naïve", "核"), (3, "f", "x", "ｐｏｓｔ-lazy na​ïve", "核﻿"), (4, "f", "x", "Post-lazy naïve", "核"), (5, "f", "x", "post-lazy naive", "核"),
        (6, "f", "x", "post-lazy  naïve", "核"), (7, "f", "y", "pоst-lazy naïve", "核"), (8, "f", "x", "L²", None), (9, "f", "x", "L2", None), (10, "f", "x", "Lⅱ", ""), (11, "f", "x", "ⅬⅡ", None), (12, "f", "x", "post-lazy naïve", "核"), (13, None, None, None, None), (14, "f", "x", "", "⾯"), (15, "f", "x", "", "面"),
    ]
    df = spark.createDataFrame(s, "term_id long, file_name string, field string, en string, zh string").withColumn("k", F.lit(0))
    got = sorted(tuple(r) for r in L.lookalike_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 12), (3, 12), (14, 15)]
    assert L.lookalike_pairs(df.limit(0)).count() == 0
    assert L.Lattice({}).form("x" * 5000) == "x" * 5000


def test_forms_by_score(spark):
    """Which letters a form is written in, and which shape an ambiguous letter has, is decided by the texts' own bigrams."""
    plain = ["рост сети", "рост ростка", "сор сор сора", "сор", "post office", "alpha gate", "αβγ law", "αβγδ", "ｒａｎｋ rank", "口号", "エロ"]
    mixed = {"рocт": "рост", "cоp": "сор", "pоst": "post", "ɑlpha": "alpha", "ɑβγ": "αβγ", "аlphа": "alpha", "ｐｏｓｔ": "post", "ロ号": "口号", "エ口": "エロ", "na\u200bïve": "naïve"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain * 5 + list(mixed))], "term_id long, en string")
    got = {r.en: r.en_form for r in L.consistent(df, ["en"]).collect()}
    assert {t: got[t] for t in mixed} == mixed
    assert all(got[t] == L.compatible(t) for t in plain)
    # without the counts of the texts a form follows the first letter of each shape, and this Cyrillic word is lost
    assert L.Lattice({}).form("сор") == "cop"


def test_an_ambiguous_letter_meets_one_shape(spark):
    """ɑ looks like a and like α, which don't look like each other: the path decides what it meets. A skeleton that joins all
    letters that resemble it, or none, fails here."""
    s = [(i, "f", "x", t, "词") for i, t in enumerate(["alpha", "ɑlpha", "αlpha", "αβγ", "ɑβγ", "aβγ"])]
    s += [(10 + i, "g", "y", t, "词") for i, t in enumerate(["alpha law", "alphabet", "αβγδ", "αβ"] * 3)]
    df = spark.createDataFrame(s, "term_id long, file_name string, field string, en string, zh string")
    assert sorted(tuple(r) for r in L.lookalike_pairs(df).collect()) == [(0, 1), (3, 4)]


def test_a_look_with_many_equal_rows(spark):
    """One variant beside 30,000 rows written alike gives 30,000 pairs, and the equal rows are never paired."""
    df = spark.range(30_001).select(F.col("id").alias("term_id"), F.lit("f").alias("file_name"), F.lit("x").alias("field"), F.when(F.col("id") == 7, "pоst").otherwise("post").alias("en"), F.lit("z").alias("zh"))
    got = L.lookalike_pairs(df)
    assert got.count() == 30_000 and got.where("term_id_1 <> 7 and term_id_2 <> 7").count() == 0


def test_consensus():
    won, best = C.consensus(["a b c", "a b d", "a x d"], [1, 1, 1])
    assert won == ["a", " ", "b", " ", "d"] and best == 1
    won, best = C.consensus(["a b c", "a b d", "a b d"], [1, 1, 1], strict=True)
    assert won == ["a", " ", "b", " ", "c"] and best == 0
    assert C.consensus(["", "x"], [1, 5])[1] == 1


def test_best_papers(spark):
    d = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        ("a", "s", 5, "failed", "N/A", "My File.pdf", d(0), d(1)), ("b", "s", 5, "completed", "b_zh.pdf", "my_file (1).PDF", d(1), d(3)), ("c", "s", 5, None, "c_zh.pdf", "Copy of my%20file.pdf.pdf", d(-1), d(-5)),
        ("d", "s", 5, "pending", " ", "my-file 副本.pdf", d(0), dt.datetime(2027, 1, 1)), ("e", "s", 6, "x", None, "my file.pdf", d(0), d(1)), ("f", None, 5, "x", None, "my file.pdf", d(0), d(1)), ("g", "t", 5, "x", None, "m.pdf", None, None),
        ("h", "t", 5, "y", "null", "m - Copy (2).pdf", None, None), ("b", "s", 5, "completed", "b_zh.pdf", "my_file (1).PDF", d(1), d(3)),
    ]
    cols = "id string, access_scope string, file_size int, translation_status string, translated_filename string, original_filename string, created_at timestamp_ntz, updated_at timestamp_ntz"
    df = spark.createDataFrame(rows, cols).withColumn("k", F.lit(1)).withColumn("group_id", F.lit(1))
    assert sorted(tuple(r) for r in C.best_papers(df).collect()) == [("a", "b", "b", "c"), ("g", "g", "", "g")]
    assert C.best_papers(df.limit(0)).count() == 0


def test_large_group(spark):
    """More values than a block holds: aligned in blocks, none left out."""
    df = spark.range(900).select(F.lit("g").alias("g"), F.concat(F.lit("file "), F.col("id"), F.lit(" x.pdf")).alias("v"), F.format_string("%05d", "id").alias("id"), (F.abs(F.col("id") - 777)).alias("t"))
    assert [tuple(r) for r in C.surviving_rows(df, ["g"], "v", "id", [F.col("t")]).collect()] == [("g", "00777")]
