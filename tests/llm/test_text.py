import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwright.llm import leakage, pii, tokens
from inkwright.sources.tables import table
from tests.conftest import SF

ODD = [None, "", " ", "a" * 9000, "ab地" * 20000, "\n\n\n x\n\n", "<|endoftext|> hi", "don'll" * 3000, " \t　" * 4000, "ไทย \U0001f44d🏽 é é", "x. " * 9000]


def test_tokens(spark):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["the ", "ing", "\n", "地", "'", "l", "l ", "12", " ", "é", "!!"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, n int").withColumn("row", F.lit(1))
    for piece in (37, 16_384):
        got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df, piece=piece).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_white_space_before_long_runs(spark):
    """White space is cut by what follows it, so a long run must not hide it: every kind of both, whole and in pieces."""
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    blanks = ["\n\n", " ", "  ", "\t\n", " \n ", "\r\n\r\n", "\u3000\u3000", "\u2003 ", "\n" * 50]
    runs = ["x" * 1025, "地" * 1100, "ACGT" * 400, "9" * 1500, "!?" * 700, " " * 1500 + "b", "x" * 20_000]
    texts = ["foo" + b + run + b + "end." + b + run[:1030] for b in blanks for run in runs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    for piece in (37, 1024, 16_384):
        assert {r.doc_id: list(r.ids) for r in tokens.token_ids(df, piece=piece).collect()} == want


def test_joins():
    e = tokens.encoder("byte_bpe_50k", "/opt/tokenizers")
    r = random.Random(2)
    for _ in range(400):
        x = "".join(r.choice(["ab", "the", "地址", "aaaa", "ing", "é", "\U0001f44d"]) for _ in range(r.randint(1, 40))).encode()
        c = r.randint(0, len(x))
        one = lambda b: e.core.encode_single_piece(b) if b else []
        assert e.join(one(x[:c]), one(x[c:])) == one(x)


def test_winnowing_keeps_every_run():
    r = random.Random(3)
    for _ in range(60):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(12, 30))]
        a = " ".join([f"a{r.random()}" for _ in range(r.randint(0, 20))] + words)
        b = " ".join([f"b{r.random()}" for _ in range(r.randint(0, 20))] + words)
        pa, pb = leakage.fingerprints([a]), leakage.fingerprints([b])
        assert set(pa[2].tolist()) & set(pb[2].tolist())


def brute_leaks(docs, items):
    out = set()
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    for d, t in docs:
        w = leakage.words(t or "")
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return {x for x in out if x[0] is not None}


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"t{r.randint(0, 60)}" for _ in range(r.choice([5, 11, 12, 40])))) for i in range(30)] + [(90, None), (91, ""), (92, "same " * 20)]
    docs = []
    for d in range(80):
        w = (r.choice(items)[1] or "").split()
        a = r.randint(0, max(0, len(w) - 12))
        part = w[a : a + r.choice([11, 12, 13, 40])]
        text = " ".join(["x"] * r.randint(0, 30)) + " " + r.choice([" ", ", ", "\n", ".​ "]).join(r.choice([x, x.upper(), x[:1] + "​" + x[1:]]) for x in part) + " y" * r.randint(0, 5)
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "Same, " * 300), (202, "Same, " * 300), (203, "word " * 50_000), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gram", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    assert {tuple(r) for r in leakage.leaked_items(df, it).collect()} == brute_leaks(docs, items)
    assert {tuple(r) for r in leakage.leaked_items(df, it, held=0).collect()} == brute_leaks(docs, items)
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_found_and_redacted(spark, model):
    text = "Dr. Bettina Krause, phone +1 (555) 014-3339, called twice. The Krause bound holds on page 12."
    long = "All 12 models were trained on Talmere-9. " * 3000 + "Write to juno\u200b.x@lab.orvane.test for the files."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, long), (1, text)], "doc_id long, text string").withColumn("kind", F.lit("k"))
    got = sorted(tuple(r) for r in pii.found_values(df).collect())
    assert got == [(1, "name", 4), (1, "phone", text.index("+1")), (4, "email", long.index("juno"))]
    out = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert out[1].text.startswith("Dr. [NAME], phone [PHONE], called twice.") and out[2].text is None and out[3].n_values == 0
    assert pii.found_values(df.limit(0)).count() == 0


def test_queries_run(spark):
    from inkwright.llm.queries import LLM

    docs = table(spark, SF, "documents").count()
    for name in ("p6_ids", "p8_redacted"):
        assert LLM.queries[name](spark, SF).count() == docs
    assert LLM.queries["p4_forms"](spark, SF).count() == table(spark, SF, "corpus").count()
