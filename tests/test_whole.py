"""Queries that do the whole job where SQL over whole tables can't say it, against brute force on small tables."""

import re
from collections import defaultdict

import pytest

from inkwright.operators import glossary as G
from inkwright.plans import load

CORE = load()


def put(spark, folder, name, rows, cols):
    spark.createDataFrame(rows, cols).write.parquet(f"{folder}/{name}.parquet")


CORPUS = "term_id long, file_name string, file_ord int, field string, field_ord int, term_ord int, en string, zh string"
TEXTS = [
    (1, "Le modèle Deep Policy Gradient, élan-based vision-language “Graph Neural Network” 用于RLHF训练。"), (2, "Deep Policy Gradient; naïve-Bayes Learning éDeep Policy x_Deep Map"),
    (3, "plain Deep Policy Gradient text"), (4, None), (5, ""), (6, "图Graph Neural Network图 Graph Neural Network² (Graph-Neural Network) straße-Vision Transformer"), (7, "Known Term Here, known-term here"),
]


def test_candidates_of_all_texts(spark, tmp_path):
    put(spark, tmp_path, "documents", TEXTS, "doc_id long, text string")
    put(spark, tmp_path, "corpus", [(1, "f", 0, "x", 0, 0, "known\u00a0term here", "词")], CORPUS)
    want = defaultdict(list)
    for i, text in TEXTS:
        for m in re.finditer(rf"\b{G.FORMS}\b", text or ""):  # \b of Python knows all letters
            raw = m.group(0)
            key = " ".join(raw.replace("-", " ").split()).lower()
            if len(key) >= 4 and key != "known term here" and key not in G.COMMON and (re.search("[A-Z]", raw) or "-" in raw and any(w in raw.lower() for w in G.ACADEMIC)):
                want[key].append((i, raw))
    got = {r.term_key: (r.term, r.n, r.texts) for r in CORE.queries["cand_extract"](spark, str(tmp_path)).collect()}
    assert got == {k: (v[0][1], len(v), len({i for i, _ in v})) for k, v in want.items()}
    assert got["deep policy gradient"] == ("Deep Policy Gradient", 3, 3)
    assert {(r.term_key, r.n) for r in CORE.queries["cand_top"](spark, str(tmp_path)).collect()} == {(k, v[1]) for k, v in got.items()}
    assert {r.term_key for r in CORE.queries["cand_field"](spark, str(tmp_path)).collect()} == set(got)


TERMS = ["α-Kinetic Residue", "Naïve Gate", "naïve gates", "gate", "L² Loss", "²", "what?", "(a+b) map", "ve gate", "map", "注意力", "注意力 map", "…", " ", "a_b", "Gate\u00a0Loss", "x", "xs", "boxes", "box", "Big Naïve Gate Loss Map", "Σίγμα loss", "nai\u0308ve", "***", "c++", "C:\\\\d"]


def holds(text, en):
    """A term as a whole word or plural, by single characters."""
    low, en, at, word = text.lower(), en.lower(), -1, lambda c: c.isalnum() or c == "_"
    while (at := low.find(en, at + 1)) >= 0:
        for end in ("", "s", "es"):
            n = at + len(en + end)
            if low[at:n] == en + end and not (at and word(low[at - 1])) and not (n < len(low) and word(low[n])):
                return True
    return False


def test_every_term_matches(spark, tmp_path):
    terms = TERMS + ["t%d " % k * 2 + "big" for k in range(60)] + [" ".join("t%d t%d big" % (k, k) for k in range(60))]
    put(spark, tmp_path, "corpus", [(i, "f", 0, "x", 0, 99 - i, en, "词") for i, en in enumerate(terms)] + [(999, "f", 1, "x", 0, 0, None, None)], CORPUS)
    want = {(i, en.lower()) for i, text in enumerate(terms) for en in terms if en.strip() and holds(text, en)}
    got = [(r.term_id, r.en) for r in CORE.queries["gloss_match"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(i, en.lower()) for i, en in enumerate(terms) if en.strip()} <= want  # themselves included
    place = {en.lower(): 99 - i for i, en in enumerate(terms)}
    best = defaultdict(list)
    for i, en in want:
        best[i].append(en)
    want = {(i, en, k) for i, ens in best.items() for k, en in enumerate(sorted(ens, key=lambda en: (-len(en), place[en]))[:50], 1)}
    assert max(len(v) for v in best.values()) > 50
    assert {tuple(r) for r in CORE.queries["gloss_match_top"](spark, str(tmp_path)).collect()} == want


def test_many_terms_match_by_a_shuffle(spark):
    """Beyond the bound of a broadcast the terms and texts meet by key; the result is the same."""
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TERMS + ["a gate, a naïve gate and boxes"])], "term_id long, en string")
    terms = texts.where("en is not null").selectExpr("lower(en) as en", "term_id as place").dropDuplicates(["en"])
    rows = [sorted(map(tuple, G.match_terms(texts, "term_id", "en", terms, few=n).collect())) for n in (1000, 0)]
    assert rows[0] == rows[1] and rows[0]


RECORDS = [
    (1, '{"field": "corpus.cs", "en": "Deep Gate", "zh": "深门"}'), (2, "field: corpus.cs | en: Big α-Gate | zh: 大阀"), (3, "EN=deep gates;  Zh=\u3000别\u00a0; note=a: b|c; Field=corpus.cs"),
    (4, '{"FIELD": "corpus.cs", "EN": "naïve map", "ZH": "图"}'), (5, '{"field": "corpus.cs", "en": "cut'), (6, None), (7, "  "), (8, "field: corpus.cs | en: Deep Gate"), (9, "zh: 深门 | en: Deep Gate | field: corpus.cs"),
]


def test_records_of_all_layouts(spark, tmp_path):
    put(spark, tmp_path, "term_records", RECORDS, "record_id long, payload string")
    put(spark, tmp_path, "corpus", [(1, "f", 0, "cs", 0, 0, "deep gate", "深门"), (2, "f", 0, "cs", 0, 1, "α-gate", " 阿门 "), (3, "f", 0, "cs", 0, 2, "naïve map", "朴素图"), (4, "f", 0, "cs", 0, 3, "big", "big")], CORPUS)
    rows = lambda name: sorted(tuple(r) for r in CORE.queries[name](spark, str(tmp_path)).collect())
    assert rows("gloss_audit") == [(2, "α-gate", "阿门"), (3, "deep gate", "深门"), (4, "naïve map", "朴素图")]
    assert rows("gloss_upsert") == sorted([
        ("cs", "deep gate", "深门", "kept"), ("cs", "α-gate", " 阿门 ", "kept"), ("cs", "naïve map", "图", "changed"), ("cs", "big", "big", "kept"), ("cs", "Deep Gate", "深门", "added"), ("cs", "Big α-Gate", "大阀", "added"),
        ("cs", "deep gates", "别", "added"),
    ])
    assert [(i, o) for i, _, o in rows("unit_cache_join")] == [(1, "hit"), (2, "missing"), (3, "missing"), (4, "missing"), (9, "hit")]


def test_untranslated_however_written(spark, tmp_path):
    prose = "The weights of the network and the rate of the step are set by hand in this part of the work"
    said = ["zh", "ZH", " zh ", "zh-CN", "zh_Hans_CN", "zho", "chi", "Chinese", "Chinese (Simplified)", "简体中文", "中文（简体）", "zh.UTF-8", "Simplified Chinese"]
    other = ["en", "eng", "EN", "mix", None, "", "zha", "de", "fr-CN", "-zh", "zhx-CN"]
    put(spark, tmp_path, "documents", [(i, prose, lang) for i, lang in enumerate(said + other)] + [(99, "中文文本在此处，共有十个字以上。" + prose, "zh-CN"), (98, "short", "zh")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in CORE.queries["untranslated_detect"](spark, str(tmp_path)).collect()) == list(range(len(said)))


def test_redaction_of_whole_texts_and_capped_errors(spark, tmp_path):
    long = "word " * 200 + "see /srv/data/x and 10.0.0.1:80 with token=abc"
    put(spark, tmp_path, "documents", [(1, long), (2, None)], "doc_id long, text string")
    put(spark, tmp_path, "papers", [("p", long), ("q", "failed at /srv/x"), ("r", None)], "id string, translation_error string")
    put(spark, tmp_path, "translation_jobs", [("j", "host 10.0.0.1 down")], "id string, error string")
    assert [tuple(r) for r in CORE.queries["txt_redact"](spark, str(tmp_path)).collect()] == [(1, "word " * 200 + "see [path] and [ip] with token=[redacted]", 3)]
    assert sorted(tuple(r) for r in CORE.queries["error_redact"](spark, str(tmp_path)).collect()) == [
        ("job", "j", "host [ip] down", 1), ("paper", "p", "word " * 40 + "...", 0), ("paper", "q", "failed at [path]", 1),
    ]
