"""A layered glossary: effective terms, lint, matching in texts, audit of translations, mining of candidates.

Rows of a glossary have an order (file, field, term). Where a term is defined more than once, its place is that of the
first definition and its value that of the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwright.functions.text import word_key
from inkwright.operators.scale import small, stage

ORDER = ["file_ord", "field_ord", "term_ord", "term_id"]
#: Terms up to this count are broadcast; more are joined by a shuffle.
FEW_TERMS = 100_000
#: The characters of words, in any script and in ASCII.
WORD, ASCII_WORD = r"\p{L}\p{N}_", "A-Za-z0-9_"
#: What a term that isn't blank has.
SAYING = r"[^\s\p{Z}]"
#: Terms and texts meet on runs of up to this many words.
KEY_WORDS = 8
#: Keys of terms up to this count are broadcast, of about 80 bytes each.
MANY_KEYS = 2_000_000
#: A prompt takes this many terms.
RELEVANT = 50

# What a candidate term looks like, words that are none, and markers of academic terms.
FORMS = r"(?:[A-Z][A-Za-z]+(?:[- ][A-Z][A-Za-z]+){1,4}|[A-Z]{2,}(?:[- ][A-Za-z0-9]+){0,4}|[A-Za-z]+(?:-[A-Za-z]+){1,4})"
CANDIDATE = rf"\b{FORMS}\b"
#: The same between any characters that are no letters, digits or underscores; \b knows ASCII ones only.
CANDIDATE_ANYWHERE = rf"(?<![{WORD}]){FORMS}(?![{WORD}])"
COMMON = "abstract introduction related work experiment experiments conclusion appendix figure table algorithm theorem proof this paper our method".split()
ACADEMIC = "learning optimization alignment transformer retrieval diffusion reasoning representation preference context multimodal vision language".split()
# Fields and the keywords that suggest them, in order; the field for no keyword.
FIELD_KEYWORDS = [
    ("cvpr_detection_segmentation", ["detection", "segmentation", "object", "instance", "mask", "bounding box", "recognition"]),
    ("cvpr_3d_geometry_reconstruction", ["3d", "geometry", "reconstruction", "nerf", "point cloud", "pose", "depth", "surface"]),
    ("cvpr_video_embodied_vision", ["video", "tracking", "embodied", "action", "temporal", "robot", "scene"]),
    ("acl_machine_translation_generation", ["translation", "generation", "summarization", "decoding", "preference", "faithfulness"]),
    ("acl_information_extraction_retrieval", ["retrieval", "reranking", "extraction", "entity", "question answering", "knowledge graph"]),
    ("acl_dialogue_safety_evaluation", ["dialogue", "alignment", "safety", "toxicity", "evaluation", "instruction"]),
    ("neurips_rl_decision_making", ["reinforcement", "policy", "reward", "offline rl", "bandit", "decision"]),
    ("neurips_generative_multimodal", ["diffusion", "multimodal", "vision-language", "generative", "latent"]),
    ("icml_optimization_learning_theory", ["optimization", "generalization", "gradient", "convex", "learning theory", "convergence"]),
    ("icml_probabilistic_bayes", ["bayes", "probabilistic", "variational", "causal", "uncertainty", "posterior"]),
    ("iclr_representations_architectures", ["representation", "transformer", "attention", "architecture", "normalization", "adapter"]),
    ("ml_systems_data_scaling", ["serving", "throughput", "latency", "scaling", "distributed", "checkpoint", "pipeline"]),
    ("ai_agents_tool_use", ["agent", "tool", "planning", "workflow", "function calling", "environment"]),
    ("paper_layout_and_reporting", ["ablation", "appendix", "benchmark", "reproducibility", "statistical", "confidence interval"]),
]
BROAD_FIELD = "neurips_icml_iclr"


def placed_terms(corpus: DataFrame) -> DataFrame:
    """(en, zh, place): each term without case, its last value and the order of its first row."""
    o = F.struct(*ORDER)
    c = corpus.where("en is not null").select(F.lower("en").alias("en"), F.coalesce("zh", F.lit("")).alias("zh"), o.alias("o"))
    flat = c.groupBy("en").agg(F.max(F.struct("o", "zh")).alias("last"), F.min("o").alias("place"))
    return flat.select("en", F.col("last.zh").alias("zh"), "place")


def flat_terms(corpus: DataFrame) -> DataFrame:
    """(en, zh, first_id, n_chars): each term without case, its last value and its first row."""
    return placed_terms(corpus).select("en", "zh", F.col("place.term_id").alias("first_id"), F.length("en").alias("n_chars"))


def stats(corpus: DataFrame) -> DataFrame:
    """(field, terms): distinct terms of each field, and of all fields together as _total."""
    d = corpus.where("en is not null and field is not null").select("field", "en").distinct()
    return d.rollup("field").agg(F.count("*").alias("terms")).select(F.coalesce("field", F.lit("_total")).alias("field"), "terms")


def conflicts(corpus: DataFrame) -> DataFrame:
    """(term, translations, effective): terms with more than one translation; the last one is in effect. Blank terms and
    values take no part."""
    c = corpus.select(F.trim("en").alias("en"), F.trim("zh").alias("zh"), F.struct(*ORDER).alias("o")).where("en <> '' and zh <> ''")
    return c.groupBy(F.lower("en").alias("term")).agg(F.countDistinct("zh").alias("translations"), F.max(F.struct("o", "zh"))["zh"].alias("effective")).where("translations > 1")


def lint_counts(corpus: DataFrame) -> DataFrame:
    """By field: terms, blank ones, and ones left as they were."""
    en, zh = F.trim(F.coalesce("en", F.lit(""))), F.trim(F.coalesce("zh", F.lit("")))
    blank = (en == "") | (zh == "")
    return corpus.groupBy("field").agg(F.count("*").alias("terms"), F.count_if(blank).alias("blank"), F.count_if(~blank & (F.lower(en) == F.lower(zh))).alias("untranslated"))


def _runs(texts: DataFrame, word: str) -> DataFrame:
    """`texts` (with a column low) and: h and s, the hashes of the words of each, s without the ending of a simple plural (words
    may be alike in that without being plurals)."""
    cols = texts.columns
    k = texts.withColumn("ws", F.filter(F.split("low", f"[^{word}]+"), lambda x: x != ""))
    return k.select(*cols, F.transform("ws", lambda w: F.xxhash64(w)).alias("h"), F.transform("ws", lambda w: F.xxhash64(F.rtrim(w, F.lit("es")))).alias("s"))


def _keys(runs: DataFrame, word: str) -> tuple[DataFrame, list[Column]]:
    """`runs` (with i, a place in h), and the keys of the runs of 1 to KEY_WORDS words from there, then that of more words; null
    beyond the end. The last word of a run may stand in the plural, but not where more words follow. A key has what the run
    begins with in its upper half: the first two words, but never the last of several."""
    at = lambda a, n: F.get(a, F.col("i") + (n - 1))
    key = lambda n, begin, run: F.when(F.col("i") + n <= F.size("h"), F.shiftleft(F.hash(F.lit(n), begin).cast("long"), 32).bitwiseOR(run.bitwiseAND(F.lit(0xFFFFFFFF))))
    runs = runs.withColumn("p1", at("h", 1))
    for n in range(2, KEY_WORDS + 1):
        runs = runs.withColumn(f"p{n}", F.xxhash64(f"p{n - 1}", at("h", n)))
    longer = [key(n, F.col(f"p{min(n - 1, 2)}"), F.xxhash64(f"p{n - 1}", at("s", n))) for n in range(2, KEY_WORDS + 1)]
    return runs, [key(1, at("s", 1), at("s", 1)), *longer, key(KEY_WORDS + 1, F.col("p2"), F.col(f"p{KEY_WORDS}"))]


def _sign(word: str) -> str:
    return f"([^{word}\\s\\p{{Z}}])"


def with_key(terms: DataFrame, word: str = WORD) -> DataFrame:
    """`terms` and the key on which each meets texts: all its words (of one with more than KEY_WORDS, the first ones); of a term
    without any word, its first sign. Filter what isn't SAYING before: a filter by the key computes it again."""
    runs, keys = _keys(_runs(terms.withColumn("low", F.lower("en")), word).withColumn("i", F.lit(0)), word)
    sign = F.regexp_extract("low", _sign(word), 1)
    n = F.least(F.size("h"), F.lit(KEY_WORDS + 1))
    return runs.select(*terms.columns, F.when(n > 0, F.get(F.array(*keys), n - 1)).when(sign != "", F.xxhash64(sign)).alias("key"))


def with_keys(texts: DataFrame, word: str = WORD) -> DataFrame:
    """`texts` (with a column low) and the keys of terms that each may hold, a row for each. Repeated words repeat their keys."""
    cols = texts.columns
    # one row for each word: what is done for columns of rows is compiled, what is done inside arrays isn't
    runs, keys = _keys(_runs(texts, word).select(*cols, "h", "s", F.posexplode_outer("h").alias("i", "_h")).drop("_h"), word)
    signs = F.transform(F.array_distinct(F.regexp_extract_all("low", F.lit(_sign(word)), F.lit(1))), lambda x: F.xxhash64(x))
    found = F.when(F.col("i").isNull(), signs).when(F.col("i") == 0, F.concat(F.array(*keys), signs)).otherwise(F.array(*keys))
    # explode would compute it all once more, to look for empty arrays
    return runs.select(*cols, F.explode_outer(found).alias("key")).where("key is not null")


def pieces(low: Column, longest: int) -> Column:
    """The pieces of a text, which overlap so that one of them has all of each place that holds a term of up to `longest`
    characters. A cut shows as a sign of words, so that no term ends there."""
    size = max(256, 4 * longest)
    n = F.length(low)
    last = F.floor((n - 1) / size).cast("int")

    def piece(k: Column) -> Column:
        end = (k + 1) * size + longest + 4
        return F.concat(F.when(k > 0, "_").otherwise(""), F.substring(low, k * size + 1, F.lit(size + longest + 4)), F.when(end < n, "_").otherwise(""))

    return F.when(n <= size, F.array(low)).otherwise(F.transform(F.sequence(F.lit(0), last), piece))


def holding(pairs: DataFrame, word: str = WORD) -> DataFrame:
    """The rows whose text `low` holds the term `en` as whole words or a simple plural."""
    escaped = F.regexp_replace("en", r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    pattern = F.concat(F.lit(f"(?<![{word}])"), escaped, F.lit(f"(e?s)?(?![{word}])"))
    return pairs.where(F.col("low").contains(F.col("en"))).withColumn("pattern", pattern).where(F.expr("rlike(low, pattern)")).drop("pattern")


def match_terms(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, word: str = WORD, few: int = FEW_TERMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, and the columns of `terms`): terms that a text holds as whole words or a simple plural, case aside. Neither
    end of a term may touch another character of the class `word`. Any term that isn't blank counts, whatever its characters.
    `keep`: columns of the texts that come along.

    Texts and terms meet on all words of a term (of one with more than KEY_WORDS, on its first ones); the pattern then decides.
    So the pairs tried are about those that match, however many terms begin alike. A term without any word meets the texts that
    hold its first sign."""
    begin = lambda key: F.shiftright(key, 32)
    cols = terms.columns
    t = stage(with_key(terms.where(F.col("en").rlike(SAYING)), word), "terms")
    own = texts.select(id_col, F.lower(text_col).alias("low"), *keep).where("low is not null")
    keys = with_keys(own, word)
    held = small(t, few)
    if held is not t:
        met = keys.join(held, "key")
    else:  # many terms: only ids and keys meet in the shuffle, of keys that begin as a term does, and each text moves once
        begins = t.select(begin("key").alias("begin")).distinct()
        if (begun := small(begins, few)) is not begins:
            keys = keys.join(begun, begin("key") == F.col("begin"), "left_semi")
        met = keys.select(F.col(id_col).alias("_id"), "key").join(t.select(*cols, "key"), "key").select("_id", *cols)
        met = met.join(own, F.col("_id").eqNullSafe(F.col(id_col)))
    return holding(met, word).select(id_col, *cols, *keep).distinct()


def match_glossary(corpus: DataFrame, texts: DataFrame | None = None, id_col: str = "term_id", text_col: str = "en", cols: tuple[str, ...] = ("zh",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, en, cols..., keep...): as match_terms, of the texts, or else of the glossary's own rows, and en and `cols` of
    placed_terms.

    Where the terms are too many for a broadcast but their keys aren't, a text moves only with the keys that terms have, and
    rows of the glossary move once: as what defines a term, and as a text that holds it. One shuffle by key brings all together."""
    own = texts is None
    rows = corpus.where(F.col("en").rlike(SAYING)).select(F.col("term_id").alias("_id"), F.lower("en").alias("en"), F.coalesce("zh", F.lit("")).alias("zh"), F.struct(*ORDER).alias("o"))
    rows = with_key(rows).withColumnsRenamed({"en": "low", "key": "own"})
    keys = stage(rows.groupBy(F.col("own").alias("key")).agg(F.max(F.length("low")).alias("longest")), "keys")
    n, longest = keys.agg(F.count("*"), F.max("longest")).first()
    if n <= FEW_TERMS or n > MANY_KEYS:
        return match_terms(corpus if own else texts, id_col, text_col, placed_terms(corpus).select("en", *cols), keep=keep)
    known = F.broadcast(keys.select("key"))
    if own:
        defines = lambda c: F.when(F.col("key") == F.col("own"), F.col(c)).alias(c)
        met = with_keys(rows).join(known, "key", "left_semi").select("key", "_id", "low", defines("zh"), defines("o"), F.lit(True).alias("text"))
    else:
        said = texts.select(F.col(id_col).alias("_id"), F.explode(pieces(F.lower(text_col), longest)).alias("low"), *keep)
        said = with_keys(said).join(known, "key", "left_semi").withColumn("text", F.lit(True))
        met = said.unionByName(rows.select(F.col("own").alias("key"), "low", "zh", "o", F.lit(False).alias("text")), allowMissingColumns=True)
    met = met.repartition("key")
    alike, group = Window.partitionBy("key", "low"), Window.partitionBy("key")
    met = met.withColumn("last", F.max(F.when(F.col("o").isNotNull(), F.struct("o", "zh"))).over(alike)).withColumn("place", F.min("o").over(alike))
    values = {"zh": F.col("last.zh"), "place": F.col("place")}
    term = F.when(F.col("o").isNotNull(), F.struct(F.col("low").alias("en"), *(values[c].alias(c) for c in cols)))
    met = met.withColumn("terms", F.collect_set(term).over(group)).where("text")
    met = met.select("key", F.col("_id").alias(id_col), "low", *keep, F.inline("terms"))
    return holding(met).drop("low").distinct().select(id_col, "en", *cols, *keep)


def academic(raw: Column) -> Column:
    low = F.lower(raw)
    marked = F.lit(False)
    for m in ACADEMIC:
        marked = marked | low.contains(m)
    return raw.rlike(r"\p{Lu}") | (raw.contains("-") & marked)


def candidates(texts: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """(term_key, term, n, texts): terms that texts in any script hold and the glossary doesn't; the first spelling stays."""
    found = texts.select(F.col(id_col), F.posexplode(F.regexp_extract_all(text_col, F.lit(CANDIDATE_ANYWHERE), F.lit(0))).alias("pos", "raw"))
    found = found.withColumn("term_key", word_key(F.col("raw"))).where((F.length("term_key") >= 4) & ~F.col("term_key").isin(COMMON) & academic(F.col("raw")))
    grouped = found.groupBy("term_key").agg(F.min(F.struct(id_col, "pos", "raw"))["raw"].alias("term"), F.count("*").alias("n"), F.countDistinct(id_col).alias("texts"))
    return grouped.join(known.select(word_key(F.col("en")).alias("term_key")).distinct(), "term_key", "left_anti")


def suggested(key: Column) -> tuple[Column, Column]:
    """The field whose keywords a term holds most of (ties: the first), and the confidence."""
    hits = [sum((key.contains(w).cast("int") for w in words), F.lit(0)) for _, words in FIELD_KEYWORDS]
    best = F.greatest(*hits)
    field = F.when(best == 0, BROAD_FIELD)
    for (name, _), h in zip(FIELD_KEYWORDS, hits):
        field = field.when(h == best, name)
    return field, F.when(best == 0, 0.35).otherwise(F.least(F.lit(0.95), 0.52 + best * 0.12))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, en, zh, change): a glossary with approved terms put in; change is kept, added or changed."""
    n = new.select("field", F.trim("en").alias("en"), F.trim("zh").alias("zh")).where("en <> '' and zh <> ''").groupBy("field", "en").agg(F.max("zh").alias("new_zh"))
    both = old.join(n, ["field", "en"], "full")
    change = F.when(F.col("new_zh").isNull() | F.col("zh").eqNullSafe(F.col("new_zh")), "kept").when(~F.col("present").eqNullSafe(F.lit(True)), "added").otherwise("changed")
    return both.select("field", "en", F.coalesce("new_zh", "zh").alias("zh"), change.alias("change"))
