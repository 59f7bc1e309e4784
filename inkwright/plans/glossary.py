"""Queries over the glossary, record payloads and paper titles."""

from pyspark.sql import functions as F

from inkwright.functions.text import CJK, strip
from inkwright.operators import glossary as G
from inkwright.operators.library import first_per_key
from inkwright.operators.records import STRIP_SQL, VALUES_SQL, record_values
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

FLAT = """select lower(en) as en, arg_max(coalesce(zh, ''), (file_ord, field_ord, term_ord, term_id)) as zh,
  arg_min(term_id, (file_ord, field_ord, term_ord, term_id)) as first_id from corpus where en is not null group by 1"""
KEY = "trim(regexp_replace(lower(replace({}, '-', ' ')), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"
BOUND = "regexp_matches(low, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(en) || '(e?s)?([^\\p{L}\\p{N}_]|$)')"
PLACED = """t as materialized (select lower(en) as en, arg_max(coalesce(zh, ''), (file_ord, field_ord, term_ord, term_id)) as zh, min((file_ord, field_ord, term_ord, term_id)) as place from corpus where en is not null group by 1 having regexp_matches(lower(en), '[^\\s\\p{Z}]'))"""
MET = "m as materialized (select p.term_id, p.low, t.* from (select term_id, lower(en) as low from corpus where en is not null) p join t on contains(p.low, t.en))"


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "corpus")


@CORE.query("gloss_flatten", f"select en, zh, first_id, cast(length(en) as int) as n_chars from ({FLAT})")
def gloss_flatten(spark, sf_dir):
    return G.flat_terms(corpus(spark, sf_dir))


@CORE.query("gloss_longest", f"select en, zh, cast(length(en) as int) as n_chars from ({FLAT}) order by length(en) desc, first_id limit 50")
def gloss_longest(spark, sf_dir):
    """The first 50 terms in the order in which they are tried."""
    return G.flat_terms(corpus(spark, sf_dir)).orderBy(F.desc("n_chars"), "first_id").limit(50).select("en", "zh", "n_chars")


@CORE.query("gloss_stats", """
select coalesce(field, '_total') as field, count(*) as terms from (select distinct field, en from corpus where en is not null and field is not null) group by rollup(field)""")
def gloss_stats(spark, sf_dir):
    return G.stats(corpus(spark, sf_dir))


@CORE.query("gloss_conflicts", """
select lower(en) as term, count(distinct zh) as translations, arg_max(zh, (file_ord, field_ord, term_ord, term_id)) as effective
from (select trim(en) as en, trim(zh) as zh, file_ord, field_ord, term_ord, term_id from corpus) where en <> '' and zh <> '' group by 1 having count(distinct zh) > 1""")
def gloss_conflicts(spark, sf_dir):
    return G.conflicts(corpus(spark, sf_dir))


@CORE.query("gloss_lint", """
with c as (select field, trim(coalesce(en, '')) as en, trim(coalesce(zh, '')) as zh from corpus)
select field, count(*) as terms, count(*) filter (en = '' or zh = '') as blank, count(*) filter (en <> '' and zh <> '' and lower(en) = lower(zh)) as untranslated from c group by 1""")
def gloss_lint(spark, sf_dir):
    return G.lint_counts(corpus(spark, sf_dir))


# Fields whose health is shown.
WANTED = ["neurips_icml_iclr", "neurips_foundations_theory", "cvpr_computer_vision", "cvpr_detection_segmentation", "acl_nlp", "agents_alignment_safety"]


@CORE.query("gloss_health", f"""
select w.field, count(distinct c.en) as terms from (select unnest({WANTED}) as field) w left join corpus c on c.field = w.field group by 1""")
def gloss_health(spark, sf_dir):
    """Terms of the wanted fields; a field without any counts zero."""
    w = F.broadcast(spark.createDataFrame([(f,) for f in WANTED], "field string"))
    n = corpus(spark, sf_dir).where(F.col("field").isin(WANTED)).groupBy("field").agg(F.countDistinct("en").alias("n"))
    return w.join(n, "field", "left").select("field", F.coalesce("n", F.lit(0)).cast("long").alias("terms"))


@CORE.query("gloss_match", f"with {PLACED}, {MET} select distinct term_id, en, zh from m where {BOUND}")
def gloss_match(spark, sf_dir):
    """Every effective term inside the terms of the glossary's rows, themselves included."""
    return G.match_glossary(corpus(spark, sf_dir)).select("term_id", "en", "zh")


@CORE.query("gloss_match_top", f"""with {PLACED}, {MET}, d as (select distinct term_id, en, place from m where {BOUND})
select term_id, en, cast(rank as int) as rank from (select *, row_number() over (partition by term_id order by length(en) desc, place) as rank from d) where rank <= {G.RELEVANT}""")
def gloss_match_top(spark, sf_dir):
    """The terms of each text for a prompt: the longest, ties by their place in the glossary, as many as a prompt takes."""
    met = G.match_glossary(corpus(spark, sf_dir), cols=("place",))
    return first_per_key(met, ["term_id"], [F.desc(F.length("en")), F.asc("place")], G.RELEVANT).select("term_id", "en", "rank")


@CORE.query("gloss_audit", f"""with {VALUES_SQL}, {PLACED}, x as (select en, {STRIP_SQL.format('zh')} as expected from t where regexp_matches(zh, '{CJK}')),
m as materialized (select rec.record_id, lower(rec.en) as low, rec.zh, x.en, expected from rec join x on contains(lower(rec.en), x.en)) select distinct record_id, en, expected from m where {BOUND} and not contains(zh, expected)""")
def gloss_audit(spark, sf_dir):
    """Records of every layout whose source holds a term and whose translation lacks the standard form."""
    r = record_values(table(spark, sf_dir, "term_records", "record_id", "payload"), "record_id").withColumnRenamed("zh", "said")
    met = G.match_glossary(corpus(spark, sf_dir), r, "record_id", keep=("said",)).withColumn("expected", strip(F.col("zh"))).where(F.col("expected").rlike(CJK))
    return met.where(~F.col("said").contains(F.col("expected"))).select("record_id", "en", "expected")


# the same candidates in an engine that can't look around: each run of word characters gets a mark at both ends, and the forms ask
# for the marks where they ask for a boundary
WORD_MARKS = "regexp_replace(text, '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g')"
MARKED_FORMS = "\\x01(?:[A-Z][A-Za-z]+(?:\\x02[- ]\\x01[A-Z][A-Za-z]+){1,4}|[A-Z]{2,}(?:\\x02[- ]\\x01[A-Za-z0-9]+){0,4}|[A-Za-z]+(?:\\x02-\\x01[A-Za-z]+){1,4})\\x02"
COMMON = ", ".join(f"'{w}'" for w in G.COMMON)
MARKED = " or ".join(f"contains(lower(raw), '{w}')" for w in G.ACADEMIC)
CAND = f"""
with f as (select doc_id, replace(replace(unnest(m), chr(1), ''), chr(2), '') as raw, generate_subscripts(m, 1) as pos from (select doc_id, regexp_extract_all({WORD_MARKS}, '{MARKED_FORMS}') as m from documents where text is not null)),
k as (select *, {KEY.format('raw')} as term_key from f),
g as (select term_key, arg_min(raw, (doc_id, pos)) as term, count(*) as n, count(distinct doc_id) as texts from k
  where length(term_key) >= 4 and term_key not in ({COMMON}) and (regexp_matches(raw, '[A-Z]') or (contains(raw, '-') and ({MARKED}))) group by 1),
c as (select * from g where term_key not in (select {KEY.format('en')} from corpus where en is not null))"""


def mined(spark, sf_dir):
    return G.candidates(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", corpus(spark, sf_dir).where("en is not null"))


def most_frequent(candidates):
    return candidates.select("term_key", "n").orderBy(F.desc("n"), "term_key").limit(100)


def with_field(candidates):
    field, confidence = G.suggested(F.col("term_key"))
    return candidates.select("term_key", field.alias("field"), confidence.alias("confidence"))


@CORE.query("cand_extract", f"{CAND} select term_key, term, n, texts from c")
def cand_extract(spark, sf_dir):
    """The candidates of all texts."""
    return mined(spark, sf_dir)


@CORE.query("cand_top", f"{CAND} select term_key, n from c order by n desc, term_key limit 100")
def cand_top(spark, sf_dir):
    """The 100 most frequent candidates of all texts."""
    return most_frequent(mined(spark, sf_dir))


HITS = [" + ".join(f"cast(contains(term_key, '{w}') as int)" for w in ws) for _, ws in G.FIELD_KEYWORDS]
BEST = "greatest(" + ", ".join(f"({h})" for h in HITS) + ")"
FIELD = "case when best = 0 then '" + G.BROAD_FIELD + "' " + " ".join(f"when ({h}) = best then '{f}'" for (f, _), h in zip(G.FIELD_KEYWORDS, HITS)) + " end"


@CORE.query("cand_field", f"{CAND}, b as (select *, {BEST} as best from c) select term_key, {FIELD} as field, case when best = 0 then 0.35::double else least(0.95::double, 0.52::double + best * 0.12::double) end as confidence from b")
def cand_field(spark, sf_dir):
    """The field that the words of each candidate of all texts suggest."""
    return with_field(mined(spark, sf_dir))


def by_field(spark, sf_dir):
    c = corpus(spark, sf_dir).where("en is not null and field is not null")
    o = F.struct("file_ord", "term_ord", "term_id")
    return c.groupBy("field", "en").agg(F.max(F.struct(o.alias("o"), F.coalesce("zh", F.lit("")).alias("zh")))["zh"].alias("zh")).withColumn("present", F.lit(True))


@CORE.query("gloss_upsert", f"""with {VALUES_SQL}, o as (select field, en, arg_max(coalesce(zh, ''), (file_ord, term_ord, term_id)) as zh, true as present from corpus where en is not null and field is not null group by 1, 2),
r as (select regexp_extract(field, '[^.]+$') as field, trim(en, ' ') as en, trim(zh, ' ') as zh from rec), n as (select field, en, max(zh) as new_zh from r where field <> '' and en <> '' and zh <> '' group by 1, 2)
select coalesce(o.field, n.field) as field, coalesce(o.en, n.en) as en, coalesce(new_zh, zh) as zh, case when new_zh is null or zh = new_zh then 'kept' when present is null then 'added' else 'changed' end as change from o full join n on o.field = n.field and o.en = n.en""")
def gloss_upsert(spark, sf_dir):
    """The records of every layout, as approved terms, put into the glossary."""
    new = record_values(table(spark, sf_dir, "term_records", "payload")).withColumn("field", F.regexp_extract("field", "[^.]+$", 0))
    return G.upsert(by_field(spark, sf_dir), new.where("field <> ''"))
