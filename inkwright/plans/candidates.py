"""Candidate terms from their observations to the released glossary. Payloads of term_records stand for lines of files: those in
JSON are observations, the others malformed lines; file_name is the source, record_id the line's place."""

from pyspark.sql import functions as F

from inkwright.functions.text import word_key
from inkwright.operators import glossary as G
from inkwright.operators.scale import scratch
from inkwright.plans.glossary import KEY, corpus
from inkwright.plans.registry import CORE
from inkwright.sources import files
from inkwright.sources.tables import table

LINES = """lines as (select record_id, batch_no, file_name, j from (select *, case when json_valid(payload) then payload end as j from term_records) where j is not null and json_type(j) = 'OBJECT'),
obs as (select record_id, batch_no, file_name, trim(json_extract_string(j, '$.en'), ' ') as en, trim(json_extract_string(j, '$.zh'), ' ') as zh, json_extract_string(j, '$.field') as field from lines)"""
SEEN = f"seen as (select *, {KEY.format('en')} as term_key from obs where en <> '')"
GROUPS = f"""{LINES}, {SEEN}, src as (select term_key, file_name, min(record_id) as p from seen where file_name <> '' group by 1, 2),
srcs as (select term_key, string_agg(file_name, ',' order by p) as sources from src group by 1),
g as (select term_key, arg_min(en, record_id) as term, count(*) as n from seen group by 1), groups as (select g.term_key, term, n, coalesce(sources, '') as sources from g left join srcs using (term_key))"""
O = "(file_ord, field_ord, term_ord, term_id)"
KNOWN = f"known as (select {KEY.format('en')} as term_key, arg_max(field, {O}) as known_field, arg_max(en, {O}) as known_term, arg_max(coalesce(zh, ''), {O}) as known_zh from corpus where en is not null and field is not null group by 1)"
HITS = ", ".join("(" + " + ".join(f"(case when contains(term_key, '{w}') then 1 else 0 end)" for w in ws) + f") as h{i}" for i, (_, ws) in enumerate(G.FIELD_KEYWORDS))
BEST = "greatest(" + ", ".join(f"h{i}" for i in range(len(G.FIELD_KEYWORDS))) + ")"
FIELD = f"case when best = 0 then '{G.BROAD_FIELD}' " + " ".join(f"when h{i} = best then '{f}'" for i, (f, _) in enumerate(G.FIELD_KEYWORDS)) + " end"
AUDIT = f"""{GROUPS}, {KNOWN}, h as (select *, {HITS} from groups), b as (select *, {BEST} as best from h),
audit as (select b.term_key, term, n, sources, case when known_term is null then 'needs_translation' else 'known' end as status, known_field, known_term, known_zh, {FIELD} as suggested_field,
  case when best = 0 then 0.35::double else least(0.95::double, 0.52::double + best * 0.12::double) end as confidence from b left join known using (term_key))"""


def observations(spark, sf_dir):
    """(record_id, batch_no, file_name, en, zh, field) of the lines that hold a JSON object; outer blanks go."""
    lines = table(spark, sf_dir, "term_records", "record_id", "batch_no", "file_name", "payload")
    got = files.json_lines(lines, "payload", "en", "zh", "field")
    return got.withColumns({"en": F.trim("en"), "zh": F.trim("zh")})


def grouped(spark, sf_dir):
    """One row per term: first spelling, observations, distinct sources in the order in which they came."""
    seen = observations(spark, sf_dir).where("en <> ''").withColumn("term_key", word_key(F.col("en")))
    src = seen.groupBy("term_key", "file_name").agg(F.count("*").alias("n"), F.min("record_id").alias("p"), F.min(F.struct("record_id", "en")).alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("file_name") != "", F.struct("p", "file_name")))), lambda x: x["file_name"])
    return src.groupBy("term_key").agg(F.min("first")["en"].alias("term"), F.sum("n").alias("n"), F.array_join(names, ",").alias("sources"))


def audited(spark, sf_dir):
    """The groups with what the glossary knows of them and the field that their words suggest."""
    o = F.struct(*G.ORDER)
    c = corpus(spark, sf_dir).where("en is not null and field is not null")
    known = c.groupBy(word_key(F.col("en")).alias("term_key")).agg(F.max(F.struct(o.alias("o"), "field", "en", F.coalesce("zh", F.lit("")).alias("zh"))).alias("k"))
    known = known.select("term_key", F.col("k.field").alias("known_field"), F.col("k.en").alias("known_term"), F.col("k.zh").alias("known_zh"))
    field, confidence = G.suggested(F.col("term_key"))
    out = grouped(spark, sf_dir).join(known, "term_key", "left")
    return out.select("term_key", "term", "n", "sources", F.when(F.col("known_term").isNull(), "needs_translation").otherwise("known").alias("status"), "known_field", "known_term", "known_zh", field.alias("suggested_field"), confidence.alias("confidence"))


@CORE.query("jsonl_terms", f"with {LINES} select record_id, en, zh, field from obs")
def jsonl_terms(spark, sf_dir):
    """Lines that hold a JSON object; malformed lines and other values are passed over."""
    return observations(spark, sf_dir).select("record_id", "en", "zh", "field")


@CORE.query("cand_group", f"with {GROUPS} select * from groups")
def cand_group(spark, sf_dir):
    return grouped(spark, sf_dir)


@CORE.query("cand_audit_field", f"with {AUDIT} select * from audit")
def cand_audit_field(spark, sf_dir):
    """Each candidate as known, with its field, spelling and translation, or in need of a translation."""
    return audited(spark, sf_dir)


@CORE.query("cand_review", f"with {AUDIT} select count(*) as candidate_count, count(*) filter (status = 'known') as known_count, cast(sum(n) as bigint) as observations from audit")
def cand_review(spark, sf_dir):
    """The head of a review file."""
    return audited(spark, sf_dir).agg(F.count("*").alias("candidate_count"), F.count_if(F.col("status") == "known").alias("known_count"), F.sum("n").alias("observations"))


@CORE.query("cand_append", f"""with {LINES}, {SEEN}, k as (select term_key, min(batch_no) as batch_no, arg_min(en, (batch_no, record_id)) as term from seen group by 1)
select term_key, batch_no, term from k where batch_no > 0""")
def cand_append(spark, sf_dir):
    """What later batches add to a file that holds the first one: terms whose key no earlier line has."""
    seen = observations(spark, sf_dir).where("en <> ''").withColumn("term_key", word_key(F.col("en")))
    first = seen.groupBy("term_key").agg(F.min(F.struct("batch_no", "record_id", "en")).alias("x"))
    return first.select("term_key", "x.batch_no", F.col("x.en").alias("term")).where("batch_no > 0")


@CORE.query("cand_promote", f"""with {AUDIT}, approved as (select regexp_extract(field, '[^.]+$') as field, en, arg_max(zh, record_id) as zh from obs where en <> '' and zh <> '' and field is not null group by 1, 2),
a as (select coalesce(nullif(field, ''), suggested_field) as field, en, zh from approved join (select term_key, suggested_field from audit) s on s.term_key = {KEY.format('approved.en')}),
one as (select field, en, max(zh) as zh from a group by 1, 2), old as (select field, en, arg_max(coalesce(zh, ''), (file_ord, term_ord, term_id)) as old_zh from corpus where en is not null and field is not null group by 1, 2)
select field, count(*) as approved, count(*) filter (zh is distinct from old_zh) as changed from one left join old using (field, en) group by 1""")
def cand_promote(spark, sf_dir):
    """Reviewed terms put into the glossary, field by field: how many, and how many change it. A line's last translation is the
    approved one; a line without a field goes to the suggested one."""
    obs = observations(spark, sf_dir).where("en <> '' and zh <> '' and field is not null")
    last = obs.groupBy(F.regexp_extract("field", "[^.]+$", 0).alias("field"), "en").agg(F.max(F.struct("record_id", "zh"))["zh"].alias("zh"))
    field, _ = G.suggested(word_key(F.col("en")))
    one = last.select(F.coalesce(F.nullif("field", F.lit("")), field).alias("field"), "en", "zh").groupBy("field", "en").agg(F.max("zh").alias("zh"))
    c = corpus(spark, sf_dir).where("en is not null and field is not null")
    old = c.groupBy("field", "en").agg(F.max(F.struct("file_ord", "term_ord", "term_id", F.coalesce("zh", F.lit("")).alias("zh")))["zh"].alias("old_zh"))
    return one.join(old, ["field", "en"], "left").groupBy("field").agg(F.count("*").alias("approved"), F.count_if(~F.col("zh").eqNullSafe(F.col("old_zh"))).alias("changed"))


#: The clock of releases and logs; a parameter of what uses it.
NOW = "2026-06-01 12:34:56"


@CORE.query("gloss_release", f"""select '1.0' as version, strftime(timestamp '{NOW}', '%Y-%m-%dT%H:%M:%SZ') as released_at, count(*) as total_terms
from (select distinct field, en from corpus where en is not null and field is not null and not starts_with(field, '_'))""")
def gloss_release(spark, sf_dir, version="1.0", now=NOW):
    """The stamp of a release: version, time in whole seconds, and the number of terms without metadata."""
    terms = corpus(spark, sf_dir).where("en is not null and field is not null and not startswith(field, '_')").select("field", "en").distinct()
    return terms.agg(F.count("*").alias("total_terms")).select(F.lit(version).alias("version"), F.date_format(F.lit(now).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("released_at"), "total_terms")


@CORE.query("gloss_layers", f"""with l as (select file_ord, file_name, field, en, arg_max(coalesce(zh, ''), (field_ord, term_ord, term_id)) as zh from corpus where en is not null and field is not null and file_name is not null group by 1, 2, 3, 4)
select field, en, arg_max(zh, (file_ord, file_name)) as zh, count(*) as layers from l group by 1, 2""")
def gloss_layers(spark, sf_dir):
    """The dictionary written as layers of JSON files and read back: a later layer overrides an earlier one field by field."""
    c = corpus(spark, sf_dir).where("en is not null and field is not null and file_name is not null")
    layer = F.format_string("%05d-%s", "file_ord", "file_name")
    one = c.groupBy(layer.alias("layer"), "field", "en").agg(F.max(F.struct("field_ord", "term_ord", "term_id", F.coalesce("zh", F.lit("")).alias("zh")))["zh"].alias("zh"))
    at = scratch(spark, "layers")
    files.write_layers(one, at)
    back = files.read_layers(spark, at)
    return back.groupBy("field", "en").agg(F.max(F.struct("layer", "zh"))["zh"].alias("zh"), F.count("*").alias("layers"))


@CORE.query("cache_lines", f"""with {LINES} select sha256(en) as key, arg_max(zh, record_id) as zh, count(*) as lines from obs where en <> '' and zh <> '' group by 1""")
def cache_lines(spark, sf_dir):
    """A cache in JSON lines: of each key the last valid line counts; malformed lines are passed over."""
    obs = observations(spark, sf_dir).where("en <> '' and zh <> ''")
    return obs.groupBy(F.sha2("en", 256).alias("key")).agg(F.max(F.struct("record_id", "zh"))["zh"].alias("zh"), F.count("*").alias("lines"))


PLAIN = "regexp_replace(title, '[^ -~]', ' ', 'g')"
MOST = 100


@CORE.query("cand_early_stop", f"""with m as (select id, unnest(regexp_extract_all({PLAIN}, '{G.CANDIDATE}')) as raw, generate_subscripts(regexp_extract_all({PLAIN}, '{G.CANDIDATE}'), 1) as pos from papers where title is not null),
k as (select *, {KEY.format('raw')} as term_key from m), f as (select term_key, arg_min(raw, (id, pos)) as term, min((id, pos)) as p from k
where length(term_key) >= 4 and term_key not in ({", ".join(f"'{w}'" for w in G.COMMON)}) and (regexp_matches(raw, '[A-Z]') or (contains(raw, '-') and ({" or ".join(f"contains(lower(raw), '{w}')" for w in G.ACADEMIC)})))
and term_key not in (select {KEY.format('en')} from corpus where en is not null) group by 1) select term_key, term from (select *, row_number() over (order by p) as r from f) where r <= {MOST}""")
def cand_early_stop(spark, sf_dir, max_terms=MOST):
    """The first `max_terms` new candidates in the order of the titles, non-ASCII characters taken as blanks. Every title is read:
    which keys come first is known after the smallest place of each, and only `max_terms` rows are then sorted per task."""
    texts = table(spark, sf_dir, "papers", "id", "title").where("title is not null").select("id", F.regexp_replace("title", "[^ -~]", " ").alias("title"))
    found = texts.select("id", F.posexplode(F.regexp_extract_all("title", F.lit(G.CANDIDATE), F.lit(0))).alias("pos", "raw")).withColumn("term_key", word_key(F.col("raw")))
    found = found.where((F.length("term_key") >= 4) & ~F.col("term_key").isin(G.COMMON) & G.academic(F.col("raw")))
    first = found.groupBy("term_key").agg(F.min(F.struct("id", "pos", "raw")).alias("x"))
    known = corpus(spark, sf_dir).where("en is not null").select(word_key(F.col("en")).alias("term_key")).distinct()
    return first.join(known, "term_key", "left_anti").orderBy("x").limit(max_terms).select("term_key", F.col("x.raw").alias("term"))
