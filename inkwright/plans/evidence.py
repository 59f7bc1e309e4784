"""Queries over rounds of an evaluation: reports with the provenance of what they judge. Reports come from the issues of
plans.quality; jobs stand for the runs that made the translations, papers for the entries of a manifest."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwright.operators import quality as Q
from inkwright.operators.library import first_per_key
from inkwright.plans.quality import DOC, ISSUES, REPORTS, SCORES, VIS, issues, reports
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

PAPER = "split_part(doc, '-', 1) as paper, case when split_part(doc, '-', 2) < '20240116' then 'base' else 'now' end as side"


def sides(df):
    return df.withColumns({"paper": F.split_part("doc", F.lit("-"), F.lit(1)), "side": F.when(F.split_part("doc", F.lit("-"), F.lit(2)) < "20240116", "base").otherwise("now")})


@CORE.query("eval_code_totals", f"""with {ISSUES}, p as (select *, {PAPER} from issues), two as (select paper from p group by 1 having count(distinct side) = 2)
select side, code, count(*) as issues, count(distinct paper) as papers from p join two using (paper) group by 1, 2""")
def eval_code_totals(spark, sf_dir):
    """Issues by code in the base round and now, over the papers of both."""
    n = sides(issues(spark, sf_dir)).groupBy("paper", "side", "code").agg(F.count("*").alias("n"))
    both = n.groupBy("paper").agg(F.count_distinct("side").alias("k")).where("k = 2").select("paper")
    return n.join(both, "paper").groupBy("side", "code").agg(F.sum("n").alias("issues"), F.count("*").alias("papers"))


@CORE.query("qa_pass_summary", f"""with {ISSUES} select doc, count(*) as issue_count, count(*) filter (severity = 'error') as error_count, count(*) filter (severity <> 'error') as warning_count, list_sort(list(distinct code))[1:12] as codes from issues group by 1""")
def qa_pass_summary(spark, sf_dir):
    """One pass of checks: how many issues, and at most twelve of their codes."""
    error = F.col("severity") == "error"
    return issues(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("issue_count"), F.count_if(error).alias("error_count"), F.count_if(~error).alias("warning_count"), F.slice(F.array_sort(F.collect_set("code")), 1, 12).alias("codes"))


@CORE.query("preview_pages", f"""with {ISSUES}, e as (select doc, list_sort(list(distinct page) filter (severity = 'error' and page > 0)) as pages from issues group by 1),
u as (select doc, unnest([1, 2] || coalesce(pages, [])) as page, generate_subscripts([1, 2] || coalesce(pages, []), 1) as i from e), d as (select doc, page, min(i) as i from u group by 1, 2)
select doc, list(page order by i)[1:6] as pages from d group by 1""")
def preview_pages(spark, sf_dir):
    """The pages shown of a document: the first two and those with errors, each once, at most six."""
    pages = F.array_sort(F.collect_set(F.when((F.col("severity") == "error") & (F.col("page") > 0), F.col("page"))))
    return issues(spark, sf_dir).groupBy("doc").agg(F.slice(F.array_distinct(F.concat(F.array(F.lit(1), F.lit(2)), pages)), 1, 6).alias("pages"))


@CORE.query("eval_profiles", f"""with {ISSUES}, {SCORES}, {VIS}, {REPORTS}, p as (select *, case when visual >= 0.7 then 'dense' when visual >= 0.5 then 'plain' else 'sparse' end as profile, 0.3 + (cast(split_part(doc, '-', 1) as bigint) % 5) / 10.0 as least_score from reports)
select profile, count(*) as cases, count(*) filter (issues = 0) as clean, count(*) filter (issues <= 1 and visual >= least_score) as passed, count(*) >= 20 and count(*) filter (issues > 1 or visual < least_score) = 0 as ready from p group by 1""")
def eval_profiles(spark, sf_dir):
    """Cases by profile; a case passes with at most one issue of any severity and the score that it asks for."""
    r = reports(spark, sf_dir)
    profile = F.when(F.col("visual") >= 0.7, "dense").when(F.col("visual") >= 0.5, "plain").otherwise("sparse")
    wanted = 0.3 + (F.split_part("doc", F.lit("-"), F.lit(1)).cast("long") % 5) / 10.0
    good = (F.col("issues") <= 1) & (F.col("visual") >= wanted)
    return r.groupBy(profile.alias("profile")).agg(F.count("*").alias("cases"), F.count_if(F.col("issues") == 0).alias("clean"), F.count_if(good).alias("passed"), ((F.count("*") >= 20) & (F.count_if(~good) == 0)).alias("ready"))


@CORE.query("showcase_totals", f"""with {ISSUES}, {SCORES}, h as (select {PAPER}, errors from scores), s as (select paper, coalesce(sum(errors) filter (side = 'base'), 0) as before, coalesce(sum(errors) filter (side = 'now'), 0) as after, count(distinct side) as k from h group by 1),
t as (select count(*) as papers, cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after, count(*) filter (after = 0) as clean from s where k = 2)
select papers, before, after, clean, case when before = 0 then null else cast(floor((1 - after / before) * 100 + 0.5) as bigint) end as drop_percent from t""")
def showcase_totals(spark, sf_dir):
    """Errors before and after over the papers of both rounds, and by how many percent they fell, halves rounded up."""
    s = sides(Q.scores(issues(spark, sf_dir), ["doc"])).groupBy("paper").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "base", F.col("errors"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(F.col("side") == "now", F.col("errors"))), F.lit(0)).alias("after"), F.count_distinct("side").alias("k")
    ).where("k = 2")
    t = s.agg(F.count("*").alias("papers"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.count_if(F.col("after") == 0).alias("clean"))
    return t.withColumn("drop_percent", F.when(F.col("before") != 0, F.floor((1 - F.col("after") / F.col("before")) * 100 + 0.5)))


RUNS = """runs as (select id, paper_id, created_at, finished_at, engine_revision as engine, backend as model, quality, coalesce(qa_mode, 'off') as qa, coalesce(last_issue_fingerprint, '') as print, case when progress >= 1 then 3 when progress > 0.5 then 2 else 1 end as schema_version
  from (select *, row_number() over (partition by id order by updated_at desc nulls last, status, progress, attempt_count, finished_at, heartbeat_at, started_at, error, created_at) as r from translation_jobs where id is not null and paper_id is not null) where r = 1)"""


def runs(spark, sf_dir):
    """The last state of each job as the run behind a report."""
    j = table(spark, sf_dir, "translation_jobs").where("id is not null and paper_id is not null")
    order = [F.desc_nulls_last("updated_at"), *(F.asc_nulls_last(c) for c in ("status", "progress", "attempt_count", "finished_at", "heartbeat_at", "started_at", "error", "created_at"))]
    one = first_per_key(j, ["id"], order, 1)
    version = F.when(F.col("progress") >= 1, 3).when(F.col("progress") > 0.5, 2).otherwise(1)
    return one.select("id", "paper_id", "created_at", "finished_at", F.col("engine_revision").alias("engine"), F.col("backend").alias("model"), "quality", F.coalesce("qa_mode", F.lit("off")).alias("qa"), F.coalesce("last_issue_fingerprint", F.lit("")).alias("print"), version.alias("schema_version"))


LAST = "last as (select paper_id, max(struct_pack(c := created_at, id := id)) as m from runs where created_at is not null group by 1), newest as (select r.* from runs r join last l on l.m.id = r.id and l.paper_id = r.paper_id)"


def newest(df):
    """The newest run of each paper."""
    return first_per_key(df.where("created_at is not null"), ["paper_id"], [F.desc("created_at"), F.desc("id")], 1)


@CORE.query("run_provenance", f"""with {RUNS}, {LAST} select p.id, case when n.schema_version >= 2 and n.print <> '' then coalesce(nullif(n.engine, ''), 'unknown') else 'unknown' end as engine, case when n.schema_version >= 2 and n.print <> '' then coalesce(nullif(n.model, ''), 'unknown') else 'unknown' end as model,
case when n.schema_version = 3 and n.print <> '' then n.quality || '/' || n.qa end as config from papers p left join newest n on n.paper_id = p.id""")
def run_provenance(spark, sf_dir):
    """What made each paper's translation: unknown where no run of a known schema vouches for it."""
    n = newest(runs(spark, sf_dir)).withColumnRenamed("id", "run_id")
    p = table(spark, sf_dir, "papers", "id").join(n, F.col("id") == F.col("paper_id"), "left")
    vouched = F.coalesce((F.col("schema_version") >= 2) & (F.col("print") != ""), F.lit(False))
    said = lambda c: F.when(vouched, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))).otherwise("unknown").alias(c)
    return p.select("id", said("engine"), said("model"), F.when(vouched & (F.col("schema_version") == 3), F.concat_ws("/", "quality", "qa")).alias("config"))


COMMON = "common as (select m.engine as engine, m.model as model from (select max(struct_pack(n := n, engine := engine, model := model)) as m from (select engine, model, count(*) as n from newest where engine is not null and model is not null group by 1, 2)))"


@CORE.query("run_cache_valid", f"""with {RUNS}, {LAST}, {COMMON} select paper_id, schema_version in (2, 3) and print <> '' and coalesce(n.engine = c.engine, false) as valid, coalesce(n.engine = c.engine, false) and coalesce(n.model = c.model, false) as reusable from newest n, common c""")
def run_cache_valid(spark, sf_dir):
    """Whether a stored report still holds, and a stored translation: its schema, prints, engine and model are those of the most
    frequent engine and model."""
    n = newest(runs(spark, sf_dir))
    common = n.where("engine is not null and model is not null").groupBy("engine", "model").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "engine", "model")).alias("m")).select(F.col("m.engine").alias("e"), F.col("m.model").alias("o"))
    both = n.join(F.broadcast(common))  # one row
    same_engine, same_model = F.coalesce(F.col("engine") == F.col("e"), F.lit(False)), F.coalesce(F.col("model") == F.col("o"), F.lit(False))
    return both.select("paper_id", (F.col("schema_version").isin(2, 3) & (F.col("print") != "") & same_engine).alias("valid"), (same_engine & same_model).alias("reusable"))


@CORE.query("round_evidence", f"""with {RUNS}, {LAST}, {COMMON}, w as (select distinct paper_id from translation_jobs where paper_id is not null union select id from papers where translation_status = 'completed')
select 'engine differs' as rule, paper_id as subject from newest n, common c where n.engine is distinct from c.engine union all select 'model differs', paper_id from newest n, common c where n.model is distinct from c.model
union all select 'schema is not 3', paper_id from newest where schema_version <> 3 union all select 'completion time missing', paper_id from newest where finished_at is null
union all select 'no report', w.paper_id from w where w.paper_id not in (select paper_id from newest)
union all select 'report predates evaluation', strftime(max(finished_at), '%Y-%m-%d') from newest having max(finished_at) >= timestamp '2026-03-01'""")
def round_evidence(spark, sf_dir, generated="2026-03-01"):
    """Broken rules of a round: runs of another engine, model or schema, without a time of completion, papers without a report, and a
    summary that isn't later than every evaluation."""
    n = newest(runs(spark, sf_dir))
    common = n.where("engine is not null and model is not null").groupBy("engine", "model").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "engine", "model")).alias("m")).select(F.col("m.engine").alias("e"), F.col("m.model").alias("o"))
    both = n.join(F.broadcast(common))  # one row
    rules = F.array_compact(F.array(
        F.when(~F.col("engine").eqNullSafe(F.col("e")), "engine differs"), F.when(~F.col("model").eqNullSafe(F.col("o")), "model differs"),
        F.when(F.col("schema_version") != 3, "schema is not 3"), F.when(F.col("finished_at").isNull(), "completion time missing"),
    ))
    broken = both.select(F.explode(rules).alias("rule"), F.col("paper_id").alias("subject"))
    wanted = table(spark, sf_dir, "translation_jobs", "paper_id").where("paper_id is not null").union(table(spark, sf_dir, "papers", "id", "translation_status").where("translation_status = 'completed'").select("id")).distinct()
    absent = wanted.join(n.select("paper_id"), "paper_id", "left_anti").select(F.lit("no report").alias("rule"), F.col("paper_id").alias("subject"))
    late = n.agg(F.max("finished_at").alias("t")).where(F.col("t") >= F.lit(generated).cast("timestamp_ntz")).select(F.lit("report predates evaluation").alias("rule"), F.date_format("t", "yyyy-MM-dd").alias("subject"))
    return broken.unionByName(absent).unionByName(late)


@CORE.query("content_prints", """with f as (select paper_id, doc_id, coalesce(text, '') as text from documents where paper_id is not null)
select paper_id, count(*) as files, sha256(string_agg(doc_id || chr(0) || text || chr(0), '' order by doc_id)) as print, substr(sha256(string_agg(doc_id || case when text = '' then '<missing>' else text end, '' order by doc_id)), 1, 32) as revision from f group by 1""")
def content_prints(spark, sf_dir):
    """The print of a set of files: names and contents in order, ended by zeros; and the same with a mark for empty ones, cut to 32."""
    f = table(spark, sf_dir, "documents", "paper_id", "doc_id", "text").where("paper_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    xs = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    g = f.groupBy("paper_id").agg(F.count("*").alias("files"), xs.alias("xs"))
    zero, name = F.lit("\x00"), lambda x: x["doc_id"].cast("string")
    whole = F.array_join(F.transform("xs", lambda x: F.concat(name(x), zero, x["text"], zero)), "")
    marked = F.array_join(F.transform("xs", lambda x: F.concat(name(x), F.when(x["text"] == "", "<missing>").otherwise(x["text"]))), "")
    return g.select("paper_id", "files", F.sha2(whole, 256).alias("print"), F.substring(F.sha2(marked, 256), 1, 32).alias("revision"))


@CORE.query("cache_names", f"""with {RUNS} select coalesce(model, '') as model, coalesce(engine, '') as engine, substr(sha256(coalesce(model, '') || chr(0) || coalesce(engine, '')), 1, 16) as namespace, count(*) as runs from runs group by 1, 2, 3""")
def cache_names(spark, sf_dir):
    """The namespace of a cache for each model and engine."""
    r = runs(spark, sf_dir).select(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("engine", F.lit("")).alias("engine"))
    return r.groupBy("model", "engine", F.substring(F.sha2(F.concat("model", F.lit("\x00"), "engine"), 256), 1, 16).alias("namespace")).agg(F.count("*").alias("runs"))


@CORE.query("manifest_audit", """with m as (select id, title, translated_filename, file_size, page_count, stored_filename, dual_filename, translation_status from papers),
r as (select id, case when coalesce(title, '') = '' then 'title' when coalesce(stored_filename, '') = '' then 'stored_filename' when translation_status not in ('completed', 'failed') then 'status' when coalesce(page_count, 0) <= 0 then 'page_count' when coalesce(file_size, 0) <= 0 then 'file_size' when translation_status = 'completed' and coalesce(translated_filename, '') = '' then 'translated_filename' else 'passed' end as outcome from m)
select outcome, count(*) as entries, sum(count(*)) over ()::bigint as checked, (sum(count(*) filter (outcome = 'passed')) over ())::bigint as passed from r group by 1""")
def manifest_audit(spark, sf_dir):
    """Entries by the first rule that they break, with the totals checked and passed."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    status = F.col("translation_status")
    outcome = (
        F.when(empty("title"), "title").when(empty("stored_filename"), "stored_filename").when(~status.isin("completed", "failed"), "status").when(none("page_count"), "page_count")
        .when(none("file_size"), "file_size").when((status == "completed") & empty("translated_filename"), "translated_filename").otherwise("passed")
    )
    n = table(spark, sf_dir, "papers").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("entries"))
    whole = Window.partitionBy(F.lit(1))  # a row per rule
    return n.withColumns({"checked": F.sum("entries").over(whole), "passed": F.sum(F.when(F.col("outcome") == "passed", F.col("entries")).otherwise(0)).over(whole)})


@CORE.query("manifest_assembly", f"""with {RUNS}, {LAST} select p.id, p.translation_status as status, n.id is not null as has_run, d.texts is not null as has_text, coalesce(d.texts, 0) as texts, case when n.finished_at is not null and n.created_at is not null then date_diff('second', n.created_at, n.finished_at) end as seconds
from papers p left join newest n on n.paper_id = p.id left join (select paper_id, count(*) as texts from documents where paper_id is not null group by 1) d on d.paper_id = p.id""")
def manifest_assembly(spark, sf_dir):
    """Each entry of the manifest with its run, its texts and its time, where there are any."""
    n = newest(runs(spark, sf_dir)).select("paper_id", F.lit(True).alias("run"), F.when(F.col("finished_at").isNotNull(), F.timestamp_diff("SECOND", F.date_trunc("second", "created_at"), F.date_trunc("second", "finished_at"))).alias("seconds"))
    d = table(spark, sf_dir, "documents", "paper_id").where("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("texts"))
    p = table(spark, sf_dir, "papers", "id", "translation_status").select(F.col("id").alias("paper_id"), F.col("translation_status").alias("status"))
    out = p.join(n, "paper_id", "left").join(d, "paper_id", "left")
    return out.select(F.col("paper_id").alias("id"), "status", F.col("run").isNotNull().alias("has_run"), F.col("texts").isNotNull().alias("has_text"), F.coalesce("texts", F.lit(0)).alias("texts"), "seconds")


@CORE.query("manifest_select", """with w as (select distinct paper_id as id from translation_jobs where paper_id is not null) select w.id, p.id is not null as known from w left join (select distinct id from papers) p on p.id = w.id""")
def manifest_select(spark, sf_dir):
    """The asked-for entries, and which of them the manifest doesn't know."""
    w = table(spark, sf_dir, "translation_jobs", "paper_id").where("paper_id is not null").distinct().withColumnRenamed("paper_id", "id")
    known = table(spark, sf_dir, "papers", "id").distinct().withColumn("known", F.lit(True))
    return w.join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@CORE.query("file_pairs", """with s as (select regexp_replace(stored_filename, '\\.pdf$', '', 'i') as stem, count(*) as n from papers where regexp_matches(stored_filename, '\\.pdf$', 'i') group by 1),
t as (select regexp_replace(translated_filename, '\\.zh-CN\\.pdf$', '') as stem, count(*) as n from papers where regexp_matches(translated_filename, '\\.zh-CN\\.pdf$') group by 1) select stem, s.n as sources, t.n as translations from s join t using (stem)""")
def file_pairs(spark, sf_dir):
    """Files and their translations, paired by the name without its ending; names without a partner are left out."""
    p = table(spark, sf_dir, "papers", "stored_filename", "translated_filename")
    s = p.where(F.col("stored_filename").rlike(r"(?i)\.pdf$")).groupBy(F.regexp_replace("stored_filename", r"(?i)\.pdf$", "").alias("stem")).agg(F.count("*").alias("sources"))
    t = p.where(F.col("translated_filename").rlike(r"\.zh-CN\.pdf$")).groupBy(F.regexp_replace("translated_filename", r"\.zh-CN\.pdf$", "").alias("stem")).agg(F.count("*").alias("translations"))
    return s.join(t, "stem")


@CORE.query("eval_provenance_gate", f"""with {RUNS}, {LAST}, r as (select count(*) as papers, count(distinct engine) as engines, count(distinct model) as models, count(*) filter (schema_version <> 3) as old from newest)
select rule, broken from (select 'fewer than 20 papers' as rule, papers < 20 as broken from r union all select 'more than one engine', engines > 1 from r union all select 'more than one model', models > 1 from r union all select 'unknown provenance', old > 0 from r)""")
def eval_provenance_gate(spark, sf_dir):
    """The rules of a release about where its translations come from."""
    r = newest(runs(spark, sf_dir)).agg(F.count("*").alias("papers"), F.count_distinct("engine").alias("engines"), F.count_distinct("model").alias("models"), F.count_if(F.col("schema_version") != 3).alias("old"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), test.alias("broken")) for name, test in (
        ("fewer than 20 papers", F.col("papers") < 20), ("more than one engine", F.col("engines") > 1), ("more than one model", F.col("models") > 1), ("unknown provenance", F.col("old") > 0)
    )))
    return r.select(F.inline(rules))


@CORE.query("eval_table", f"""with {ISSUES}, {SCORES}, {VIS}, {REPORTS} select doc, '| ' || doc || ' | ' || errors || ' | ' || actionable || ' | ' || case when strict_pass then 'pass' else 'fail' end || ' |' as line from reports""")
def eval_table(spark, sf_dir):
    """The reports as lines of a table in Markdown."""
    r = reports(spark, sf_dir)
    return r.select("doc", F.concat(F.lit("| "), F.concat_ws(" | ", "doc", F.col("errors").cast("string"), F.col("actionable").cast("string"), F.when(F.col("strict_pass"), "pass").otherwise("fail")), F.lit(" |")).alias("line"))


@CORE.query("qa_sidecar", f"""with {ISSUES} select doc, count(*) as issues, md5(string_agg(severity || chr(9) || code || chr(9) || page, chr(10) order by page, code, severity, event_id)) as lines_md5 from issues group by 1""")
def qa_sidecar(spark, sf_dir):
    """The issues of a document as the lines of its report file, in the order of pages."""
    xs = F.array_sort(F.collect_list(F.struct("page", "code", "severity", "event_id")))
    lines = F.transform(xs, lambda x: F.concat_ws("\t", x["severity"], x["code"], x["page"].cast("string")))
    return issues(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("issues"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"))


@CORE.query("issue_page_caps", f"""with {ISSUES}, r as (select *, row_number() over (partition by doc, page, code order by event_id) as k from issues)
select doc, event_id, page, code from r where k <= case code when 'font_size_drift' then 4 when 'preserved_ink_mismatch' then 4 when 'formula_changed' then 5 when 'text_overlap' then 3 when 'untranslated_block' then 4 else 1000000000 end""")
def issue_page_caps(spark, sf_dir):
    """At most so many issues of a code on a page; the first ones stay."""
    cap = F.lit(None).cast("int")
    for code, n in PAGE_CAPS.items():
        cap = F.when(F.col("code") == code, n).otherwise(cap)
    k = F.row_number().over(Window.partitionBy("doc", "page", "code").orderBy("event_id"))
    return issues(spark, sf_dir).withColumn("k", k).where((F.col("k") <= cap) | cap.isNull()).select("doc", "event_id", "page", "code")


# Issues of a code that a page reports.
PAGE_CAPS = {"font_size_drift": 4, "preserved_ink_mismatch": 4, "formula_changed": 5, "text_overlap": 3, "untranslated_block": 4}


@CORE.query("qa_loop", f"""with {ISSUES}, {SCORES}, f as (select doc, substr(sha256(string_agg(severity || chr(9) || code || chr(9) || page || chr(9) || message, chr(10) order by severity, code, page, message)), 1, 16) as print from issues group by 1),
a as (select split_part(doc, '-', 1) as paper, split_part(doc, '-', 2) as attempt, struct_pack(e := errors, i := issues) as s, print from scores join f using (doc)),
b as (select *, min(s) over (partition by paper order by attempt rows between unbounded preceding and 1 preceding) as best, row_number() over (partition by paper, print order by attempt) > 1 as again from a)
select paper, attempt, best is null or s < best as accepted, again as repeated from b""")
def qa_loop(spark, sf_dir):
    """Attempts at a paper in order: one is accepted if its score is lower than that of every attempt before it, and the loop ends
    when an attempt's fingerprint was seen before."""
    i = issues(spark, sf_dir)
    a = Q.scores(i, ["doc"]).join(Q.fingerprints(i, ["doc"]), "doc").select(F.split_part("doc", F.lit("-"), F.lit(1)).alias("paper"), F.split_part("doc", F.lit("-"), F.lit(2)).alias("attempt"), F.struct("errors", "issues").alias("s"), F.col("by_page").alias("print"))
    best = F.min("s").over(Window.partitionBy("paper").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    again = F.row_number().over(Window.partitionBy("paper", "print").orderBy("attempt")) > 1
    return a.select("paper", "attempt", (best.isNull() | (F.col("s") < best)).alias("accepted"), again.alias("repeated"))
