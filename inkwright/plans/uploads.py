"""Queries over uploads in chunks, job settings and progress. Texts of documents stand for files: a text is cut into chunks of 400
characters, of which some don't arrive, some arrive twice, and some arrive damaged."""

from pyspark.sql import functions as F

from inkwright.functions.text import clean_hash, last_eta
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

SIZE = 400
CHUNKS = f"""c as (select doc_id, i, substr(text, i * {SIZE} + 1, {SIZE}) as body, cast((length(text) + {SIZE - 1}) // {SIZE} as int) as n, length(text) as total from documents, unnest(range(0, (length(text) + {SIZE - 1}) // {SIZE})) as r(i) where length(text) > 0),
arrived as (select doc_id, i, n, total, body, case when (doc_id + i) % 13 = 5 then body || 'x' else body end as got, sha256(body) as said from c where (doc_id * 7 + i) % 17 <> 3
  union all select doc_id, i, n, total, body, body, sha256(body) from c where (doc_id + i) % 5 = 0)"""
VALID = "ok as (select distinct doc_id, i, n, total, got from arrived where length(got) = least(400, total - i * 400) and sha256(got) = said)"


def arrived(spark, sf_dir):
    """(doc_id, i, n, total, got, said): chunks as they arrive, with the number of chunks and characters of their text and the digest
    that was announced."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("length(text) > 0").withColumns({"total": F.length("text"), "n": F.expr(f"int((length(text) + {SIZE - 1}) div {SIZE})")})
    c = d.select("doc_id", "n", "total", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> substring(text, i * {SIZE} + 1, {SIZE}))")).alias("i", "body"))
    damaged = F.when((F.col("doc_id") + F.col("i")) % 13 == 5, F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    times = F.array_compact(F.array(F.when((F.col("doc_id") * 7 + F.col("i")) % 17 != 3, damaged), F.when((F.col("doc_id") + F.col("i")) % 5 == 0, F.col("body"))))
    return c.select("doc_id", "i", "n", "total", F.sha2("body", 256).alias("said"), F.explode(times).alias("got"))


def valid_chunks(chunks):
    """Chunks of the expected size whose content has the announced digest; the last one of a file may be shorter."""
    right = (F.length("got") == F.least(F.lit(SIZE), F.col("total") - F.col("i") * SIZE)) & (F.sha2("got", 256) == F.col("said"))
    return chunks.where(right)


@CORE.query("chunk_check", f"with {CHUNKS} select doc_id, count(*) as arrived, count(*) filter (length(got) <> least(400, total - i * 400)) as wrong_size, count(*) filter (sha256(got) <> said) as wrong_digest from arrived group by 1")
def chunk_check(spark, sf_dir):
    c = arrived(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count("*").alias("arrived"), F.count_if(F.length("got") != F.least(F.lit(SIZE), F.col("total") - F.col("i") * SIZE)).alias("wrong_size"), F.count_if(F.sha2("got", 256) != F.col("said")).alias("wrong_digest"))


@CORE.query("chunk_list", f"with {CHUNKS}, {VALID} select doc_id, list_sort(list(distinct i::int)) as chunks from ok group by 1")
def chunk_list(spark, sf_dir):
    """The valid chunks of each file, each once, in order."""
    return valid_chunks(arrived(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("chunks"))


@CORE.query("chunk_assemble", f"""with {CHUNKS}, {VALID}, g as (select doc_id, any_value(n) as n, any_value(total) as total, list(distinct i::int) as have, string_agg(got, '' order by i) as whole from ok group by 1),
m as (select *, list_sort(list_filter(range(0, n)::int[], lambda x: not list_contains(have, x))) as missing from g)
select doc_id, missing[1:10] as missing, case when len(missing) = 0 then sha256(whole) end as digest, case when len(missing) > 0 then 'missing' when length(whole) <> total then 'size' when not starts_with(whole, 'T') then 'head' when not contains(right(whole, 1024), '.') then 'tail' else 'ok' end as state from m""")
def chunk_assemble(spark, sf_dir, head="T", tail="."):
    """Files put together from their chunks in order: the first broken rule of completeness, size, head and tail, the first ten
    missing chunks, and the digest of the whole where none is missing."""
    one = valid_chunks(arrived(spark, sf_dir)).groupBy("doc_id", "i").agg(F.max(F.struct("n", "total", "got")).alias("x"))
    g = one.groupBy("doc_id").agg(F.max("x.n").alias("n"), F.max("x.total").alias("total"), F.array_sort(F.collect_list(F.struct("i", F.col("x.got").alias("got")))).alias("xs"))
    g = g.withColumns({"missing": F.array_except(F.expr("sequence(0, n - 1)"), F.col("xs.i")), "whole": F.array_join("xs.got", "")})
    state = F.when(F.size("missing") > 0, "missing").when(F.length("whole") != F.col("total"), "size").when(~F.col("whole").startswith(head), "head").when(~F.contains(F.expr("right(whole, 1024)"), F.lit(tail)), "tail").otherwise("ok")
    return g.select("doc_id", F.slice("missing", 1, 10).alias("missing"), F.when(F.size("missing") == 0, F.sha2("whole", 256)).alias("digest"), state.alias("state"))


HASH = "regexp_replace(regexp_replace(lower(content_sha256), '^\\s*(sha-?256\\s*[:=]?\\s*|0x)', ''), '[^0-9a-z]', '', 'g')"


@CORE.query("upload_of_completed", f"""with u as (select id, lower(trim(access_scope, ' ')) as scope, {HASH} as h, file_size, paper_id, created_at from pdf_upload_sessions where access_scope is not null and file_size is not null),
v as (select u.*, p.translation_status from u join papers p on p.id = u.paper_id where regexp_matches(h, '^[0-9a-f]{{64}}$') and not regexp_matches(h, '^0+$')), f as (select scope, h, file_size, arg_min(paper_id, (created_at, id)) as paper_id, count(*) as uploads from v where translation_status = 'completed' and created_at is not null group by 1, 2, 3)
select scope, h as hash, file_size, paper_id, uploads from f""")
def upload_of_completed(spark, sf_dir):
    """For each content of a scope the paper that its earliest upload made and that is translated: what a repeated upload gets."""
    u = table(spark, sf_dir, "pdf_upload_sessions", "id", "access_scope", "content_sha256", "file_size", "paper_id", "created_at").where("access_scope is not null and file_size is not null and created_at is not null")
    u = u.select("id", F.lower(F.trim("access_scope")).alias("scope"), clean_hash(F.col("content_sha256")).alias("hash"), "file_size", "paper_id", "created_at").where("hash is not null")
    done = table(spark, sf_dir, "papers", "id", "translation_status").where("translation_status = 'completed'").select(F.col("id").alias("paper_id"))
    first = u.join(done, "paper_id").groupBy("scope", "hash", "file_size").agg(F.min(F.struct("created_at", "id", "paper_id"))["paper_id"].alias("paper_id"), F.count("*").alias("uploads"))
    return first


STAGE = """case translation_status when 'pending' then '等待翻译' when 'completed' then '已完成' when 'repairing' then coalesce(nullif(trim(translation_stage, ' '), ''), '等待系统修复') when 'failed' then '失败'
  when 'translating' then coalesce(nullif(trim(translation_stage, ' '), ''), case when contains(recent, '版面修复') then '版面修复' when contains(recent, '检查') or contains(recent, 'QA') then '译后检查' when contains(recent, 'OCR') then 'OCR 处理' when contains(recent, '已记录') and contains(recent, '术语') then '术语检查' else '翻译中' end) else coalesce(translation_status, '') end"""
LOGS = """l as (select id, translation_status, case when file_size % 2 = 0 then translation_stage end as translation_stage, case when file_size % 3 = 0 then translation_eta_seconds end as eta,
  coalesce(translation_log, '') || repeat(chr(10) || 'x', file_size % 10) || case file_size % 6 when 0 then chr(10) || '版面修复' when 1 then chr(10) || 'QA 1' when 2 then chr(10) || 'OCR' when 3 then chr(10) || '已记录 3 个术语，预计剩余 1小时05分' else chr(10) || '预计剩余 40秒' end as log from papers where file_size is not null),
r as (select *, array_to_string(string_split(log, chr(10))[-8:], chr(10)) as recent from l)"""


def with_logs(spark, sf_dir):
    p = table(spark, sf_dir, "papers", "id", "translation_status", "translation_stage", "translation_eta_seconds", "translation_log", "file_size").where("file_size is not null")
    ends = F.array(*map(F.lit, ["\n版面修复", "\nQA 1", "\nOCR", "\n已记录 3 个术语，预计剩余 1小时05分", "\n预计剩余 40秒", "\n预计剩余 40秒"]))
    log = F.concat(F.coalesce("translation_log", F.lit("")), F.repeat(F.lit("\nx"), F.col("file_size") % 10), F.get(ends, F.col("file_size") % 6))
    return p.select("id", "translation_status", F.when(F.col("file_size") % 2 == 0, F.col("translation_stage")).alias("translation_stage"), F.when(F.col("file_size") % 3 == 0, F.col("translation_eta_seconds")).alias("eta"), log.alias("log"))


# The stages of a translation by its status, and by what the end of its log names, in order.
STATUS_STAGES = {"pending": "等待翻译", "completed": "已完成", "failed": "失败"}
LOG_STAGES = [(["版面修复"], "版面修复"), (["检查"], "译后检查"), (["QA"], "译后检查"), (["OCR"], "OCR 处理"), (["已记录", "术语"], "术语检查")]


@CORE.query("progress_stage", f"with {LOGS} select id, {STAGE} as stage from r")
def progress_stage(spark, sf_dir):
    """The stage of each translation: as stored, or by its status, or by the last eight lines of its log."""
    p = with_logs(spark, sf_dir)
    recent = F.array_join(F.expr("slice(split(log, '\n'), greatest(1, size(split(log, '\n')) - 7), 8)"), "\n")
    stored, s = F.nullif(F.trim("translation_stage"), F.lit("")), F.col("translation_status")
    said = F.lit("翻译中")
    for words, name in LOG_STAGES[::-1]:
        hit = recent.contains(words[0])
        for w in words[1:]:
            hit = hit & recent.contains(w)
        said = F.when(hit, name).otherwise(said)
    stage = F.when(s == "repairing", F.coalesce(stored, F.lit("等待系统修复"))).when(s == "translating", F.coalesce(stored, said)).otherwise(F.coalesce(s, F.lit("")))
    for status, name in STATUS_STAGES.items():
        stage = F.when(s == status, name).otherwise(stage)
    return p.select("id", stage.alias("stage"))


@CORE.query("progress_eta", f"""with {LOGS}, m as (select id, eta, translation_status, regexp_extract_all(log, '预计剩余\\s*(?:\\d+小时)?(?:\\d+分)?(?:\\d+秒)?') as ms from r), x as (select *, ms[len(ms)] as last from m),
s as (select id, eta, translation_status, nullif(coalesce(try_cast(regexp_extract(last, '(\\d+)小时', 1) as bigint), 0) * 3600 + coalesce(try_cast(regexp_extract(last, '(\\d+)分', 1) as bigint), 0) * 60 + coalesce(try_cast(regexp_extract(last, '(\\d+)秒', 1) as bigint), 0), 0) as logged from x)
select id, case when translation_status = 'translating' then coalesce(eta, logged) end as eta_seconds from s""")
def progress_eta(spark, sf_dir):
    """Seconds left of running translations: as stored, or the last that the log names."""
    return with_logs(spark, sf_dir).select("id", F.when(F.col("translation_status") == "translating", F.coalesce(F.col("eta").cast("long"), last_eta(F.col("log")))).alias("eta_seconds"))


@CORE.query("paper_rows", """select id, coalesce(title, '') as title, coalesce(translated_filename, '') as translated_filename, least(1.0, greatest(0.0, coalesce(translation_progress, 0.0)))::double as progress,
coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '') as created_at, coalesce(strftime(updated_at, '%Y-%m-%dT%H:%M:%S'), '') as updated_at from papers""")
def paper_rows(spark, sf_dir):
    """Rows as a listing gives them: progress between 0 and 1, times as ISO text, nothing null."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    p = table(spark, sf_dir, "papers", "id", "title", "translated_filename", "translation_progress", "created_at", "updated_at")
    return p.select("id", text("title"), text("translated_filename"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("translation_progress", F.lit(0.0)))).alias("progress"), iso("created_at"), iso("updated_at"))


@CORE.query("job_settings", """with j as (select distinct id, backend, qa_mode, qa_max_passes, ocr_mode, ocr_dpi, max_attempts, attempt_count from translation_jobs),
v as (select id, list_filter([case when qa_max_passes is null or qa_max_passes not between 1 and 8 then 'qa_max_passes' end, case when ocr_dpi is null or ocr_dpi not between 96 and 300 then 'ocr_dpi' end, case when coalesce(ocr_mode, '') not in ('auto', 'off', 'force') then 'ocr_mode' end], lambda x: x is not null) as bad,
greatest(1, least(8, coalesce(max_attempts, 3))) as attempts, least(30.0, greatest(0.0, 2.0 * greatest(0, coalesce(attempt_count, 0) - 1)))::double as wait_seconds from j) select id, array_to_string(bad, ',') as bad, attempts, wait_seconds, count(*) as rows from v group by 1, 2, 3, 4""")
def job_settings(spark, sf_dir):
    """Settings out of their range, the attempts that a job may have, and how long it waits before the next."""
    j = table(spark, sf_dir, "translation_jobs", "id", "backend", "qa_mode", "qa_max_passes", "ocr_mode", "ocr_dpi", "max_attempts", "attempt_count").distinct()
    outside = lambda c, a, b: F.coalesce(~F.col(c).between(a, b), F.lit(True))
    bad = F.array_compact(F.array(F.when(outside("qa_max_passes", 1, 8), "qa_max_passes"), F.when(outside("ocr_dpi", 96, 300), "ocr_dpi"), F.when(~F.coalesce("ocr_mode", F.lit("")).isin("auto", "off", "force"), "ocr_mode")))
    attempts = F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce("max_attempts", F.lit(3))))
    wait = F.least(F.lit(30.0), F.greatest(F.lit(0.0), 2.0 * F.greatest(F.lit(0), F.coalesce("attempt_count", F.lit(0)) - 1)))
    return j.select("id", F.array_join(bad, ",").alias("bad"), attempts.alias("attempts"), wait.alias("wait_seconds")).groupBy("id", "bad", "attempts", "wait_seconds").agg(F.count("*").alias("rows"))


@CORE.query("schema_evolve", """select j.id, coalesce(j.access_scope, p.scope, 'local') as access_scope, 'standard' as quality_mode, 0 as revision, count(*) as rows from translation_jobs j left join (select id, any_value(access_scope) as scope from papers group by 1) p on p.id = j.paper_id group by 1, 2""")
def schema_evolve(spark, sf_dir):
    """An older table brought to a newer schema: missing columns come with their defaults, the scope from the owning paper."""
    old = table(spark, sf_dir, "translation_jobs", "id", "paper_id", "access_scope")
    new = evolve(old, {"quality_mode": "standard", "revision": 0, "access_scope": "local"})
    owner = table(spark, sf_dir, "papers", "id", "access_scope").groupBy(F.col("id").alias("paper_id")).agg(F.first("access_scope").alias("scope"))
    full = new.join(owner, "paper_id", "left").select("id", F.coalesce("access_scope", "scope", F.lit("local")).alias("access_scope"), "quality_mode", "revision")
    return full.groupBy("id", "access_scope", "quality_mode", "revision").agg(F.count("*").alias("rows"))


def evolve(df, defaults):
    """`df` with the columns of `defaults` that it lacks; columns that it has stay as they are, so that it may be done again."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
