"""Queries over papers, jobs and uploads."""

from pyspark.sql import functions as F

from inkwright.functions.text import duration, last_eta
from inkwright.operators import library as L
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

SHA = r"regexp_replace(regexp_replace(lower(content_sha256), '^\s*(sha-?256\s*[:=]?\s*|0x)', ''), '[^0-9a-z]', '', 'g')"


@CORE.query("lib_list_page", """
select id, title, translation_status, created_at, cast(greatest(0, least(1, translation_progress / 100)) as double) as progress
from papers where access_scope = 'local' and lower(title) like '%a%' and translation_status = 'completed' and lower(tags) like '%e%'
order by created_at desc nulls last, id limit 20 offset 5""")
def lib_list_page(spark, sf_dir):
    p = L.scoped(table(spark, sf_dir, "papers"), "local", title="A", status="completed", tag="e")
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("translation_progress") / 100)).alias("progress")
    return L.page(p, "created_at", "id", 20, 5).select("id", "title", "translation_status", "created_at", progress)


@CORE.query("lib_count", """
select count(*) as n from papers where access_scope = 'local' and translation_status = 'completed' and lower(title) like '%a%'""")
def lib_count(spark, sf_dir):
    return L.scoped(table(spark, sf_dir, "papers"), "local", title="A", status="completed").agg(F.count("*").alias("n"))


@CORE.query("lib_stats", """
select access_scope, count(*) as papers, count(*) filter (translation_status = 'completed') as completed,
  count(*) filter (page_count = 0) as without_pages from papers group by 1""")
def lib_stats(spark, sf_dir):
    return L.totals(table(spark, sf_dir, "papers"))


@CORE.query("lib_progress_meta", """
select id, case when translation_status in ('translating', 'repairing') and trim(coalesce(translation_stage, '')) <> '' then trim(translation_stage)
  when translation_status = 'pending' then '等待翻译' when translation_status = 'completed' then '已完成' when translation_status = 'repairing' then '等待系统修复'
  when translation_status = 'failed' then '失败' when translation_status = 'translating' then '翻译中' else coalesce(translation_status, '') end as stage,
  case when translation_status <> 'translating' or translation_eta_seconds is null then ''
    when translation_eta_seconds < 60 then translation_eta_seconds || '秒'
    when translation_eta_seconds < 3600 then (translation_eta_seconds // 60) || '分' || lpad(cast(translation_eta_seconds % 60 as varchar), 2, '0') || '秒'
    else (translation_eta_seconds // 3600) || '小时' || lpad(cast(translation_eta_seconds % 3600 // 60 as varchar), 2, '0') || '分' end as eta
from papers""")
def lib_progress_meta(spark, sf_dir):
    """Stage and remaining time as shown: the stored stage while work goes on, else what the status says."""
    s, stored = F.col("translation_status"), F.trim(F.coalesce("translation_stage", F.lit("")))
    stage = F.when(s.isin("translating", "repairing") & (stored != ""), stored)
    # The stage of each status.
    for status, text in (("pending", "等待翻译"), ("completed", "已完成"), ("repairing", "等待系统修复"), ("failed", "失败"), ("translating", "翻译中")):
        stage = stage.when(s == status, text)
    eta = F.when((s == "translating") & F.col("translation_eta_seconds").isNotNull(), duration(F.col("translation_eta_seconds")))
    return table(spark, sf_dir, "papers").select("id", stage.otherwise(F.coalesce(s, F.lit(""))).alias("stage"), F.coalesce(eta, F.lit("")).alias("eta"))


@CORE.query("eta_parse_format", """
with t as (select event_id, cast(floor(value * 37) as bigint) as s from events)
select event_id, case when s = 0 then null else s end as seconds,
  case when s < 60 then s || '秒' when s < 3600 then (s // 60) || '分' || lpad(cast(s % 60 as varchar), 2, '0') || '秒'
    else (s // 3600) || '小时' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || '分' end as shown from t""")
def eta_parse_format(spark, sf_dir):
    """Times written into a log of two lines and read back: the last one counts."""
    s = F.floor(F.col("value") * 37).cast("long")
    log = F.concat(F.lit("翻译进度: 10%，预计剩余 9小时00分\n预计剩余 "), (s / 3600).cast("long"), F.lit("小时"), F.floor(s % 3600 / 60), F.lit("分"), s % 60, F.lit("秒"))
    return table(spark, sf_dir, "events").select("event_id", last_eta(log).alias("seconds"), duration(s).alias("shown"))


@CORE.query("job_latest_state", """
select id, paper_id, status, attempt_count, updated_at from (select *, row_number() over (partition by id order by updated_at desc nulls last,
  progress desc nulls last, status desc nulls last, attempt_count desc nulls last, paper_id desc nulls last) as r from translation_jobs) where r = 1""")
def job_latest_state(spark, sf_dir):
    """One row per job: older states that arrive late, and repeated rows, give way."""
    cols = ["updated_at", "progress", "status", "attempt_count", "paper_id"]
    return L.latest_states(table(spark, sf_dir, "translation_jobs", "id", *cols), "id", cols[:4]).select("id", "paper_id", "status", "attempt_count", "updated_at")


@CORE.query("job_latest_per_paper", """
select paper_id, id, created_at, cast(rank as int) as rank from (select paper_id, id, created_at, row_number() over (partition by paper_id
  order by created_at desc nulls last, id) as rank from (select distinct paper_id, id, created_at from translation_jobs)) where rank <= 50""")
def job_latest_per_paper(spark, sf_dir):
    jobs = table(spark, sf_dir, "translation_jobs", "paper_id", "id", "created_at").distinct()
    return L.first_per_key(jobs, ["paper_id"], [F.desc_nulls_last("created_at"), F.asc("id")], 50)


@CORE.query("job_backfill_scope", """
select distinct j.id, coalesce(p.access_scope, j.access_scope) as access_scope from translation_jobs j left join papers p on p.id = j.paper_id""")
def job_backfill_scope(spark, sf_dir):
    """The scope of the owning paper; a job without one keeps its own."""
    p = table(spark, sf_dir, "papers").select(F.col("id").alias("paper_id"), F.col("access_scope").alias("owner"))
    j = table(spark, sf_dir, "translation_jobs", "id", "paper_id", "access_scope").distinct()
    return j.join(p, "paper_id", "left").select("id", F.coalesce("owner", "access_scope").alias("access_scope")).distinct()


@CORE.query("job_without_paper", """
select distinct j.paper_id from translation_jobs j where j.paper_id is not null and not exists (select 1 from papers p where p.id = j.paper_id)""")
def job_without_paper(spark, sf_dir):
    p = table(spark, sf_dir, "papers").select(F.col("id").alias("paper_id"))
    return table(spark, sf_dir, "translation_jobs", "paper_id").where("paper_id is not null").distinct().join(p, "paper_id", "left_anti")


@CORE.query("paper_job_guard", """
select p.id, p.translation_status, (select max(created_at) from translation_jobs j where j.paper_id = p.id) as last_job from papers p""")
def paper_job_guard(spark, sf_dir):
    """Each paper with the time of its latest job, from an aggregate and a join."""
    last = table(spark, sf_dir, "translation_jobs", "paper_id", "created_at").groupBy(F.col("paper_id").alias("id")).agg(F.max("created_at").alias("last_job"))
    return table(spark, sf_dir, "papers", "id", "translation_status").join(last, "id", "left")


@CORE.query("upload_dedup", f"""
with u as (select lower(trim(access_scope)) as scope, {SHA} as sha, file_size, created_at, id from pdf_upload_sessions)
select scope, sha, file_size, count(*) as uploads, arg_min(id, (created_at, id)) as first_id from u
where regexp_matches(sha, '^[0-9a-f]{{64}}$') and not regexp_matches(sha, '^0+$') and scope is not null and file_size is not null
  and created_at is not null group by 1, 2, 3""")
def upload_dedup(spark, sf_dir):
    return L.repeated_uploads(table(spark, sf_dir, "pdf_upload_sessions").where("created_at is not null"))


@CORE.query("upload_chunk_plan", """
select id, cast(chunk as int) as chunk, cast(least(chunk_size, file_size - chunk * chunk_size) as bigint) as size
from (select id, cast(file_size as bigint) as file_size, cast(chunk_size as bigint) as chunk_size,
  unnest(range(0, cast((file_size + chunk_size - 1) // chunk_size as bigint))) as chunk from pdf_upload_sessions where file_size > 0 and chunk_size > 0)""")
def upload_chunk_plan(spark, sf_dir):
    return L.chunk_plan(table(spark, sf_dir, "pdf_upload_sessions", "id", "file_size", "chunk_size"))


@CORE.query("upload_missing_chunks", """
select id, cast((file_size + chunk_size - 1) // chunk_size as bigint) as wanted, cast(coalesce(len(chunk_digests), 0) as bigint) as held
from pdf_upload_sessions where file_size > 0 and chunk_size > 0 and (file_size + chunk_size - 1) // chunk_size <> coalesce(len(chunk_digests), 0)""")
def upload_missing_chunks(spark, sf_dir):
    wanted = F.expr("(cast(file_size as long) + chunk_size - 1) div chunk_size")
    held = F.coalesce(F.array_size("chunk_digests"), F.lit(0)).cast("long")
    u = table(spark, sf_dir, "pdf_upload_sessions", "id", "file_size", "chunk_size", "chunk_digests").where("file_size > 0 and chunk_size > 0")
    return u.select("id", wanted.alias("wanted"), held.alias("held")).where("wanted <> held")


@CORE.query("upload_stale", """
select lower(trim(access_scope)) as scope, count(*) as stale, min(updated_at) as oldest from pdf_upload_sessions
where paper_id is null and updated_at < timestamp '2026-01-01 00:00:00' group by 1""")
def upload_stale(spark, sf_dir):
    u = table(spark, sf_dir, "pdf_upload_sessions", "access_scope", "paper_id", "updated_at").where("paper_id is null and updated_at < timestamp_ntz '2026-01-01 00:00:00'")
    return u.groupBy(F.lower(F.trim("access_scope")).alias("scope")).agg(F.count("*").alias("stale"), F.min("updated_at").alias("oldest"))


@CORE.query("quota_incomplete", """
select lower(trim(access_scope)) as scope, count(*) filter (paper_id is null) as incomplete, count(*) filter (paper_id is null) >= 20 as full
from pdf_upload_sessions group by 1""")
def quota_incomplete(spark, sf_dir):
    u = table(spark, sf_dir, "pdf_upload_sessions", "access_scope", "paper_id")
    n = F.count_if(F.col("paper_id").isNull())
    return u.groupBy(F.lower(F.trim("access_scope")).alias("scope")).agg(n.alias("incomplete"), (n >= 20).alias("full"))


@CORE.query("upload_validate", r"""
select id, case when original_filename is null or trim(original_filename) = '' then 'empty' when length(original_filename) > 500 then 'long'
  when not lower(trim(original_filename)) like '%.pdf' then 'suffix' when not regexp_matches(id, '^[0-9a-f]{32}$') then 'id' else 'ok' end as verdict
from pdf_upload_sessions""")
def upload_validate(spark, sf_dir):
    """The first rule that the metadata of an upload breaks."""
    n = F.col("original_filename")
    verdict = (
        F.when(n.isNull() | (F.trim(n) == ""), "empty").when(F.length(n) > 500, "long")
        .when(~F.lower(F.trim(n)).endswith(".pdf"), "suffix").when(~F.col("id").rlike("^[0-9a-f]{32}$"), "id").otherwise("ok")
    )
    return table(spark, sf_dir, "pdf_upload_sessions", "id", "original_filename").select("id", verdict.alias("verdict"))


@CORE.query("tag_counts_by_status", """
select translation_status, tags, count(*) as n from papers where tags is not null and lower(tags) like '%ml%' group by 1, 2""")
def tag_counts_by_status(spark, sf_dir):
    """Substring match over the whole tag field: ml also meets xml."""
    p = table(spark, sf_dir, "papers", "translation_status", "tags").where(F.lower("tags").contains("ml"))
    return p.groupBy("translation_status", "tags").agg(F.count("*").alias("n"))
