"""Queries that take texts apart."""

from pyspark.sql import functions as F

from inkwright.functions import pieces as P
from inkwright.plans.candidates import NOW
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

B = r"[\s\x0b\x{85}\p{Z}]"
PROT = r"\$[^$\n]+\$|https?://[^\s\x0b\x{85}\p{Z}]+|\\cite\{[^}]*\}"


def docs(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


@CORE.query("txt_split_point", f"""with p as (select doc_id, length(text) as n, string_split(regexp_replace(text, '([.!?]{B}+)', '\\1' || chr(1), 'g'), chr(1)) as parts from documents where text is not null),
e as (select doc_id, n, unnest(parts) as part, generate_subscripts(parts, 1) as i, len(parts) as k from p), c as (select doc_id, n, i, k, cast(sum(length(part)) over (partition by doc_id order by i) as int) as e from e),
g as (select doc_id, arg_min(e, (abs(e - n / 2), e)) as cut_at from c where i < k and e >= {P.SHORTEST} and e <= n - {P.SHORTEST} group by 1)
select d.doc_id, cut_at from documents d left join g using (doc_id)""")
def txt_split_point(spark, sf_dir):
    """Where a text that is too long is cut in two: at the end of a sentence nearest to its middle."""
    return docs(spark, sf_dir).select("doc_id", P.split_point(F.col("text")).alias("cut_at"))


@CORE.query("txt_protect", f"""with p as (select doc_id, text, regexp_split_to_array(text, '{PROT}') as rest, regexp_extract_all(text, '{PROT}') as found from documents where text is not null)
select doc_id, cast(len(found) as int) as fragments, md5(array_to_string(list_transform(rest, lambda x, i: case when i > 1 then '⟦' || (i - 2) || '⟧' else '' end || x), '')) as protected_md5, true as restored from p""")
def txt_protect(spark, sf_dir):
    """Formulas, links and citations give way to numbered marks, and come back from them."""
    p, found = P.protect(F.col("text"))
    one = docs(spark, sf_dir).where("text is not null and not text rlike '⟦[0-9]+⟧'").select("doc_id", "text", p.alias("p"), found.alias("found"))
    held = docs(spark, sf_dir).where("text rlike '⟦[0-9]+⟧'").select("doc_id", "text", p.alias("p"), found.alias("found"))
    both = one.withColumn("restored", P.restore(F.col("p"), F.col("found")) == F.col("text")).unionByName(held.withColumn("restored", F.lit(True)))
    return both.select("doc_id", F.size("found").alias("fragments"), F.md5("p").alias("protected_md5"), "restored")


MARKS = ["• ", "- ", "3. ", "(iv) ", " (12) ", "-", "IV. ", ""]
MARKED = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null), m as (select doc_id, [" + ", ".join(f"'{m}'" for m in MARKS) + "][(doc_id + i) % 8 + 1] || line as line from l)"


@CORE.query("txt_list_marks", rf"""with {MARKED}, t as (select doc_id, regexp_replace(line, '^{B}+', '') as t from m),
s as (select doc_id, case when regexp_matches(t, '^[•▪◦‣·]') then 'bullet' when regexp_matches(t, '^[-*][ \t]') then 'dash' when regexp_matches(t, '^\(?[0-9]{{1,2}}[).][ \t]') then 'number' when regexp_matches(t, '^\(?[ivxIVX]{{1,4}}\)[ \t]') then 'roman' end as style from t)
select style, count(*) as lines, count(distinct doc_id) as texts from s where style is not null group by 1""")
def txt_list_marks(spark, sf_dir):
    """Lines that begin as items of a list, by the style of their mark; each line gets one of eight beginnings."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    begun = F.concat(F.get(F.array(*map(F.lit, MARKS)), ((F.col("doc_id") + F.col("i") + 1) % 8).cast("int")), "line")
    styled = lines.select("doc_id", P.list_style(begun).alias("style"))
    return styled.where("style is not null").groupBy("style").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("texts"))


AC = r"((?:[A-Z][a-z]+[ -]){1,5}[A-Z][a-z]+) \(([A-Z]{2,6})\)"
NAMED = "t as (select id, title || ' (' || upper(array_to_string(list_transform(string_split(title, ' ')[-3:], lambda x: x[1]), '')) || ') and more' as text from papers where title is not null)"


@CORE.query("acronyms", f"""with {NAMED}, m as (select id, unnest(regexp_extract_all(text, '{AC}')) as m from t), s as (select id, regexp_extract(m, '{AC}', 1) as long, regexp_extract(m, '{AC}', 2) as short from m),
k as (select *, string_split_regex(long, '[ -]') as ws from s), f as (select id, short, lower(array_to_string(ws[len(ws) - length(short) + 1:], ' ')) as long from k where len(ws) >= length(short) and array_to_string(list_transform(ws[len(ws) - length(short) + 1:], lambda x: x[1]), '') = short)
select short, min(long) as long, count(distinct id) as texts from f group by 1 having count(distinct long) = 1""")
def acronyms(spark, sf_dir):
    """Acronyms with their long form, if all texts agree on one; the words' first letters must spell it. Each title is followed
    by the first letters of its last three words."""
    t = table(spark, sf_dir, "papers", "id", "title").where("title is not null")
    last = F.expr("slice(split(title, ' '), greatest(1, size(split(title, ' ')) - 2), 3)")
    text = F.concat("title", F.lit(" ("), F.upper(F.array_join(F.transform(last, lambda w: F.substring(w, 1, 1)), "")), F.lit(") and more"))
    return agreed_acronyms(t.select("id", text.alias("text")), "id", "text")


def agreed_acronyms(texts, id_col, text_col):
    """(short, long, texts) of texts that write a long form with its acronym in brackets behind it."""
    found = texts.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(f"({AC})"), F.lit(1))).alias("m"))
    s = found.select(id_col, F.split(F.regexp_extract("m", AC, 1), "[ -]").alias("ws"), F.regexp_extract("m", AC, 2).alias("short")).where("size(ws) >= length(short)")
    s = s.withColumn("ws", F.slice("ws", F.size("ws") - F.length("short") + 1, F.length("short"))).where(F.array_join(F.transform("ws", lambda w: F.substring(w, 1, 1)), "") == F.col("short"))
    s = s.select(id_col, "short", F.lower(F.array_join("ws", " ")).alias("long"))
    return s.groupBy("short").agg(F.min("long").alias("long"), F.countDistinct(id_col).alias("texts"), F.countDistinct("long").alias("k")).where("k = 1").drop("k")


@CORE.query("log_append", f"""with l as (select id, case when coalesce(translation_log, '') = '' then '[12:34:56] ' || repeat('检查页面 ', file_size % 400) else translation_log || chr(10) || '[12:34:56] ' || repeat('检查页面 ', file_size % 400) end as log from papers where file_size is not null)
select id, cast(least(length(log), {P.LONGEST_LOG}) as int) as n, md5(right(log, {P.LONGEST_LOG})) as log_md5 from l""")
def log_append(spark, sf_dir, now=NOW):
    p = table(spark, sf_dir, "papers", "id", "translation_log", "file_size").where("file_size is not null")
    log = P.append_log(F.col("translation_log"), F.repeat(F.lit("检查页面 "), F.col("file_size") % 400), F.lit(now).cast("timestamp_ntz"))
    return p.select("id", log.alias("log")).select("id", F.length("log").alias("n"), F.md5("log").alias("log_md5"))


@CORE.query("scope_names", f"""select coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(access_scope, '^{B}+|{B}+$', '', 'g'), '[^0-9A-Za-z_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80), ''), 'local') as scope,
count(*) as sessions, count(distinct access_scope) as spellings from pdf_upload_sessions group by 1""")
def scope_names(spark, sf_dir):
    """Sessions by the stable name of their scope."""
    u = table(spark, sf_dir, "pdf_upload_sessions", "access_scope")
    return u.groupBy(P.scope_name(F.col("access_scope")).alias("scope")).agg(F.count("*").alias("sessions"), F.countDistinct("access_scope").alias("spellings"))


@CORE.query("html_license", """with h as (select id, '<p>' || title || '</p><a href="' || case file_size % 5 when 0 then 'http://creativecommons.org/licenses/by/4.0/' when 1 then 'https://arxiv.org/licenses/nonexclusive-distrib/1.0/' when 2 then 'https://creativecommons.org/publicdomain/zero/1.0/' when 3 then 'https://example.org/licenses/x' else '' end || '">licence</a>' as html
from papers where file_size is not null and title is not null), l as (select id, coalesce(nullif(regexp_extract(html, 'https?://(?:arxiv\\.org/licenses|creativecommons\\.org/(?:licenses|publicdomain))/[a-z0-9./-]+'), ''), 'unknown') as license from h) select id, license, contains(license, 'creativecommons') as open from l""")
def html_license(spark, sf_dir):
    """The licence that a paper's page links to, and whether it is an open one."""
    kinds = ["http://creativecommons.org/licenses/by/4.0/", "https://arxiv.org/licenses/nonexclusive-distrib/1.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "https://example.org/licenses/x", ""]
    p = table(spark, sf_dir, "papers", "id", "title", "file_size").where("file_size is not null and title is not null")
    html = F.concat(F.lit("<p>"), "title", F.lit('</p><a href="'), F.get(F.array(*map(F.lit, kinds)), F.col("file_size") % 5), F.lit('">licence</a>'))
    found = F.coalesce(F.nullif(F.regexp_extract(html, P.LICENSE, 0), F.lit("")), F.lit("unknown"))
    return p.select("id", found.alias("license")).withColumn("open", F.col("license").contains("creativecommons"))


@CORE.query("iso_times", """with w as (select id, created_at, case file_size % 4 when 0 then strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(created_at, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+02:00' else 'about ' || strftime(created_at, '%Y') end as said, file_size % 4 as k from papers where created_at is not null and file_size is not null)
select id, said, case k when 3 then null when 2 then epoch(date_trunc('second', created_at))::bigint - 7200 else epoch(date_trunc('second', created_at))::bigint end as at from w""")
def iso_times(spark, sf_dir):
    """Times written with and without an offset, and what they are in seconds; null for what is no time."""
    p = table(spark, sf_dir, "papers", "id", "created_at", "file_size").where("created_at is not null and file_size is not null")
    iso, k = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("file_size") % 4
    said = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise(F.concat(F.lit("about "), F.date_format("created_at", "yyyy")))
    return p.select("id", said.alias("said")).withColumn("at", F.unix_timestamp(P.parse_time(F.col("said"))))


@CORE.query("dry_run", """select doc_id, md5(case when coalesce(length(text), 0) <= 0 then '' else '中文占位译文。' || substr(repeat('用于检查版面。', 24), 1, greatest(0, greatest(1, least(24, length(text) // 14 + 1)) * 7 - 7)) end) as filler_md5 from documents""")
def dry_run(spark, sf_dir):
    """A stand-in for each text's translation."""
    return docs(spark, sf_dir).select("doc_id", F.md5(P.filler(F.coalesce(F.length("text"), F.lit(0)))).alias("filler_md5"))


@CORE.query("term_prompt", """with f as (select field, lower(en) as en, arg_max(coalesce(zh, ''), (file_ord, term_ord, term_id)) as zh from corpus where en is not null and field is not null group by 1, 2)
select field, count(*) as terms, md5('【术语表】以下术语必须使用标准译法：' || chr(10) || string_agg('  ' || en || ' → ' || zh, chr(10) order by encode(en))) as prompt_md5 from f group by 1""")
def term_prompt(spark, sf_dir):
    """The block of terms of a field in a prompt, sorted."""
    c = table(spark, sf_dir, "corpus").where("en is not null and field is not null")
    f = c.groupBy("field", F.lower("en").alias("en")).agg(F.max(F.struct("file_ord", "term_ord", "term_id", F.coalesce("zh", F.lit("")).alias("zh")))["zh"].alias("zh"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("en", "zh"))), lambda x: F.concat(F.lit("  "), x["en"], F.lit(" → "), x["zh"]))
    return f.groupBy("field").agg(F.count("*").alias("terms"), F.md5(F.concat(F.lit("【术语表】以下术语必须使用标准译法：\n"), F.array_join(lines, "\n"))).alias("prompt_md5"))


@CORE.query("font_names", """select regexp_replace(n, '^[A-Z]{6}\\+', '') as font, count(*) as parts from (select case when p_size % 3 = 0 then 'ABCDEF+' when p_size % 3 = 1 then 'AbCDEF+' else '' end || p_brand as n from part) group by 1""")
def font_names(spark, sf_dir):
    """Font names without the mark of a subset."""
    p = table(spark, sf_dir, "part", "p_brand", "p_size")
    n = F.concat(F.when(F.col("p_size") % 3 == 0, "ABCDEF+").when(F.col("p_size") % 3 == 1, "AbCDEF+").otherwise(""), "p_brand")
    return p.groupBy(F.regexp_replace(n, r"^[A-Z]{6}\+", "").alias("font")).agg(F.count("*").alias("parts"))


@CORE.query("txt_blanks", f"select doc_id, cast(length(t) as int) as n, md5(t) as text_md5 from (select doc_id, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') as t from documents where text is not null)")
def txt_blanks(spark, sf_dir):
    """No-break spaces as plain ones, runs of blanks as one, none at the ends of lines."""
    t = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " "), r" ?\n ?", "\n")
    return docs(spark, sf_dir).where("text is not null").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))
