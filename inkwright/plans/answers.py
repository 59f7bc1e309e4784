"""Queries over answers of language services. Answers are made from glossary rows, a shape for each remainder of the row's number;
payloads of term_records stand for answers with JSON somewhere in them."""

from pyspark.sql import functions as F

from inkwright.functions import responses as R
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

PARTS = "e as (select term_id, coalesce(en, '') as en, coalesce(zh, '') as zh, to_json(coalesce(en, '')) as j, to_json(coalesce(zh, '')) as k from corpus)"
SHAPES = """s as (select term_id, en, zh, case term_id % 9 when 0 then '{"translations": [' || j || ', ' || k || ']}' when 1 then '{"translated_texts": [{"text": ' || j || '}]}' when 2 then '{"results": [{"translated_text": ' || k || '}, ' || j || ']}'
  when 3 then '{"data": {"translations": [' || j || ']}}' when 4 then '{"data": {"results": [{"translation": ' || k || '}]}}' when 5 then '{"results": [1, ' || j || ']}' when 6 then '[' || j || ', ' || k || ']' when 7 then '{"other": ' || j || '}' else '["a", 2]' end as answer from e)"""


def parts(spark, sf_dir):
    e = table(spark, sf_dir, "corpus", "term_id", "en", "zh").select("term_id", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh"))
    quote = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return e.withColumns({"j": quote("en"), "k": quote("zh")})


def shapes(spark, sf_dir):
    forms = ["""concat('{"translations": [', j, ', ', k, ']}')""", """concat('{"translated_texts": [{"text": ', j, '}]}')""", """concat('{"results": [{"translated_text": ', k, '}, ', j, ']}')""", """concat('{"data": {"translations": [', j, ']}}')""",
             """concat('{"data": {"results": [{"translation": ', k, '}]}}')""", """concat('{"results": [1, ', j, ']}')""", """concat('[', j, ', ', k, ']')""", """concat('{"other": ', j, '}')""", """'["a", 2]'"""]
    return parts(spark, sf_dir).withColumn("answer", F.expr("case term_id % 9 " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"))


@CORE.query("answer_lists", f"""with {PARTS}, {SHAPES} select term_id, case term_id % 9 when 0 then [en, zh] when 1 then nullif([en], ['']) when 2 then case when zh <> '' then [zh, en] end when 3 then [en] when 4 then nullif([zh], ['']) when 6 then [en, zh] end as texts,
  md5(answer) as answer from s""")
def answer_lists(spark, sf_dir):
    """The list of texts of each answer; null where a shape is unknown, an item is no text, or an object's text is empty."""
    return shapes(spark, sf_dir).select("term_id", R.text_list(F.col("answer")).alias("texts"), F.md5("answer").alias("answer"))


@CORE.query("answer_chat", f"""with {PARTS} select term_id, case term_id % 5 when 0 then en when 1 then zh when 2 then en || zh when 3 then null else null end as message from e""")
def answer_chat(spark, sf_dir):
    """The message of each answer of two kinds of chat services."""
    forms = ["""concat('{"choices": [{"message": {"content": ', j, '}}]}')""", """concat('{"choices": [{"text": ', k, '}]}')""", """concat('{"content": [{"type": "text", "text": ', j, '}, {"type": "tool", "text": "x"}, {"type": "text", "text": ', k, '}]}')""",
             """concat('{"choices": [], "content": [{"type": "image"}]}')""", """concat('{"content": ', j, '}')"""]
    a = parts(spark, sf_dir).withColumn("answer", F.expr("case term_id % 5 " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"))
    return a.select("term_id", R.chat_message(F.col("answer")).alias("message"))


@CORE.query("answer_json", """with w as (select record_id, payload, case record_id % 3 when 0 then '```json' || chr(10) || payload || chr(10) || '```' when 1 then 'Here it is: ' || payload || ' - done.' else payload end as answer from term_records where payload is not null),
t as (select record_id, case when starts_with(trim(answer, ' '), '```') then regexp_replace(regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '^```(?:json|text)?\\s*', ''), '\\s*```$', '') else regexp_replace(answer, '^\\s+|\\s+$', '', 'g') end as t from w),
p as (select record_id, t, regexp_extract(t, '(?s)(\\{.*\\}|\\[.*\\])', 1) as p from t), j as (select record_id, case when json_valid(t) then t when p <> '' and json_valid(p) then p end as j from p)
select record_id, json_type(j) = 'OBJECT' as is_object, case when json_type(j) = 'OBJECT' then json_extract_string(j, '$.en') end as en from j where j is not null""")
def answer_json(spark, sf_dir):
    """The JSON of each answer, in a fence, within a sentence or alone."""
    w = table(spark, sf_dir, "term_records", "record_id", "payload").where("payload is not null")
    form = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).when(F.col("record_id") % 3 == 1, F.concat(F.lit("Here it is: "), "payload", F.lit(" - done."))).otherwise(F.col("payload"))
    j = w.select("record_id", F.try_parse_json(R.json_of(form)).alias("v")).where("v is not null")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return j.select("record_id", is_object.alias("is_object"), F.when(is_object, F.try_variant_get("v", "$.en", "string")).alias("en"))


@CORE.query("answer_plain", f"""with {PARTS} select term_id, case term_id % 4 when 1 then coalesce(nullif(trim(en, ' '), ''), nullif(trim('[' || j || ']', ' '), '')) else nullif(trim(en, ' '), '') end as text from e where term_id % 4 <> 1 or trim(en, ' ') <> ''""")
def answer_plain(spark, sf_dir):
    """Each answer as one text: bare, in a list of one, as a JSON text, or in a fence."""
    p = parts(spark, sf_dir)
    form = F.when(F.col("term_id") % 4 == 0, F.col("en")).when(F.col("term_id") % 4 == 1, F.concat(F.lit("["), "j", F.lit("]"))).when(F.col("term_id") % 4 == 2, F.col("j")).otherwise(F.concat(F.lit("```text\n"), "en", F.lit("\n```")))
    return p.where("term_id % 4 <> 1 or trim(en) <> ''").select("term_id", R.plain_text(form).alias("text"))


@CORE.query("service_urls", """with u as (select s_suppkey, 'https://h' || s_suppkey || '.example' || case s_suppkey % 5 when 0 then '' when 1 then '/' when 2 then '/v1' when 3 then '/v1/chat/completions//' else '/v1/messages/' end as raw from supplier), t as (select s_suppkey, regexp_replace(raw, '/+$', '') as u from u)
select s_suppkey, case when u like '%/chat/completions' then u when u like '%/v1' then u || '/chat/completions' else u || '/v1/chat/completions' end as chat, case when u like '%/messages' then u when u like '%/v1' then u || '/messages' else u || '/v1/messages' end as messages from t""")
def service_urls(spark, sf_dir):
    k = F.col("s_suppkey")
    end = F.when(k % 5 == 0, "").when(k % 5 == 1, "/").when(k % 5 == 2, "/v1").when(k % 5 == 3, "/v1/chat/completions//").otherwise("/v1/messages/")
    raw = F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example"), end)
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", R.chat_url(raw).alias("chat"), R.messages_url(raw).alias("messages"))
