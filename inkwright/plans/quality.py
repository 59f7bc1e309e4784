"""Queries over issues. Events stand for them: a user's events of one day are the issues of a document, the kind of event
its code, the hour its page; a value of 60 or more is an error. Times and values are those of the table."""

from pyspark.sql import functions as F

from inkwright.operators import quality as Q
from inkwright.operators.library import first_per_key
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

CODES = [("error", "untranslated_block"), ("click", "text_overlap"), ("view", "font_size_drift"), ("signup", "formula_changed"), ("purchase", "preserved_ink_mismatch")]
DOC = "cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d')"
ISSUES = f"""issues as (select {DOC} as doc, event_id, cast(hour(ts) as int) as page,
  case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in CODES)} else 'unknown' end as code, 'k' || json_extract_string(props, '$.k') as message,
  case when value >= 60 then 'error' else 'warning' end as severity from events)"""


def issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.lit("unknown")
    for a, b in CODES:
        code = F.when(F.col("event_type") == a, b).otherwise(code)
    doc = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    raw = e.select(doc.alias("doc"), "event_id", F.hour("ts").alias("page"), code.alias("code"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("message"), F.when(F.col("value") >= 60, "error").otherwise("info").alias("severity"))
    return Q.normal(raw)


LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
HEAL = f"severity = 'error' and code in ({LIST(Q.RETRANSLATE)})"
ACT = f"severity = 'warning' and (code in ({LIST(Q.ACTIONABLE)}) or code like 'preserved\\_%' escape '\\')"
SCORES = f"""scores as (select doc, count(*) filter (severity = 'error') as errors, count(*) filter ({ACT}) as actionable, count(*) as issues,
  coalesce(bool_or({HEAL}), false) as any_heals, count(*) filter (severity = 'error') > 0 and count(*) filter (severity = 'error' and code not in ({LIST(Q.RETRANSLATE)})) = 0 as only_heals from issues group by 1)"""


@CORE.query("issue_by_code", f"""with {ISSUES} select doc, code, count(*) as n, count(*) filter (severity = 'error') as errors,
  coalesce(array_to_string(list_transform(list_sort(list(distinct page) filter (page > 0)), lambda x: cast(x as varchar)), ','), '') as pages from issues group by 1, 2""")
def issue_by_code(spark, sf_dir):
    return Q.by_code(issues(spark, sf_dir), ["doc"])


@CORE.query("issue_top_codes", f"""with {ISSUES}, n as (select doc, code, count(*) as n from issues group by 1, 2)
select doc, code, n, cast(rank as int) as rank from (select *, row_number() over (partition by doc order by n desc, code) as rank from n) where rank <= 3""")
def issue_top_codes(spark, sf_dir):
    """The three most frequent codes of each document."""
    n = issues(spark, sf_dir).groupBy("doc", "code").agg(F.count("*").alias("n"))
    return first_per_key(n, ["doc"], [F.desc("n"), F.asc("code")], 3)


@CORE.query("issue_score", f"with {ISSUES}, {SCORES} select * from scores")
def issue_score(spark, sf_dir):
    return Q.scores(issues(spark, sf_dir), ["doc"])


@CORE.query("issue_plan", f"""with {ISSUES} select doc, case when bool_or(code in ({LIST(Q.LAYOUT)})) then 'repair_layout' when bool_or({HEAL}) then 'retranslate' else 'stop' end as action from issues group by 1""")
def issue_plan(spark, sf_dir):
    return Q.plans(issues(spark, sf_dir), ["doc"])


@CORE.query("issue_fingerprint", f"""with {ISSUES} select doc,
  substr(sha256(string_agg(severity || chr(9) || code || chr(9) || page || chr(9) || message, chr(10) order by severity, code, page, message)), 1, 16) as by_page,
  substr(sha256(string_agg(severity || '|' || code || '|' || page || '|' || message, chr(10) order by severity || '|' || code || '|' || page || '|' || message)), 1, 16) as by_text from issues group by 1""")
def issue_fingerprint(spark, sf_dir):
    return Q.fingerprints(issues(spark, sf_dir), ["doc"])


@CORE.query("issue_message", f"""with {ISSUES}, c as (select doc, code, min(event_id) as o, count(*) as n, list_sort(list(distinct page) filter (page > 0)) as pages from issues where severity = 'error' group by 1, 2),
g as (select doc, list(case when coalesce(len(pages), 0) > 0 then code || '（第 ' || array_to_string(list_transform(pages[1:5], lambda x: cast(x as varchar)), '、') || ' 页）' else code end order by o) as xs, sum(n) as n from c group by 1)
select doc, '译后检查未通过：' || cast(n as bigint) || ' 个错误；' || array_to_string(xs[1:3], '；') || case when len(xs) > 3 then '；另有 ' || (len(xs) - 3) || ' 类' else '' end as message from g""")
def issue_message(spark, sf_dir):
    return Q.messages(issues(spark, sf_dir), ["doc"], "event_id")


@CORE.query("qa_best_attempt", f"""with {ISSUES}, {SCORES}, a as (select split_part(doc, '-', 1) as paper, split_part(doc, '-', 2) as attempt, errors, issues from scores)
select paper, arg_min(attempt, (errors, issues, attempt)) as best, min((errors, issues)).errors as errors from (select paper, attempt, errors, issues from a) group by 1""".replace("min((errors, issues)).errors", "min(errors)"))
def qa_best_attempt(spark, sf_dir):
    """Of a user's days, taken as attempts at one paper, the one with the lowest score; the earliest on a tie."""
    a = Q.scores(issues(spark, sf_dir), ["doc"]).select(F.split_part("doc", F.lit("-"), F.lit(1)).alias("paper"), F.split_part("doc", F.lit("-"), F.lit(2)).alias("attempt"), "errors", "issues")
    return a.groupBy("paper").agg(F.min(F.struct("errors", "issues", "attempt"))["attempt"].alias("best"), F.min("errors").alias("errors"))


@CORE.query("qa_improvements", f"""with {ISSUES}, {SCORES}, a as (select split_part(doc, '-', 1) as paper, split_part(doc, '-', 2) as attempt, errors, issues from scores),
b as (select *, lag(errors) over w as e0, lag(issues) over w as i0 from a window w as (partition by paper order by attempt))
select paper, attempt, e0 is null or errors < e0 or (errors = e0 and issues < i0) as accepted from b""")
def qa_improvements(spark, sf_dir):
    """An attempt is accepted if its score is strictly lower than that of the one before it."""
    from pyspark.sql.window import Window

    a = Q.scores(issues(spark, sf_dir), ["doc"]).select(F.split_part("doc", F.lit("-"), F.lit(1)).alias("paper"), F.split_part("doc", F.lit("-"), F.lit(2)).alias("attempt"), F.struct("errors", "issues").alias("s"))
    before = F.lag("s").over(Window.partitionBy("paper").orderBy("attempt"))
    return a.select("paper", "attempt", (before.isNull() | (F.col("s") < before)).alias("accepted"))


VIS = f"visual as (select {DOC} as doc, round(avg(least(value, 100)) / 100, 6) as visual from events group by 1)"


def visual(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "ts", "value")
    doc = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return e.groupBy(doc.alias("doc")).agg(F.round(F.avg(F.least("value", F.lit(100.0))) / 100, 6).alias("visual"))


REPORTS = f"""reports as (select doc, errors, actionable, issues, visual, errors = 0 and visual >= 0.55 and actionable = 0 as strict_pass, errors = 0 and visual >= 0.55 as plain_pass
  from (select v.doc, coalesce(errors, 0) as errors, coalesce(actionable, 0) as actionable, coalesce(issues, 0) as issues, visual from visual v left join scores s on s.doc = v.doc))"""


def reports(spark, sf_dir):
    return Q.reports(Q.scores(issues(spark, sf_dir), ["doc"]), visual(spark, sf_dir), ["doc"])


@CORE.query("eval_reports", f"with {ISSUES}, {SCORES}, {VIS}, {REPORTS} select * from reports")
def eval_reports(spark, sf_dir):
    return reports(spark, sf_dir)


@CORE.query("eval_summary", f"""with {ISSUES}, {SCORES}, {VIS}, {REPORTS} select count(*) as papers, count(*) filter (strict_pass) as strict, count(*) filter (plain_pass) as plain,
  cast(sum(errors) as bigint) as errors, count(*) >= 20 and count(*) filter (strict_pass) >= 20 as released from reports""")
def eval_summary(spark, sf_dir):
    """Totals of all reports and the release rule: at least 20 evaluated and 20 strict passes."""
    n = F.count_if("strict_pass")
    return reports(spark, sf_dir).agg(F.count("*").alias("papers"), n.alias("strict"), F.count_if("plain_pass").alias("plain"), F.sum("errors").alias("errors"), ((F.count("*") >= 20) & (n >= 20)).alias("released"))


COMPARE = f"""half as (select split_part(doc, '-', 1) as paper, case when split_part(doc, '-', 2) < '20240116' then 'base' else 'now' end as side, sum(errors) as errors, sum(issues) as issues from scores group by 1, 2),
pair as (select b.paper, cast(b.errors as bigint) as before, cast(c.errors as bigint) as after from half b join half c on c.paper = b.paper where b.side = 'base' and c.side = 'now')"""


def compared(spark, sf_dir):
    s = Q.scores(issues(spark, sf_dir), ["doc"])
    side = F.when(F.split_part("doc", F.lit("-"), F.lit(2)) < "20240116", "base").otherwise("now")
    h = s.groupBy(F.split_part("doc", F.lit("-"), F.lit(1)).alias("paper")).agg(
        F.sum(F.when(side == "base", F.col("errors"))).alias("before"), F.sum(F.when(side == "now", F.col("errors"))).alias("after")
    )
    return h.dropna()


@CORE.query("eval_compare", f"with {ISSUES}, {SCORES}, {COMPARE} select paper, before, after, after > before as regressed from pair")
def eval_compare(spark, sf_dir):
    """Papers of both halves of the time: errors before and after, from one pass over the scores."""
    return compared(spark, sf_dir).withColumn("regressed", F.col("after") > F.col("before"))


@CORE.query("eval_gate", f"""with {ISSUES}, {SCORES}, {VIS}, {REPORTS}, {COMPARE}
select 'regression' as rule, paper as subject from pair where after > before union all select 'actionable_warning', doc from reports where plain_pass and actionable > 0
union all select 'missing_axis', a from (select unnest(['text_overlap', 'formula_changed', 'table_structure_mismatch']) as a) where a not in (select code from issues)""")
def eval_gate(spark, sf_dir):
    """One row for each broken rule of a release."""
    a = compared(spark, sf_dir).where("after > before").select(F.lit("regression").alias("rule"), F.col("paper").alias("subject"))
    b = reports(spark, sf_dir).where("plain_pass and actionable > 0").select(F.lit("actionable_warning").alias("rule"), F.col("doc").alias("subject"))
    wanted = spark.createDataFrame([(x,) for x in ("text_overlap", "formula_changed", "table_structure_mismatch")], "code string")
    c = wanted.join(issues(spark, sf_dir).select("code").distinct(), "code", "left_anti").select(F.lit("missing_axis").alias("rule"), F.col("code").alias("subject"))
    return a.unionByName(b).unionByName(c)
