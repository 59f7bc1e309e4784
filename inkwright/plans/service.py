"""Queries over a translation service: recovery of failed units, validation of rows, progress, ordered lists, and folds over pages."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwright.functions import geometry as X
from inkwright.functions.text import clean_hash
from inkwright.operators import folds
from inkwright.operators.recovery import plan, translated
from inkwright.plans.layout import SPANS, spans
from inkwright.plans.quality import ISSUES, LIST, HEAL, issues
from inkwright.plans.registry import CORE
from inkwright.plans.uploads import HASH
from inkwright.operators import quality as Q
from inkwright.sources.tables import table

class Forgetful:
    """A supplier that loses the last mark of a text with more marks than it can hold: one at first sight, two when asked again."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def __call__(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            marks = re.findall(r"⟦\d+⟧", t)
            most = 2 if t in self.seen else 1
            self.seen.add(t)
            out.append("译文 " + ("".join(t.rsplit(marks[-1], 1)) if len(marks) > most else t))
        return out


def marked_units(spark, sf_dir):
    c = table(spark, sf_dir, "corpus", "term_id", "en").select("term_id", F.coalesce("en", F.lit("")).alias("en"), (F.col("term_id") % 6).alias("k"), (F.col("term_id") % 4 >= 2).alias("long"))
    runs = F.when(F.col("k") > 0, F.transform(F.expr("sequence(0, greatest(k - 1, 0))"), lambda i: F.concat(F.lit(" "), "en", F.lit(" ⟦"), i.cast("string"), F.lit("⟧")))).otherwise(F.array().cast("array<string>"))
    joined = F.when(F.col("long"), F.array_join(runs, " and more" * 20 + ". ")).otherwise(F.array_join(runs, ""))
    return c.select("term_id", F.concat(F.lit("No "), F.col("term_id").cast("string"), joined).alias("text"))


@CORE.query("unit_recover", "select term_id, case when term_id % 6 <= 1 then 'kept' when term_id % 6 = 2 then 'retried' else 'prose' end as way from corpus")
def unit_recover(spark, sf_dir):
    """How each unit is brought through a supplier that loses marks: kept at first, when asked again, or by its prose alone."""
    return translated(marked_units(spark, sf_dir), "term_id", "text", Forgetful).select("term_id", "way")


@CORE.query("issue_planner", f"""with {ISSUES} select doc, case when bool_or(code in ({LIST(Q.LAYOUT)})) then 'repair_layout' when bool_or({HEAL}) then 'retranslate' else 'stop' end as by_rule, 'accept' as accept_all from issues group by 1""")
def issue_planner(spark, sf_dir):
    """The action of each registered planner for the issues of a document."""
    own = issues(spark, sf_dir).groupBy("doc").agg(F.collect_set(F.struct("severity", "code")).alias("xs"))
    return own.select("doc", plan("by_rule", F.col("xs")).alias("by_rule"), plan("accept_all", F.col("xs")).alias("accept_all"))


@CORE.query("paper_updates", """select id, nullif(trim(title, ' '), '') as title, nullif(trim(tags, ' '), '') as tags, nullif(trim(notes, ' '), '') as notes, coalesce(length(trim(title, ' ')), 0) between 1 and 500 and coalesce(length(trim(tags, ' ')), 0) <= 500 and coalesce(length(trim(notes, ' ')), 0) <= 2000 as valid from papers""")
def paper_updates(spark, sf_dir):
    """Fields of an update without outer blanks, empty ones as null, and whether they keep to their lengths."""
    own = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    n = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0))
    valid = n("title").between(1, 500) & (n("tags") <= 500) & (n("notes") <= 2000)
    return table(spark, sf_dir, "papers", "id", "title", "tags", "notes").select("id", own("title"), own("tags"), own("notes"), valid.alias("valid"))


@CORE.query("progress_map", """select id, round(least(0.95, greatest(0.05, 0.05 + 0.9 * least(1.0, greatest(0.0, coalesce(translation_progress, 0.0))))), 6)::double as shown from papers""")
def progress_map(spark, sf_dir):
    """The progress of one step as a part of the whole."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("translation_progress", F.lit(0.0))))
    return table(spark, sf_dir, "papers", "id", "translation_progress").select("id", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.05 + 0.9 * p)), 6).alias("shown"))


@CORE.query("progress_latest", """select id, max(struct_pack(t := updated_at, p := progress)).p as progress, count(*) as lines from (select distinct id, updated_at, progress from translation_jobs where id is not null and updated_at is not null and progress is not null) group by 1""")
def progress_latest(spark, sf_dir):
    """The last line of each job's progress."""
    j = table(spark, sf_dir, "translation_jobs", "id", "updated_at", "progress").dropna().distinct()
    return j.groupBy("id").agg(F.max(F.struct("updated_at", "progress"))["progress"].alias("progress"), F.count("*").alias("lines"))


@CORE.query("job_order", """select paper_id, list(id order by created_at, id) as jobs from (select paper_id, id, min(created_at) as created_at from translation_jobs where paper_id is not null and id is not null and created_at is not null group by 1, 2) group by 1""")
def job_order(spark, sf_dir):
    """The jobs of each paper, each once, in the order in which they were made."""
    j = table(spark, sf_dir, "translation_jobs", "paper_id", "id", "created_at").dropna().groupBy("paper_id", "id").agg(F.min("created_at").alias("t"))
    return j.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("jobs"))


@CORE.query("scope_listing", """select access_scope, min(created_at) as since, count(*) filter (translation_status = 'completed') as registered, count(*) filter (translation_status <> 'completed') as prepared from papers where access_scope is not null and created_at is not null group by 1 order by since, access_scope""")
def scope_listing(spark, sf_dir):
    """The scopes by their first paper, with the papers that are done and that are under way."""
    done = F.col("translation_status") == "completed"
    p = table(spark, sf_dir, "papers", "access_scope", "created_at", "translation_status").where("access_scope is not null and created_at is not null")
    return p.groupBy("access_scope").agg(F.min("created_at").alias("since"), F.count_if(done).alias("registered"), F.count_if(~done).alias("prepared")).orderBy("since", "access_scope")


@CORE.query("upload_validation", f"""with v as (select id, {HASH} as h, file_size, chunk_size, chunk_digests, original_filename from pdf_upload_sessions)
select id, case when coalesce(trim(original_filename, ' '), '') = '' then 'name' when file_size is null or file_size <= 0 then 'size' when chunk_size is null or chunk_size <= 0 then 'chunk size' when h is null or not regexp_matches(h, '^[0-9a-f]{{64}}$') or regexp_matches(h, '^0+$') then 'hash' when coalesce(len(chunk_digests), 0) = 0 then 'no chunks' when len(chunk_digests) <> (file_size + chunk_size - 1) // chunk_size then 'chunk count' else 'valid' end as outcome from v""")
def upload_validation(spark, sf_dir):
    """Each upload by the first rule of a complete one that it breaks."""
    u = table(spark, sf_dir, "pdf_upload_sessions", "id", "content_sha256", "file_size", "chunk_size", "chunk_digests", "original_filename")
    none = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    n = F.coalesce(F.size("chunk_digests"), F.lit(0))
    outcome = (
        F.when(F.coalesce(F.trim("original_filename"), F.lit("")) == "", "name").when(none("file_size"), "size").when(none("chunk_size"), "chunk size").when(clean_hash(F.col("content_sha256")).isNull(), "hash")
        .when(n <= 0, "no chunks").when(n != F.expr("(file_size + chunk_size - 1) div chunk_size"), "chunk count").otherwise("valid")
    )
    return u.select("id", outcome.alias("outcome"))


# Words of a source's running text that may be left behind alone.
CUES = "and are be being for from is or that then to was were where which with writing".split()


@CORE.query("prose_cues", f"""with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents where text is not null) select lower(w) as cue, count(*) as n, count(distinct doc_id) as texts from w where regexp_full_match(w, '(?i)({"|".join(CUES)})') group by 1""")
def prose_cues(spark, sf_dir):
    """Words that stand alone between blanks and belong to running English, by word."""
    w = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike(f"^(?i:{'|'.join(CUES)})$"))
    return w.groupBy(F.lower("w").alias("cue")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


@CORE.query("page_texts", """select paper_id, count(*) as pages, sum(length(t))::bigint as chars from (select paper_id, regexp_replace(text, '^[\\s\\x0b\\p{Z}]+|[\\s\\x0b\\p{Z}]+$', '', 'g') as t from documents where paper_id is not null) where t <> '' group by 1""")
def page_texts(spark, sf_dir):
    """The pages of each paper that hold more than white space."""
    t = table(spark, sf_dir, "documents", "paper_id", "text").where("paper_id is not null").select("paper_id", F.regexp_replace("text", r"^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$", "").alias("t"))
    return t.where("t <> ''").groupBy("paper_id").agg(F.count("*").alias("pages"), F.sum(F.length("t")).alias("chars"))


@CORE.query("page_counts", f"""with {SPANS}, n as (select doc, count(*) filter (side = 'R') as a, count(*) filter (side = 'N') as b from spans group by 1) select doc, a, b, round(case when a = 0 and b = 0 then 1.0 else least(a, b) / greatest(a, b) end, 6)::double as similarity from n""")
def page_counts(spark, sf_dir):
    """How alike the numbers of spans of a page and its translation are."""
    n = spans(spark, sf_dir).groupBy("doc").agg(F.count_if(F.col("side") == "R").alias("a"), F.count_if(F.col("side") == "N").alias("b"))
    return n.withColumn("similarity", F.round(X.count_similarity(F.col("a"), F.col("b")), 6))


COLUMN = "cl as (select doc, unnest([0, 1]) as col from (select distinct doc from spans))"


@CORE.query("reference_stops", f"""with {SPANS}, {COLUMN}, hd as (select doc, case when (x0 + x1) / 2 < 306 then 0 else 1 end as col, min(y0) as stop from spans where chars % 10 = 0 group by 1, 2), st as (select cl.doc, cl.col, coalesce(hd.stop, 792) as stop from cl left join hd using (doc, col)),
mk as (select s.doc, st.col, any_value(st.stop) as stop, count(*) as marks from spans s join st on st.doc = s.doc and st.col = case when (s.x0 + s.x1) / 2 < 306 then 0 else 1 end where s.chars % 6 = 1 and s.y0 < st.stop - 4 and s.y1 > 792 * 0.06 group by 1, 2)
select doc, col, greatest(0, stop - 4) as bottom, marks from mk where marks >= 2""")
def reference_stops(spark, sf_dir, width=612.0, height=792.0):
    """How far references that go on from the page before reach down in each column: to its first heading, if at least two entries
    stand above it. Remainders of the length stand for headings and entries."""
    column = F.when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1)
    s = spans(spark, sf_dir).withColumn("col", column)
    stops = s.where("chars % 10 = 0").groupBy("doc", "col").agg(F.min("y0").alias("stop"))
    marks = s.where("chars % 6 = 1").join(stops, ["doc", "col"], "left").withColumn("stop", F.coalesce("stop", F.lit(height))).where((F.col("y0") < F.col("stop") - 4) & (F.col("y1") > height * 0.06))
    g = marks.groupBy("doc", "col").agg(F.max("stop").alias("stop"), F.count("*").alias("marks")).where("marks >= 2")
    return g.select("doc", "col", F.greatest(F.lit(0.0), F.col("stop") - 4).alias("bottom"), "marks")


RUNS = """rn as (select doc, x0 + i * (9 + chars % 4) as x0, y0 + 0.5 * i as y0, x0 + i * (9 + chars % 4) + 10 as x1, y1 + 0.5 * i as y1, row_number() over (partition by doc order by y0, x0, x1, y1, chars, size, style, i) as n from (select *, unnest([0, 1, 2]) as i from spans where side = 'A'))"""
BOXES = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]))


@F.pandas_udf(BOXES)
def _coalesced(runs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in runs:
        yield s.map(lambda xs: [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in folds.coalesce_runs([(x["x0"], x["y0"], x["x1"], x["y1"]) for x in xs])])


@CORE.query("hidden_runs", f"""with recursive {SPANS}, {RUNS}, r(doc, n, g, x0, y0, x1, y1) as (select doc, n, 1, x0, y0, x1, y1 from rn where n = 1
  union all select doc, n, case when same then g else g + 1 end, case when same then least(px0, x0) else x0 end, case when same then least(py0, y0) else y0 end, case when same then greatest(px1, x1) else x1 end, case when same then greatest(py1, y1) else y1 end
  from (select rn.*, r.g, r.x0 as px0, r.y0 as py0, r.x1 as px1, r.y1 as py1, abs((rn.y0 + rn.y1) / 2 - (r.y0 + r.y1) / 2) <= 1.5 and rn.x0 - r.x1 between -0.5 and 2.5 as same from r join rn on rn.doc = r.doc and rn.n = r.n + 1))
select doc, x0, y0, x1, y1 from (select *, row_number() over (partition by doc, g order by n desc) as k from r) where k = 1""")
def hidden_runs(spark, sf_dir):
    """Hidden runs of a page, of which neighbours grow into one. Each graphic region gives three runs; those of a page are few."""
    s = spans(spark, sf_dir).where("side = 'A'").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    move = F.col("i") * (9 + F.col("chars") % 4)
    order = [F.col(c) for c in ("y0", "x0", "x1", "y1", "chars", "size", "style", "i")]
    box = F.struct((F.col("x0") + move).alias("x0"), (F.col("y0") + 0.5 * F.col("i")).alias("y0"), (F.col("x0") + move + 10).alias("x1"), (F.col("y1") + 0.5 * F.col("i")).alias("y1"))
    pages = s.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), box.alias("b")))), lambda x: x["b"]).alias("bs"))
    return pages.select("doc", F.inline(_coalesced("bs")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rows(centers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in centers:
        yield s.map(lambda xs: folds.row_groups(xs))


@CORE.query("aligned_rows")
def aligned_rows(spark, sf_dir):
    """The rows of a page's translated spans, each within 2.5 points of the median of its row so far, and how many spans they hold."""
    pages = spans(spark, sf_dir).where("side = 'N'").groupBy("doc").agg(F.array_sort(F.collect_list((F.col("y0") + F.col("y1")) / 2)).alias("cs"))
    rows = pages.select("doc", F.explode(_rows("cs")).alias("row"))
    return rows.groupBy("doc", "row").agg(F.count("*").alias("spans"))
