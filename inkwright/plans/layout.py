"""Queries over boxes, spans, rules and profiles. Lines of orders stand for spans on a page (eight orders make one), and
embeddings for the ink of a page's 64 zones; both are derived the same way on either side of a check."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from inkwright.functions import geometry as X
from inkwright.operators.folds import anchor_clusters
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

SPANS = """spans as (select distinct l_orderkey // 8 as doc, l_returnflag as side, l_linestatus as style, cast(l_partkey % 400 as double) as x0, cast(l_suppkey * 7 % 600 as double) as y0,
  cast(l_partkey % 400 + l_quantity * 4 as double) as x1, cast(l_suppkey * 7 % 600 + 8 + l_linenumber * 6 as double) as y1, cast(6 + l_quantity / 7 as double) as size, cast(l_partkey % 40 + 1 as bigint) as chars from lineitem)"""


def spans(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return t.select(
        F.expr("l_orderkey div 8").alias("doc"), F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("style"),
        F.expr("double(l_partkey % 400)").alias("x0"), F.expr("double(l_suppkey * 7 % 600)").alias("y0"), F.expr("double(l_partkey % 400 + l_quantity * 4)").alias("x1"),
        F.expr("double(l_suppkey * 7 % 600 + 8 + l_linenumber * 6)").alias("y1"), F.expr("double(6 + l_quantity / 7)").alias("size"), F.expr("l_partkey % 40 + 1").alias("chars"),
    ).distinct()


@CORE.query("font_mode", f"""with {SPANS}, w as (select doc, round_even(size, 2) as size, cast(sum(chars) as bigint) as chars, cast(sum(chars) filter (style = 'F') as bigint) as bold from spans group by 1, 2)
select doc, arg_max(size, (chars, size)) as size, round(coalesce(sum(bold), 0) / sum(chars), 6) as bold_share from w group by 1""")
def font_mode(spark, sf_dir):
    """The size that most characters have (ties: the larger), and the share of bold ones."""
    w = spans(spark, sf_dir).groupBy("doc", F.bround("size", 2).alias("size")).agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("style") == "F", F.col("chars"))).alias("bold"))
    return w.groupBy("doc").agg(F.max(F.struct("chars", "size"))["size"].alias("size"), F.round(F.coalesce(F.sum("bold"), F.lit(0)) / F.sum("chars"), 6).alias("bold_share"))


@CORE.query("font_cohorts", f"""with {SPANS}, p as (select doc, median(size) as page, count(*) as n from spans group by 1), c as (select doc, style, median(size) as own, count(*) as n from spans group by 1, 2)
select s.doc, count(*) as drifting from spans s join p on p.doc = s.doc join c on c.doc = s.doc and c.style = s.style
where p.n >= 3 and abs(s.size - case when c.n >= 2 then c.own else p.page end) > 0.25 * case when c.n >= 2 then c.own else p.page end group by 1""")
def font_cohorts(spark, sf_dir):
    """Spans whose size drifts from the median of their style, or of the page where a style has but one."""
    s = spans(spark, sf_dir)
    page = s.groupBy("doc").agg(F.median("size").alias("page"), F.count("*").alias("n"))
    own = s.groupBy("doc", "style").agg(F.median("size").alias("own"), F.count("*").alias("c"))
    base = F.when(F.col("c") >= 2, F.col("own")).otherwise(F.col("page"))
    return s.join(page.where("n >= 3"), "doc").join(own, ["doc", "style"]).where(F.abs(F.col("size") - base) > 0.25 * base).groupBy("doc").agg(F.count("*").alias("drifting"))


@CORE.query("sibling_spread", f"""with {SPANS} select doc, style, cast(floor(x0 / 24) as bigint) as bucket, count(*) as n, min(size) as least, max(size) as most from spans
group by 1, 2, 3 having count(*) >= 2 and max(size) / min(size) > 1.05""")
def sibling_spread(spark, sf_dir):
    """Lists of one style and column whose sizes differ."""
    g = spans(spark, sf_dir).groupBy("doc", "style", F.expr("bigint(floor(x0 / 24))").alias("bucket")).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    return g.where("n >= 2 and most / least > 1.05")


OVER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@CORE.query("bbox_best_match", f"""with {SPANS}, m as (select a.doc, a.x0, a.y0, a.x1, a.y1, b.x0 as bx, b.y0 as byy, {OVER} as o, (a.x1 - a.x0) * (a.y1 - a.y0) as sa, (b.x1 - b.x0) * (b.y1 - b.y0) as sb
  from (select distinct doc, x0, y0, x1, y1 from spans where side = 'N') a join (select distinct doc, x0, y0, x1, y1 from spans where side <> 'N') b on b.doc = a.doc)
select doc, x0, y0, x1, y1, bx, byy, round(score, 6) as score from (select *, o * o / (sa * sb) as score, row_number() over (partition by doc, x0, y0, x1, y1 order by round(o * o / (sa * sb), 9) desc, bx, byy) as r from m where o > 0.25 * sa) where r = 1""")
def bbox_best_match(spark, sf_dir):
    """For each block of a page the source block with the best mutual overlap. Pages are joined by key; an argmax picks."""
    b = spans(spark, sf_dir).select("doc", "side", F.struct("x0", "y0", "x1", "y1").alias("b")).distinct()
    a, c = b.where("side = 'N'").drop("side"), b.where("side <> 'N'").select("doc", F.col("b").alias("c")).distinct()
    o = X.overlap(F.col("b"), F.col("c"))
    m = a.join(c, "doc").withColumn("o", o).where(F.col("o") > 0.25 * X.area(F.col("b")))
    m = m.withColumn("score", F.col("o") * F.col("o") / (X.area(F.col("b")) * X.area(F.col("c"))))
    best = m.groupBy("doc", "b").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("c.x0").alias("bx"), F.col("c.y0").alias("byy"), "score")).alias("w"))
    return best.select("doc", "b.x0", "b.y0", "b.x1", "b.y1", "w.bx", "w.byy", F.round("w.score", 6).alias("score"))


@CORE.query("region_exclusion", f"""with {SPANS}, a as (select distinct doc, x0, y0, x1, y1 from spans where side = 'N'), b as (select distinct doc, x0, y0, x1, y1 from spans where side = 'R')
select * from a where not exists (select 1 from b where b.doc = a.doc and {OVER} > 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0)))""")
def region_exclusion(spark, sf_dir):
    """Blocks that no preserved region covers by more than 0.3."""
    b = spans(spark, sf_dir).select("doc", "side", F.struct("x0", "y0", "x1", "y1").alias("b")).distinct()
    r = b.where("side = 'R'").select(F.col("doc").alias("d"), F.col("b").alias("c"))
    a = b.where("side = 'N'")
    out = a.join(r, (F.col("d") == F.col("doc")) & (X.overlap(F.col("b"), F.col("c")) > 0.3 * X.area(F.col("b"))), "left_anti")
    return out.select("doc", "b.x0", "b.y0", "b.x1", "b.y1")


@CORE.query("rule_clusters", f"""with {SPANS}, r as (select distinct doc, y0 as y, x0, x1 from spans),
l as (select *, lag(y) over w as py, lag(x0) over w as p0, lag(x1) over w as p1 from r window w as (partition by doc order by y, x0, x1)),
c as (select *, sum(case when py is null or y - py > 70 or least(x1, p1) - greatest(x0, p0) <= 0.5 * least(x1 - x0, p1 - p0) then 1 else 0 end) over (partition by doc order by y, x0, x1 rows unbounded preceding) as k from l)
select doc, min(y) as top, max(y) as bottom, count(*) as rules from c group by doc, k having count(*) between 3 and 16 and max(y) - min(y) >= 18""")
def rule_clusters(spark, sf_dir):
    """Stacked rules that may be a table: gaps and islands within a page."""
    r = spans(spark, sf_dir).select("doc", F.col("y0").alias("y"), "x0", "x1").distinct()
    w = Window.partitionBy("doc").orderBy("y", "x0", "x1")
    p = lambda c: F.lag(c).over(w)
    new = p("y").isNull() | (F.col("y") - p("y") > 70) | (F.least(F.col("x1"), p("x1")) - F.greatest(F.col("x0"), p("x0")) <= 0.5 * F.least(F.col("x1") - F.col("x0"), p("x1") - p("x0")))
    c = r.withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.groupBy("doc", "k").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("rules")).drop("k")
    return c.where("rules between 3 and 16 and bottom - top >= 18")


@F.pandas_udf(ArrayType(DoubleType()))
def _anchors(lefts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in lefts:
        yield s.map(lambda xs: anchor_clusters(xs, 100.0))


@CORE.query("column_clusters", f"""with recursive {SPANS}, l as (select distinct doc, round_even(x0 / 10, 0) * 10 as x from spans where x1 - x0 >= 72), a(doc, x) as (select doc, min(x) from l group by 1 union all select doc, x from (select a.doc, min(l.x) as x from a join l on l.doc = a.doc and l.x > a.x + 100 group by a.doc, a.x))
select doc, string_agg(cast(cast(x as decimal(9, 1)) as varchar), ',' order by x) as anchors from a group by 1""")
def column_clusters(spark, sf_dir):
    """The columns of a page: left edges of wide blocks, clustered from an anchor. Distinct edges of a page are bounded by its width."""
    wide = spans(spark, sf_dir).where("x1 - x0 >= 72").groupBy("doc").agg(F.collect_set(F.bround(F.col("x0") / 10) * 10).alias("lefts"))
    return wide.select("doc", F.array_join(_anchors("lefts").cast("array<string>"), ",").alias("anchors"))


@CORE.query("layout_classify", f"""with {SPANS}, g as (select doc, least(3, greatest(1, count(distinct round_even(x0 / 150, 0)))) as columns, count(*) as n, list_sort(list(y1 - y0))[count(*) // 2 + 1] as upper, mode(style) as m, bool_or(side = 'R') as ieee from spans group by 1)
select doc, cast(columns as bigint) as columns, case when columns >= 2 and ieee then 'ieee_two_column' when columns >= 2 then 'generic_two_column' else 'single_column' end as profile,
  case when upper < 18 then 'compact' else 'loose' end as captions, case when columns >= 2 and ieee then 46.0::double else 36.0::double end as extra from g""")
def layout_classify(spark, sf_dir):
    """The family of a page's layout, by an ordered ladder, with its policy; captions by the upper median of heights."""
    g = spans(spark, sf_dir).groupBy("doc").agg(
        F.least(F.lit(3), F.greatest(F.lit(1), F.countDistinct(F.bround(F.col("x0") / 150)))).cast("long").alias("columns"),
        F.expr("percentile_disc(0.5) within group (order by y1 - y0 desc)").alias("upper"), F.bool_or(F.col("side") == "R").alias("ieee"),
    )
    two = F.col("columns") >= 2
    profile = F.when(two & F.col("ieee"), "ieee_two_column").when(two, "generic_two_column").otherwise("single_column")
    upper = F.col("upper")  # of an even number the upper one, since the order falls
    return g.select("doc", "columns", profile.alias("profile"), F.when(upper < 18, "compact").otherwise("loose").alias("captions"), F.when(two & F.col("ieee"), 46.0).otherwise(36.0).alias("extra"))


@CORE.query("line_gaps", f"""with {SPANS}, g as (select doc, y0 - lag(y0) over (partition by doc, floor(x0 / 24) order by y0, x0, x1, y1, size, chars, side, style) as gap from spans) select doc, median(gap) as gap from g where gap between 0 and 40 group by 1""")
def line_gaps(spark, sf_dir):
    """The median gap between neighbouring lines of a column."""
    w = Window.partitionBy("doc", F.floor(F.col("x0") / 24)).orderBy("y0", "x0", "x1", "y1", "size", "chars", "side", "style")
    return spans(spark, sf_dir).select("doc", (F.col("y0") - F.lag("y0").over(w)).alias("gap")).where("gap between 0 and 40").groupBy("doc").agg(F.median("gap").alias("gap"))


@CORE.query("table_like", f"""with {SPANS}, b as (select doc, floor(y0 / 8) as k, count(*) as n from spans where x1 - x0 <= 160 group by 1, 2 having count(*) >= 2) select doc, count(*) as bands from b group by 1 having count(*) >= 3""")
def table_like(spark, sf_dir):
    """Pages with three bands or more of narrow boxes."""
    b = spans(spark, sf_dir).where("x1 - x0 <= 160").groupBy("doc", F.floor(F.col("y0") / 8).alias("k")).agg(F.count("*").alias("n")).where("n >= 2")
    return b.groupBy("doc").agg(F.count("*").alias("bands")).where("bands >= 3")


@CORE.query("style_modes", f"""with {SPANS}, n as (select doc, chars, count(*) as n from spans group by 1, 2) select doc, arg_min(chars, (-n, chars)) as mode from n group by 1""")
def style_modes(spark, sf_dir):
    """The most frequent length of a page's spans; the smallest on a tie."""
    return spans(spark, sf_dir).groupBy("doc").agg(F.mode("chars", True).alias("mode"))


PAIRS = "pairs as (select a.vec_id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@CORE.query("vis_score", f"""with {PAIRS}, z as (select vec_id, list_transform(range(1, 65), lambda i: greatest(0, 1 - abs(abs(a[i]::double) - abs(b[i]::double)) / greatest(abs(a[i]::double), abs(b[i]::double), 0.02))) as z,
  list_sum(list_transform(a, lambda x: abs(x::double))) / 64 as ia, list_sum(list_transform(b, lambda x: abs(x::double))) / 64 as ib from pairs),
s as (select vec_id, list_avg(z) as mean_zone, list_min(z) as min_zone, greatest(0, 1 - abs(ia - ib) / greatest(ia, ib, 0.02)) as whole from z),
t as (select vec_id, round(0.55 * whole + 0.22 * mean_zone + 0.08 * min_zone + 0.15, 6) as score, round(min_zone, 6) as min_zone from s)
select vec_id, score, min_zone, case when score < 0.45 or min_zone < 0.20 then 'high' when score < 0.72 or min_zone < 0.45 then 'medium' else 'low' end as risk from t""")
def vis_score(spark, sf_dir):
    """How alike two pages are by the ink of their zones, and the risk."""
    ink = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    p = pairs(spark, sf_dir).select("vec_id", ink("a").alias("a"), ink("b").alias("b")).withColumn("z", F.zip_with("a", "b", X.ink_similarity))
    whole = X.ink_similarity(total("a") / 64, total("b") / 64)
    p = p.select("vec_id", F.round(0.55 * whole + 0.22 * total("z") / 64 + 0.08 * F.array_min("z") + 0.15, 6).alias("score"), F.round(F.array_min("z"), 6).alias("min_zone"))
    return p.withColumn("risk", X.risk(F.col("score"), F.lit(1.0), F.col("min_zone")))


CELLS = "list_filter(range(0, 64), lambda i: abs({c}[i + 1]::double) > 0.15)"
NEAR = "list_distinct(flatten(list_transform({m}, lambda i: list_transform(list_filter(range(0, 9), lambda k: i % 8 + k % 3 - 1 between 0 and 7 and i // 8 + k // 3 - 1 between 0 and 7), lambda k: i + k % 3 - 1 + 8 * (k // 3 - 1)))))"


@CORE.query("mask_coverage", f"""with {PAIRS}, m as (select vec_id, {CELLS.format(c='a')} as ma, {CELLS.format(c='b')} as mb from pairs),
d as (select *, {NEAR.format(m='ma')} as da, {NEAR.format(m='mb')} as db from m)
select vec_id, round(case when len(ma) = 0 and len(mb) = 0 then 1.0::double when len(ma) = 0 or len(mb) = 0 then 0.0::double
  else least(len(list_intersect(ma, db)) / len(ma), len(list_intersect(mb, da)) / len(mb)) end, 6) as coverage from d""")
def mask_coverage(spark, sf_dir):
    """How far two masks of cells cover each other when each may shift by one cell."""
    cells = lambda c: F.filter(F.transform(c, lambda x, i: F.when(F.abs(x.cast("double")) > 0.15, i)), lambda i: i.isNotNull())

    def near(m):
        around = lambda i: F.filter(
            F.transform(F.array(*map(F.lit, range(9))), lambda k: F.struct((i % 8 + k % 3 - 1).alias("x"), (F.floor(i / 8) + F.floor(k / 3) - 1).cast("int").alias("y"))),
            lambda p: p["x"].between(0, 7) & p["y"].between(0, 7),
        )
        return F.array_distinct(F.flatten(F.transform(m, lambda i: F.transform(around(i), lambda p: p["x"] + 8 * p["y"]))))

    p = pairs(spark, sf_dir).select("vec_id", cells("a").alias("ma"), cells("b").alias("mb"))
    share = lambda m, d: F.size(F.array_intersect(m, d)) / F.nullif(F.size(m), F.lit(0))
    none = (F.size("ma") == 0, F.size("mb") == 0)
    both = F.least(share(F.col("ma"), near(F.col("mb"))), share(F.col("mb"), near(F.col("ma"))))
    return p.select("vec_id", F.round(F.when(none[0] & none[1], 1.0).when(none[0] | none[1], 0.0).otherwise(both), 6).alias("coverage"))


@CORE.query("page_samples", """
select id, array_to_string(list_transform(case when page_count <= 5 then range(0, page_count) else list_transform(range(0, 5), lambda i: cast(round_even(i * (page_count - 1) / 4, 0) as bigint)) end, lambda x: cast(x as varchar)), ',') as pages from papers where page_count is not null""")
def page_samples(spark, sf_dir):
    """Five pages evenly over a paper, both ends included; halves go to the even page."""
    n = F.col("page_count")
    few = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    even = F.transform(F.array(*map(F.lit, range(5))), lambda i: F.bround(i * (n - 1) / 4).cast("int"))
    return table(spark, sf_dir, "papers", "id", "page_count").where(n.isNotNull()).select("id", F.array_join(F.when(n <= 5, few).otherwise(even).cast("array<string>"), ",").alias("pages"))


@CORE.query("qa_seconds", """select id, cast(greatest(15, least(180, round_even((10 + greatest(1, coalesce(page_count, 1)) * 1.4::double) * 1.35::double, 0))) as bigint) as seconds from papers""")
def qa_seconds(spark, sf_dir):
    """The estimated seconds of a paper's check."""
    pages = F.greatest(F.lit(1), F.coalesce("page_count", F.lit(1)))
    return table(spark, sf_dir, "papers", "id", "page_count").select("id", F.greatest(F.lit(15), F.least(F.lit(180), F.bround((10 + pages * 1.4) * 1.35))).cast("long").alias("seconds"))


@CORE.query("scope_sets", """
select scope, cast(max(p) as int) as in_papers, cast(max(u) as int) as in_uploads from (select lower(trim(access_scope)) as scope, 1 as p, 0 as u from papers
  union all select lower(trim(access_scope)), 0, 1 from pdf_upload_sessions) group by 1""")
def scope_sets(spark, sf_dir):
    """Union of the scopes of papers and uploads, with where each occurs: their intersection and differences."""
    s = lambda t, p: table(spark, sf_dir, t, "access_scope").select(F.lower(F.trim("access_scope")).alias("scope"), F.lit(p).alias("p"), F.lit(1 - p).alias("u"))
    return s("papers", 1).unionByName(s("pdf_upload_sessions", 0)).groupBy("scope").agg(F.max("p").alias("in_papers"), F.max("u").alias("in_uploads"))
