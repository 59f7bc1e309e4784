"""Queries over the pages of a document and its translation, on the spans of plans.layout: of eight orders each, which make a page, the
lines returned with N are its translated spans, those with R the spans of the source (with linestatus F its captions) and those with
A its graphic regions. A span's number of characters stands for its text. A join stays within a page, whose spans are few."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwright.functions import geometry as X
from inkwright.operators.library import first_per_key
from inkwright.plans.layout import SPANS, spans
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

BOX = ("x0", "y0", "x1", "y1")
SIDES = f"""{SPANS}, b as (select * from spans where side = 'N'), s as (select * from spans where side = 'R'), g as (select doc, x0 as gx0, y0 as gy0, x1 as gx1, y1 as gy1 from spans where side = 'A'),
c as (select doc, x0 as cx0, y0 as cy0, x1 as cx1, y1 as cy1, case when chars % 2 = 0 then 'figure' else 'table' end as kind from spans where side = 'R' and style = 'F')"""
OVER = "greatest(0, least({0}x1, {1}x1) - greatest({0}x0, {1}x0)) * greatest(0, least({0}y1, {1}y1) - greatest({0}y0, {1}y0))"


def side(spark, sf_dir, which, prefix=""):
    """The spans of one side; with a prefix, only page and box, by names with it."""
    df = spans(spark, sf_dir).where(F.col("side") == which)
    return df.select("doc", *(F.col(c).alias(prefix + c) for c in BOX)) if prefix else df


def captions(spark, sf_dir):
    s = spans(spark, sf_dir).where("side = 'R' and style = 'F'")
    return s.select("doc", *(F.col(c).alias("c" + c) for c in BOX), F.when(F.col("chars") % 2 == 0, "figure").otherwise("table").alias("kind"))


def overlap(a="", b="g"):
    return F.greatest(F.lit(0), F.least(a + "x1", b + "x1") - F.greatest(a + "x0", b + "x0")) * F.greatest(F.lit(0), F.least(a + "y1", b + "y1") - F.greatest(a + "y0", b + "y0"))


ACROSS = "least(gx1, cx1) - greatest(gx0, cx0) >= 0.25 * least(greatest(1, gx1 - gx0), greatest(1, cx1 - cx0))"


def across():
    wide = lambda p: F.greatest(F.lit(1.0), F.col(p + "x1") - F.col(p + "x0"))
    return F.least("gx1", "cx1") - F.greatest("gx0", "cx0") >= 0.25 * F.least(wide("g"), wide("c"))


@CORE.query("figure_regions", f"""with {SIDES} select distinct g.* from g join c on c.doc = g.doc where kind = 'figure' and {ACROSS} and (cy0 - gy1 between -16 and 180 or gy0 - cy1 between -16 and 80)""")
def figure_regions(spark, sf_dir):
    """Graphic regions with a figure's caption below or above them."""
    both = side(spark, sf_dir, "A", "g").join(captions(spark, sf_dir).where("kind = 'figure'"), "doc").where(across() & ((F.col("cy0") - F.col("gy1")).between(-16, 180) | (F.col("gy0") - F.col("cy1")).between(-16, 80)))
    return both.select("doc", "gx0", "gy0", "gx1", "gy1").distinct()


@CORE.query("regions_above_captions", f"""with {SIDES} select distinct g.* from g join c on c.doc = g.doc where kind = 'figure' and {ACROSS} and cy0 - gy1 between -16 and 180""")
def regions_above_captions(spark, sf_dir):
    """Regions that a figure's caption follows."""
    both = side(spark, sf_dir, "A", "g").join(captions(spark, sf_dir).where("kind = 'figure'"), "doc").where(across() & (F.col("cy0") - F.col("gy1")).between(-16, 180))
    return both.select("doc", "gx0", "gy0", "gx1", "gy1").distinct()


@CORE.query("nearest_column", f"""with {SPANS}, col as (select doc, style, min(x0) as left_margin from spans group by 1, 2)
select b.doc, b.x0, b.y0, b.x1, b.y1, b.chars, b.size, b.style, b.side, arg_min(left_margin, (abs(b.x0 - left_margin), left_margin)) as left_margin from spans b join col on col.doc = b.doc group by 1, 2, 3, 4, 5, 6, 7, 8, 9""")
def nearest_column(spark, sf_dir):
    """Of a page's columns the one whose left margin is nearest to a block; the left one of two."""
    s = spans(spark, sf_dir)
    columns = s.groupBy("doc", "style").agg(F.min("x0").alias("m")).groupBy("doc").agg(F.collect_set("m").alias("ms"))
    near = F.array_min(F.transform("ms", lambda m: F.struct(F.abs(F.col("x0") - m).alias("d"), m.alias("m"))))["m"]
    return s.join(columns, "doc").select("doc", *BOX, "chars", "size", "style", "side", near.alias("left_margin"))


@CORE.query("blocks_on_graphics", f"""with {SIDES} select distinct b.doc, b.x0, b.y0, b.x1, b.y1 from b join g on g.doc = b.doc where {OVER.format('', 'g')} > 0.5 * (x1 - x0) * (y1 - y0)""")
def blocks_on_graphics(spark, sf_dir):
    """Blocks of which more than half lies on a graphic."""
    both = side(spark, sf_dir, "N").join(side(spark, sf_dir, "A", "g"), "doc").where(overlap() > 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return both.select("doc", *BOX).distinct()


@CORE.query("hidden_spans", f"""with {SIDES} select b.doc, b.x0, b.y0, b.x1, b.y1, count(*) as runs from b join (select doc, x0 as gx0, y0 as gy0, x1 as gx1, y1 as gy1, chars % 8 as k from s) h on h.doc = b.doc and h.k = b.chars % 8
where {OVER.format('', 'g')} >= 0.8 * least((gx1 - gx0) * (gy1 - gy0), (x1 - x0) * (y1 - y0)) group by 1, 2, 3, 4, 5""")
def hidden_spans(spark, sf_dir):
    """Spans that repeat the text of a hidden run at its place. Texts are taken as equal by the remainder of their length."""
    runs = side(spark, sf_dir, "R").select("doc", *(F.col(c).alias("g" + c) for c in BOX), (F.col("chars") % 8).alias("k"))
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    both = side(spark, sf_dir, "N").withColumn("k", F.col("chars") % 8).join(runs, ["doc", "k"]).where(overlap() >= 0.8 * F.least(area("g"), area("")))
    return both.groupBy("doc", *BOX).agg(F.count("*").alias("runs"))


PAIR = "least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 4.5"
KEYED = "k as (select *, row_number() over (partition by doc, side order by y0, x0, x1, y1, chars, size, style) as i from spans)"


@CORE.query("reference_overlaps", f"""with {SPANS}, {KEYED}, p as (select a.doc, a.side, a.i as i, b.i as j, a.chars as ca, b.chars as cb from k a join k b on a.doc = b.doc and a.side = b.side and a.i < b.i where {PAIR} and a.chars <> b.chars and a.chars >= 4 and b.chars >= 4),
src as (select distinct doc, least(ca, cb) as lo, greatest(ca, cb) as hi from p where side = 'R'), f as (select p.* from p left join src on src.doc = p.doc and src.lo = least(ca, cb) and src.hi = greatest(ca, cb) where p.side = 'N' and src.doc is null)
select doc, cast(i as int) as i, cast(j as int) as j from (select *, row_number() over (partition by doc order by i, j) as r from f) where r <= 3""")
def reference_overlaps(spark, sf_dir):
    """Pairs of spans with different texts that run into each other where the source's own don't; the first three of a page."""
    order = Window.partitionBy("doc", "side").orderBy("y0", "x0", "x1", "y1", "chars", "size", "style")
    k = spans(spark, sf_dir).withColumn("i", F.row_number().over(order))
    a, b = k.select("doc", "side", *BOX, "i", F.col("chars").alias("ca")), k.select("doc", "side", *(F.col(c).alias("g" + c) for c in BOX), F.col("i").alias("j"), F.col("chars").alias("cb"))
    p = a.join(b, ["doc", "side"]).where("i < j and ca <> cb and ca >= 4 and cb >= 4").where((F.least("x1", "gx1") - F.greatest("x0", "gx0") > 5) & (F.least("y1", "gy1") - F.greatest("y0", "gy0") > 4.5))
    p = p.withColumns({"lo": F.least("ca", "cb"), "hi": F.greatest("ca", "cb")})
    new = p.where("side = 'N'").join(p.where("side = 'R'").select("doc", "lo", "hi").distinct(), ["doc", "lo", "hi"], "left_anti")
    return first_per_key(new, ["doc"], [F.asc("i"), F.asc("j")], 3).select("doc", "i", "j")


@CORE.query("residual_spans", f"""with {SIDES}, t as (select doc, style, chars, x0 + 0.1 * (chars % 5) as tx0, y0 as ty0, x1 + 0.1 * (chars % 5) as tx1, y1 as ty1 from s)
select distinct s.doc, s.chars, s.x0, s.y0 from s join t on t.doc = s.doc and t.style = s.style and t.chars = s.chars where abs(tx0 - x0) <= 0.35 and abs(ty0 - y0) <= 0.35 and abs(tx1 - x1) <= 0.35 and abs(ty1 - y1) <= 0.35""")
def residual_spans(spark, sf_dir):
    """Spans of the source that are found again in the translation, by text, font and box; the translation moves each a little."""
    s = side(spark, sf_dir, "R")
    by = 0.1 * (F.col("chars") % 5)
    t = s.select("doc", "style", "chars", (F.col("x0") + by).alias("tx0"), F.col("y0").alias("ty0"), (F.col("x1") + by).alias("tx1"), F.col("y1").alias("ty1"))
    near = [F.abs(F.col("t" + c) - F.col(c)) <= 0.35 for c in BOX]
    return s.join(t, ["doc", "style", "chars"]).where(near[0] & near[1] & near[2] & near[3]).select("doc", "chars", "x0", "y0").distinct()


@CORE.query("size_in_box", f"""with {SIDES}, m as (select g.*, size, chars, style from g join spans s on s.doc = g.doc where s.side <> 'A' and {OVER.format('', 'g')} >= 0.45 * (x1 - x0) * (y1 - y0)),
p as (select *, bool_or(style = 'F') over (partition by doc, gx0, gy0, gx1, gy1) as wide from m), w as (select doc, gx0, gy0, gx1, gy1, round_even(size, 2) as size, sum(greatest(chars, 1)) as n from p where style = 'F' or not wide group by 1, 2, 3, 4, 5, 6)
select doc, gx0, gy0, gx1, gy1, arg_max(size, (n, size)) as size from w group by 1, 2, 3, 4, 5""")
def size_in_box(spark, sf_dir):
    """The size that most characters within a region have, of spans that lie in it by 45 percent; wide ones count alone if there are any."""
    box = ["doc", "gx0", "gy0", "gx1", "gy1"]
    m = side(spark, sf_dir, "A", "g").join(spans(spark, sf_dir).where("side <> 'A'"), "doc").where(overlap() >= 0.45 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    w = m.groupBy(*box, F.bround("size", 2).alias("size")).agg(F.sum(F.greatest("chars", F.lit(1))).alias("n"), F.sum(F.when(F.col("style") == "F", F.greatest("chars", F.lit(1)))).alias("wide"))
    best = w.groupBy(*box).agg(F.max(F.when(F.col("wide").isNotNull(), F.struct("wide", "size")))["size"].alias("wide"), F.max(F.struct("n", "size"))["size"].alias("size"))
    return best.select(*box, F.coalesce("wide", "size").alias("size"))


@CORE.query("column_layout", f"""with {SPANS}, b as (select doc, x0, x1 - x0 as w, chars, row_number() over (partition by doc order by y0, x0, x1, y1, chars, size, style, side) as o from spans where y1 - y0 >= 8 and x1 - x0 >= 20 and size >= 6),
m as (select doc, x0, sum(chars) as n, min(o) as o from b group by 1, 2), f as (select doc, max(struct_pack(n := n, o := -o, x0 := x0)).x0 as x0 from m group by 1),
g as (select m.doc, max(struct_pack(n := m.n, o := -m.o, x0 := m.x0)).x0 as x0 from m join f on f.doc = m.doc where abs(m.x0 - f.x0) > 150 group by 1), c as (select doc, x0 from f union all select doc, x0 from g)
select c.doc, c.x0 as left_margin, max(struct_pack(full := w > 120, n := n, o := -o, w := w)).w as col_width from c join (select doc, x0, w, count(*) as n, min(o) as o from b group by 1, 2, 3) v on v.doc = c.doc and v.x0 = c.x0 group by 1, 2""")
def column_layout(spark, sf_dir, gap=150, full=120):
    """The columns of a page: the left edge that most text has, a second one that is far enough, and the width that most blocks there
    have; wide ones count first, ties go to the first block in reading order."""
    order = Window.partitionBy("doc").orderBy("y0", "x0", "x1", "y1", "chars", "size", "style", "side")
    b = spans(spark, sf_dir).where("y1 - y0 >= 8 and x1 - x0 >= 20 and size >= 6").withColumns({"w": F.col("x1") - F.col("x0"), "o": -F.row_number().over(order)})
    widths = b.groupBy("doc", "x0", "w").agg(F.count("*").alias("k"), F.sum("chars").alias("n"), F.max("o").alias("o"))
    edges = widths.groupBy("doc", "x0").agg(F.sum("n").alias("n"), F.max("o").alias("o"), F.max(F.struct((F.col("w") > full).alias("full"), "k", "o", "w"))["w"].alias("col_width"))
    page = edges.groupBy("doc").agg(F.collect_list(F.struct("n", "o", "x0", "col_width")).alias("es"), F.max(F.struct("n", "o", "x0", "col_width")).alias("first"))
    second = F.array_max(F.filter("es", lambda e: F.abs(e["x0"] - F.col("first.x0")) > gap))
    return page.select("doc", F.explode(F.array_compact(F.array(F.col("first"), second))).alias("c")).select("doc", F.col("c.x0").alias("left_margin"), F.col("c.col_width").alias("col_width"))


SAMPLE = """pg as (select doc, style as page, min(x0) as l, 612 - max(x1) as r, min(y0) as t, 792 - max(y1) as b, count(*) as n from spans group by 1, 2),
sm as (select doc, round_even(median(l), 2) as left_margin, round_even(median(r), 2) as right_margin, round_even(median(t), 2) as top_margin, round_even(median(b), 2) as bottom_margin, bool_or(n >= 20) as complex_floats from pg group by 1),
sz as (select doc, round_even(median(size), 2) as font_size from spans group by 1)"""


def samples(spark, sf_dir):
    """Of each document the medians of its pages' margins, of its font sizes, and whether a page is crowded."""
    s = spans(spark, sf_dir)
    pages = s.groupBy("doc", "style").agg(F.min("x0").alias("l"), (612 - F.max("x1")).alias("r"), F.min("y0").alias("t"), (792 - F.max("y1")).alias("b"), F.count("*").alias("n"))
    mid = lambda c: F.bround(F.median(c), 2)
    margins = pages.groupBy("doc").agg(mid("l").alias("left_margin"), mid("r").alias("right_margin"), mid("t").alias("top_margin"), mid("b").alias("bottom_margin"), F.bool_or(F.col("n") >= 20).alias("complex_floats"))
    return margins.join(s.groupBy("doc").agg(mid("size").alias("font_size")), "doc")


@CORE.query("layout_sample", f"with {SPANS}, {SAMPLE} select sm.*, font_size from sm join sz using (doc)")
def layout_sample(spark, sf_dir):
    return samples(spark, sf_dir)


PROFILE = "case when left_margin > 40 then 'wide' when left_margin > 15 then 'plain' else 'narrow' end"


@CORE.query("layout_template", f"""with {SPANS}, {SAMPLE}, d as (select sm.*, font_size, doc % 5 as family, {PROFILE} as profile, cast(case when right_margin > 60 then 2 else 1 end as int) as columns from sm join sz using (doc))
select family, count(*) as samples, mode_profile as profile, mode_columns as columns, round_even(median(left_margin) filter (left_margin > 0), 2) as left_margin, round_even(median(right_margin) filter (right_margin > 0), 2) as right_margin, round_even(median(font_size) filter (font_size > 0), 2) as font_size
from d join (select family, max(struct_pack(n := n, p := p)).p as mode_profile from (select family, profile as p, count(*) * 10 - case profile when 'narrow' then 1 when 'plain' then 2 else 3 end as n from d group by 1, 2) group by 1) using (family)
join (select family, max(struct_pack(n := n, p := -p)).p * -1 as mode_columns from (select family, columns as p, count(*) as n from d group by 1, 2) group by 1) using (family) group by 1, 3, 4""")
def layout_template(spark, sf_dir):
    """A template learned from the samples of a family: its most frequent profile and number of columns (ties: the first in order),
    and medians over the positive values."""
    left = F.col("left_margin")
    d = samples(spark, sf_dir).withColumns({"family": F.col("doc") % 5, "profile": F.when(left > 40, "wide").when(left > 15, "plain").otherwise("narrow"), "columns": F.when(F.col("right_margin") > 60, 2).otherwise(1)})
    mid = lambda c: F.bround(F.median(F.when(F.col(c) > 0, F.col(c))), 2).alias(c)
    return d.groupBy("family").agg(F.count("*").alias("samples"), F.mode("profile", True).alias("profile"), F.mode("columns", True).alias("columns"), mid("left_margin"), mid("right_margin"), mid("font_size"))


PIXELS = "px as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), ink as (select vec_id, i % 8 as x, i // 8 as y, v > 0.05 as dark from px where i < 64)"


def pixels(spark, sf_dir):
    """(vec_id, ink): eight rows of eight pixels, dark or not."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.coalesce((F.get("embedding", y * 8 + x) > F.lit(0.05).cast("double")).cast("int"), F.lit(0)))).alias("ink"))


@CORE.query("ink_grid", f"""with {PIXELS}, c as (select vec_id, least(2, y * 3 // 8) as row, least(2, x * 3 // 8) as col, avg(dark::int) as density from ink group by 1, 2, 3)
select vec_id, list(round(density, 6) order by row, col) as cells from c group by 1""")
def ink_grid(spark, sf_dir, rows=3, cols=3):
    """The share of dark pixels in each cell of a grid; the last cell takes the rest."""
    cell = lambda n, k: [i for i in range(8) if min(n - 1, i * n // 8) == k]
    cells = []
    for a in range(rows):
        for b in range(cols):
            own = [(y, x) for y in cell(rows, a) for x in cell(cols, b)]
            cells.append(F.round(sum((F.col("ink")[y][x] for y, x in own), F.lit(0)) / len(own), 6))
    return pixels(spark, sf_dir).select("vec_id", F.array(*cells).alias("cells"))


@CORE.query("ink_profile", f"""with {PIXELS}, r as (select vec_id, y, avg(dark::int) as p from ink group by 1, 2), l as (select vec_id, list(round(p, 6) order by y) as rows from r group by 1), c as (select vec_id, avg(x) filter (dark) as cx from ink group by 1), k as (select vec_id, x, bool_or(dark) as d from ink where y < 3 group by 1, 2), v as (select vec_id, avg(d::int) as share from k group by 1)
select vec_id, rows, round(cx, 6) as centroid_x, round(share, 6) as rule_share, rows[1] > 0.03 and rows[1] <= 0.85 and rows[2] > 0.03 and rows[2] <= 0.85 as cut_above, least(rows[1], rows[2]) >= 0.35 and list_min(rows[3:5]) <= 0.06 as bar_above from l join c using (vec_id) join v using (vec_id)""")
def ink_profile(spark, sf_dir):
    """The share of dark pixels in each row, their centre, the share of columns that are dark somewhere in the first three rows, and
    whether glyphs are cut at the upper edge or a bar decorates it."""
    p = pixels(spark, sf_dir)
    rows = F.transform("ink", lambda r: F.round(F.aggregate(r, F.lit(0), lambda a, v: a + v) / 8, 6))
    weight = F.aggregate("ink", F.lit(0), lambda a, r: a + F.aggregate(F.transform(r, lambda v, x: v * x), F.lit(0), lambda b, v: b + v))
    total = F.aggregate("ink", F.lit(0), lambda a, r: a + F.aggregate(r, F.lit(0), lambda b, v: b + v))
    columns = sum((F.greatest(*(F.col("ink")[y][x] for y in range(3))) for x in range(8)), F.lit(0)) / 8
    p = p.select("vec_id", rows.alias("rows"), F.round(weight / F.nullif(total, F.lit(0)), 6).alias("centroid_x"), F.round(columns, 6).alias("rule_share"))
    partial = lambda c: (c > 0.03) & (c <= 0.85)
    a, b = F.col("rows")[0], F.col("rows")[1]
    return p.select("*", (partial(a) & partial(b)).alias("cut_above"), ((F.least(a, b) >= 0.35) & (F.array_min(F.slice("rows", 3, 3)) <= 0.06)).alias("bar_above"))


@CORE.query("line_unions", f"""with {SPANS} select doc, side, cast(floor(y0 / 20) as int) as line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from spans group by 1, 2, 3 having sum(chars) >= 20""")
def line_unions(spark, sf_dir):
    """The box around the spans of a line, of lines with twenty characters or more."""
    s = spans(spark, sf_dir).groupBy("doc", "side", F.floor(F.col("y0") / 20).cast("int").alias("line")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("chars").alias("n"))
    return s.where("n >= 20").drop("n")


MERGED = "rl as (select doc, side, round_even(y0, 1) as y, min(x0) as x0, max(x1) as x1 from spans where x1 - x0 >= 40 group by 1, 2, 3)"


def merged_rules(spark, sf_dir):
    """Horizontal rules of at least 40 points; those of one height are one."""
    return spans(spark, sf_dir).where("x1 - x0 >= 40").groupBy("doc", "side", F.bround("y0", 1).alias("y")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@CORE.query("page_rules", f"with {SPANS}, {MERGED} select * from rl")
def page_rules(spark, sf_dir):
    return merged_rules(spark, sf_dir)


@CORE.query("page_verticals", f"""with {SPANS}, v as (select distinct doc, unnest(case when x1 - x0 >= 40 then [x0, x1] when x1 - x0 <= 8 then [(x0 + x1) / 2] else [] end) as x, y0, y1 from spans where y1 - y0 >= 24) select * from v""")
def page_verticals(spark, sf_dir):
    """Vertical lines of at least 24 points: narrow ones, and both edges of frames."""
    w = F.col("x1") - F.col("x0")
    x = F.when(w >= 40, F.array("x0", "x1")).when(w <= 8, F.array((F.col("x0") + F.col("x1")) / 2)).otherwise(F.array().cast("array<double>"))
    return spans(spark, sf_dir).where("y1 - y0 >= 24").select("doc", F.explode(x).alias("x"), "y0", "y1").distinct()


@CORE.query("wide_rule_groups", f"""with {SPANS}, {MERGED}, w as (select *, lag(y) over o as py, lag(x0) over o as px0, lag(x1) over o as px1 from rl where x1 - x0 >= 100 window o as (partition by doc, side order by y)),
n as (select *, case when py is not null and y - py <= 180 and least(x1, px1) - greatest(x0, px0) >= 0.8 * least(x1 - x0, px1 - px0) then 0 else 1 end as new from w), i as (select *, sum(new) over (partition by doc, side order by y) as g from n)
select doc, side, min(x0) as x0, min(y) as y0, max(x1) as x1, max(y) as y1, count(*) as rules from i group by doc, side, g having count(*) >= 2""")
def wide_rule_groups(spark, sf_dir, width=100):
    """Runs of wide rules below each other that share four fifths of their width with the one above."""
    o = Window.partitionBy("doc", "side").orderBy("y")
    w = merged_rules(spark, sf_dir).where(F.col("x1") - F.col("x0") >= width)
    w = w.withColumns({"py": F.lag("y").over(o), "px0": F.lag("x0").over(o), "px1": F.lag("x1").over(o)})
    goes_on = F.coalesce((F.col("y") - F.col("py") <= 180) & (F.least("x1", "px1") - F.greatest("x0", "px0") >= 0.8 * F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0"))), F.lit(False))
    g = w.withColumn("g", F.sum(F.when(goes_on, 0).otherwise(1)).over(o))
    return g.groupBy("doc", "side", "g").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("rules")).where("rules >= 2").drop("g")


CLUST = """cl0 as (select *, lag(y) over o as py, lag(x0) over o as px0, lag(x1) over o as px1 from rl where side = 'R' window o as (partition by doc order by y)),
cl1 as (select *, sum(case when py is not null and y - py <= 70 and least(x1, px1) - greatest(x0, px0) > 0.5 * least(x1 - x0, px1 - px0) then 0 else 1 end) over (partition by doc order by y) as g from cl0),
cl as (select doc, g, min(y) as top, max(y) as bottom, count(*) as rules from cl1 group by 1, 2 having count(*) between 3 and 16 and max(y) - min(y) >= 18)"""


@CORE.query("table_structure", f"""with {SPANS}, {MERGED}, {CLUST}, t as (select rl.doc, cl.g, rl.y, rl.x0, rl.x1 from rl join cl on cl.doc = rl.doc where rl.side = 'N' and rl.y between top - 6 and bottom + 6),
m as (select distinct t.doc, t.g, t.y from t join cl1 s on s.doc = t.doc and s.g = t.g where least(t.x1, s.x1) - greatest(t.x0, s.x0) >= 0.5 * (t.x1 - t.x0)), n as (select doc, g, count(*) as found, min(y) as top, max(y) as bottom from m group by 1, 2)
select cl.doc, cl.top, cl.rules, coalesce(found, 0) as found, case when found is null then 'lost' when found <> cl.rules then 'count' when greatest(abs(n.top - cl.top), abs(n.bottom - cl.bottom)) > 2.5 then 'drift' else 'kept' end as state from cl left join n on n.doc = cl.doc and n.g = cl.g""")
def table_structure(spark, sf_dir):
    """Tables of the source by their rules, and what became of them in the translation: lost, with another number of rules, moved or
    kept. A rule belongs to a table if it lies in its band and shares half its width with a rule of it."""
    o = Window.partitionBy("doc").orderBy("y")
    rules = merged_rules(spark, sf_dir)
    s = rules.where("side = 'R'").withColumns({"py": F.lag("y").over(o), "px0": F.lag("x0").over(o), "px1": F.lag("x1").over(o)})
    goes_on = F.coalesce((F.col("y") - F.col("py") <= 70) & (F.least("x1", "px1") - F.greatest("x0", "px0") > 0.5 * F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0"))), F.lit(False))
    s = s.withColumn("g", F.sum(F.when(goes_on, 0).otherwise(1)).over(o))
    own = s.groupBy("doc", "g").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("rules"), F.collect_list(F.struct("x0", "x1")).alias("xs")).where("rules between 3 and 16 and bottom - top >= 18")
    t = rules.where("side = 'N'").select("doc", F.col("y").alias("ty"), F.col("x0").alias("tx0"), F.col("x1").alias("tx1"))
    met = own.join(t, "doc").where(F.col("ty").between(F.col("top") - 6, F.col("bottom") + 6)).where(F.exists("xs", lambda x: F.least("tx1", x["x1"]) - F.greatest("tx0", x["x0"]) >= 0.5 * (F.col("tx1") - F.col("tx0"))))
    n = met.groupBy("doc", "g").agg(F.count("*").alias("found"), F.min("ty").alias("ttop"), F.max("ty").alias("tbottom"))
    out = own.join(n, ["doc", "g"], "left")
    drift = F.greatest(F.abs(F.col("ttop") - F.col("top")), F.abs(F.col("tbottom") - F.col("bottom"))) > 2.5
    state = F.when(F.col("found").isNull(), "lost").when(F.col("found") != F.col("rules"), "count").when(drift, "drift").otherwise("kept")
    return out.select("doc", "top", "rules", F.coalesce("found", F.lit(0)).alias("found"), state.alias("state"))


@CORE.query("rules_in_regions", f"""with {SPANS}, {MERGED}, g as (select doc, x0 as gx0, y0 as gy0, x1 as gx1, y1 as gy1 from spans where side = 'A')
select rl.doc, rl.side, rl.y, count(*) as regions from rl join g on g.doc = rl.doc where rl.side <> 'A' and y between gy0 - 2 and gy1 + 2 and least(x1, gx1 + 2) - greatest(x0, gx0 - 2) >= greatest(1, x1 - x0) * 0.7 group by 1, 2, 3""")
def rules_in_regions(spark, sf_dir):
    """Rules that lie in graphic regions by seven tenths of their width."""
    both = merged_rules(spark, sf_dir).where("side <> 'A'").join(side(spark, sf_dir, "A", "g"), "doc").where(F.col("y").between(F.col("gy0") - 2, F.col("gy1") + 2))
    both = both.where(F.least(F.col("x1"), F.col("gx1") + 2) - F.greatest(F.col("x0"), F.col("gx0") - 2) >= F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")) * 0.7)
    return both.groupBy("doc", "side", "y").agg(F.count("*").alias("regions"))


@CORE.query("underlines", f"""with {SPANS}, {MERGED} select distinct rl.doc, rl.side, rl.y from rl join spans s on s.doc = rl.doc where rl.side = 'A' and s.side <> 'A' and rl.y between s.y1 - 2.5 and s.y1 + 2.8 and rl.x0 >= s.x0 - 6 and rl.x1 <= s.x1 + 6 and least(rl.x1, s.x1) - greatest(rl.x0, s.x0) >= 0.7 * greatest(1, rl.x1 - rl.x0)""")
def underlines(spark, sf_dir):
    """Rules that underline a span: just below its foot and hardly longer than it."""
    s = spans(spark, sf_dir).where("side <> 'A'").select("doc", F.col("x0").alias("gx0"), F.col("x1").alias("gx1"), F.col("y1").alias("gy1"))
    both = merged_rules(spark, sf_dir).where("side = 'A'").join(s, "doc").where(F.col("y").between(F.col("gy1") - 2.5, F.col("gy1") + 2.8) & (F.col("x0") >= F.col("gx0") - 6) & (F.col("x1") <= F.col("gx1") + 6))
    return both.where(F.least("x1", "gx1") - F.greatest("x0", "gx0") >= 0.7 * F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))).select("doc", "side", "y").distinct()


@CORE.query("float_side", f"""with {SIDES} select distinct b.doc, b.x0, b.y0, b.x1, b.y1 from b join c on c.doc = b.doc where least(x1, cx1) - greatest(x0, cx0) > 0 and ((kind = 'figure' and y1 <= cy0 + 4 and cy0 - y1 <= 150) or (kind = 'table' and y0 >= cy1 - 4 and y0 - cy1 <= 150) or (kind = 'table' and y1 <= cy0 + 4))""")
def float_side(spark, sf_dir):
    """Blocks on the side of a caption where its figure or table is: above a figure's, on either side of a table's."""
    both = side(spark, sf_dir, "N").join(captions(spark, sf_dir), "doc").where(F.least("x1", "cx1") - F.greatest("x0", "cx0") > 0)
    fig, tab = F.col("kind") == "figure", F.col("kind") == "table"
    above = F.col("y1") <= F.col("cy0") + 4
    hit = (fig & above & (F.col("cy0") - F.col("y1") <= 150)) | (tab & (F.col("y0") >= F.col("cy1") - 4) & (F.col("y0") - F.col("cy1") <= 150)) | (tab & above)
    return both.where(hit).select("doc", *BOX).distinct()


@CORE.query("panel_captions", f"""with {SIDES} select distinct b.doc, b.x0, b.y0, b.x1, b.y1 from b join c on c.doc = b.doc where b.chars % 4 = 1 and kind = 'figure' and least(x1, cx1) - greatest(x0, cx0) > 0 and (cy0 - y1 between -6 and 48 or y0 - cy1 between -6 and 48)""")
def panel_captions(spark, sf_dir):
    """Blocks that caption a panel: by the form of their text (a length of remainder 1 stands for it) and next to a figure's caption."""
    both = side(spark, sf_dir, "N").where("chars % 4 = 1").join(captions(spark, sf_dir).where("kind = 'figure'"), "doc").where(F.least("x1", "cx1") - F.greatest("x0", "cx0") > 0)
    return both.where((F.col("cy0") - F.col("y1")).between(-6, 48) | (F.col("y0") - F.col("cy1")).between(-6, 48)).select("doc", *BOX).distinct()


@CORE.query("figure_filter", f"with {SPANS} select doc, x0, y0, x1, y1 from (select distinct doc, x0, y0, x1, y1 from spans where side = 'A') where x1 - x0 >= 80 and y1 - y0 >= 20 and (x1 - x0) * (y1 - y0) >= 3000")
def figure_filter(spark, sf_dir, width=80, height=20, area=3000):
    """Graphic regions that are large enough for a figure."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return side(spark, sf_dir, "A").where((w >= width) & (h >= height) & (w * h >= area)).select("doc", *BOX).distinct()


@CORE.query("table_rows", f"""with {SPANS}, r as (select doc, cast(floor(y0 / 8) as int) as row, count(*) as n from spans where x1 - x0 <= 160 group by 1, 2) select doc, count(*) filter (n >= 2) as rows, count(*) filter (n >= 4) >= 3 as table_like from r group by 1""")
def table_rows(spark, sf_dir):
    """Rows of narrow boxes, by height: a page with three rows of four or more looks like a table."""
    r = spans(spark, sf_dir).where("x1 - x0 <= 160").groupBy("doc", F.floor(F.col("y0") / 8).alias("row")).agg(F.count("*").alias("n"))
    return r.groupBy("doc").agg(F.count_if(F.col("n") >= 2).alias("rows"), (F.count_if(F.col("n") >= 4) >= 3).alias("table_like"))


EV = "ev as (select user_id as doc, strftime(ts, '%Y%m%d') as page, bool_or(event_type = 'signup') as starts, bool_or(event_type = 'purchase') as ends from events group by 1, 2)"


@CORE.query("reference_pages", f"""with {EV}, s as (select *, case when starts then true when ends then false end as own from ev) select doc, page, coalesce(last_value(own ignore nulls) over (partition by doc order by page rows between unbounded preceding and current row), false) as in_references from s""")
def reference_pages(spark, sf_dir):
    """Whether each page of a document is in its references: they begin where a page says so, and last over pages that say nothing."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type").groupBy(F.col("user_id").alias("doc"), F.date_format("ts", "yyyyMMdd").alias("page"))
    e = e.agg(F.bool_or(F.col("event_type") == "signup").alias("starts"), F.bool_or(F.col("event_type") == "purchase").alias("ends"))
    own = F.when(F.col("starts"), True).when(F.col("ends"), False)
    state = F.last(own, ignorenulls=True).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("doc", "page", F.coalesce(state, F.lit(False)).alias("in_references"))


REF = f"""h as (select doc, arg_min(struct_pack(x0 := x0, y0 := y0, x1 := x1), (y0, x0, x1, y1)) as h from spans where side = 'R' and chars = 11 group by 1), k as (select doc, h.x0 as hx0, h.x1 as hx1, h.y0 as hy from h)"""


@CORE.query("reference_regions", f"""with {SPANS}, {REF}, c as (select *, case when hx1 - hx0 >= 275.4 then 'page' when hx0 < 306 - 12.24 and hx1 <= 306 + 12.24 then 'left' when hx0 >= 306 - 12.24 and hx1 > 306 + 12.24 then 'right' else 'page' end as place from k)
select doc, unnest(case place when 'left' then [struct_pack(x0 := 0.0::double, y0 := hy - 4, x1 := 306.0::double), struct_pack(x0 := 306.0::double, y0 := 0.0::double, x1 := 612.0::double)] when 'right' then [struct_pack(x0 := 306.0::double, y0 := hy - 4, x1 := 612.0::double)] else [struct_pack(x0 := 0.0::double, y0 := hy - 4, x1 := 612.0::double)] end, recursive := true) from c""")
def reference_regions(spark, sf_dir, width=612.0):
    """Where the references of a page stand, by the column of their heading: below it, and in the whole column to its right."""
    mid, tolerance = width / 2, width * 0.02
    h = spans(spark, sf_dir).where("side = 'R' and chars = 11").groupBy("doc").agg(F.min(F.struct("y0", "x0", "x1", "y1")).alias("h")).select("doc", F.col("h.x0").alias("hx0"), F.col("h.x1").alias("hx1"), F.col("h.y0").alias("hy"))
    box = lambda a, y, b: F.struct(F.lit(a).alias("x0"), y.alias("y0"), F.lit(b).alias("x1"))
    top, zero = F.col("hy") - 4, F.lit(0.0)
    narrow = F.col("hx1") - F.col("hx0") < width * 0.45
    left = narrow & (F.col("hx0") < mid - tolerance) & (F.col("hx1") <= mid + tolerance)
    right = narrow & (F.col("hx0") >= mid - tolerance) & (F.col("hx1") > mid + tolerance)
    out = F.when(left, F.array(box(0.0, top, mid), box(mid, zero, width))).when(right, F.array(box(mid, top, width))).otherwise(F.array(box(0.0, top, width)))
    return h.select("doc", F.inline(out))


@CORE.query("page_sizes", """with p as (select vec_id, 500 + vec_id % 120 as w, 700 + vec_id % 130 as h, 500 + (vec_id * 7) % 130 as w2, 700 + (vec_id * 3) % 140 as h2 from embeddings) select vec_id, round(least(w / w2, w2 / w, h / h2, h2 / h), 6) as similarity, w between 580 and 630 and h between 760 and 820 as us_letter, least(w, h) / greatest(w, h) as shape from p""")
def page_sizes(spark, sf_dir):
    """How alike the sizes of a page and its translation are: the least of the ratios of their sides; and whether it is a US letter."""
    v = F.col("vec_id")
    p = table(spark, sf_dir, "embeddings", "vec_id").select("vec_id", (500 + v % 120).alias("w"), (700 + v % 130).alias("h"), (500 + v * 7 % 130).alias("w2"), (700 + v * 3 % 140).alias("h2"))
    alike = F.least(F.col("w") / F.col("w2"), F.col("w2") / F.col("w"), F.col("h") / F.col("h2"), F.col("h2") / F.col("h"))
    return p.select("vec_id", F.round(alike, 6).alias("similarity"), (F.col("w").between(580, 630) & F.col("h").between(760, 820)).alias("us_letter"), (F.least("w", "h") / F.greatest("w", "h")).alias("shape"))


@CORE.query("boxes_near", f"""with {SIDES} select b.doc, b.x0, b.y0, b.x1, b.y1, count(*) as near from b join g on g.doc = b.doc where x0 - 3 < gx1 and gx0 - 3 < x1 and y0 - 3 < gy1 and gy0 - 3 < y1 group by 1, 2, 3, 4, 5""")
def boxes_near(spark, sf_dir, margin=3):
    """Blocks that touch regions, with a margin around them."""
    both = side(spark, sf_dir, "N").select("doc", *BOX, "chars", "size", "style").join(side(spark, sf_dir, "A", "g"), "doc")
    return both.where(X.near(margin)).groupBy("doc", *BOX).agg(F.count("*").alias("near"))


@CORE.query("first_title", """with t as (select paper_id, doc_id, length(text) % 12 + 6 as size, trim(string_split(text, chr(10))[1], ' ') as line from documents where paper_id is not null and text is not null), f as (select paper_id, arg_min(substr(line, 1, 200), doc_id) as title from t where size > 14 and length(line) > 5 group by 1) select * from f""")
def first_title(spark, sf_dir):
    """The first line of each paper that is set in a large size and longer than five characters, cut to 200."""
    t = table(spark, sf_dir, "documents", "paper_id", "doc_id", "text").where("paper_id is not null and text is not null").select("paper_id", "doc_id", (F.length("text") % 12 + 6).alias("size"), F.trim(F.split("text", "\n")[0]).alias("line"))
    return t.where("size > 14 and length(line) > 5").groupBy("paper_id").agg(F.min(F.struct("doc_id", F.substring("line", 1, 200).alias("t")))["t"].alias("title"))


@CORE.query("text_pages", """with p as (select paper_id, section, count(*) filter (length(trim(text, ' ')) >= 20) > 0 as whole from documents where paper_id is not null and section is not null group by 1, 2) select paper_id, count(*) as pages, count(*) filter (whole) as text_pages, count(*) filter (whole) / count(*) < 0.2 as scanned from p group by 1""")
def text_pages(spark, sf_dir):
    """Pages with twenty characters or more of each paper; with fewer than a fifth of such pages it was scanned. Sections stand for
    pages."""
    p = table(spark, sf_dir, "documents", "paper_id", "section", "text").where("paper_id is not null and section is not null").groupBy("paper_id", "section").agg((F.count_if(F.length(F.trim("text")) >= 20) > 0).alias("full"))
    return p.groupBy("paper_id").agg(F.count("*").alias("pages"), F.count_if("full").alias("text_pages"), (F.count_if("full") / F.count("*") < 0.2).alias("scanned"))
