"""Detectors: each gives issues (page, code, severity, place) by a ladder of rules over pages, and `inspect_pages` puts them together.
Pages and spans are those of plans.pages, ink that of plans.layout and plans.pages."""

from pyspark.sql import functions as F

from inkwright.functions.text import STOPWORDS
from inkwright.operators.library import first_per_key
from inkwright.plans.pages import BOX, CLUST, MERGED, OVER, PIXELS, SIDES, overlap, pixels, side, table_structure
from inkwright.plans.layout import SPANS, spans
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table

# Characters of a block that is judged, tolerance of its size against its like, and the bounds below which its like is
# itself too small; issues of a page that are reported.
LEAST, TOLERANCE, CRUSHED, CRUSHED_OWN, SHOWN = 14, 0.075, 0.80, 0.72, 4
FREE = f"""free as (select distinct * from b where chars >= {LEAST} and not exists (select 1 from g where g.doc = b.doc and {OVER.format('b.', 'g')} > 0.35 * (b.x1 - b.x0) * (b.y1 - b.y0)))"""
DRIFT = f"""{SIDES}, {FREE}, m as (select f.doc, f.x0, f.y0, f.x1, f.y1, f.chars, f.size, f.style, arg_max(s.size, (ov * ov / ((f.x1 - f.x0) * (f.y1 - f.y0) * (s.x1 - s.x0) * (s.y1 - s.y0)), -s.y0, -s.x0, -s.chars, s.size)) as expected
  from free f join (select *, x0 as gx0, y0 as gy0, x1 as gx1, y1 as gy1 from s) s on s.doc = f.doc, lateral (select {OVER.format('f.', 's.g')} as ov) where ov > 0.25 * (f.x1 - f.x0) * (f.y1 - f.y0) group by 1, 2, 3, 4, 5, 6, 7, 8),
r as (select *, size / expected as ratio, round_even(expected, 1) as k from m), p as (select doc, median(ratio) as page, count(*) as n from r group by 1), co as (select doc, k, median(ratio) as own, count(*) as n from r group by 1, 2),
j as (select r.*, case when co.n >= 2 then least(co.own, p.page) else p.page end as ref from r join p on p.doc = r.doc join co on co.doc = r.doc and co.k = r.k where p.n >= 3),
drift as (select doc, x0, y0, expected, ratio from (select *, row_number() over (partition by doc order by y0, x0, x1, y1, chars, size, style) as o from j where ratio < ref - {TOLERANCE} * ref or (ref < {CRUSHED} and ratio < {CRUSHED_OWN})) where o <= {SHOWN})"""


def free_blocks(spark, sf_dir):
    """Translated blocks with enough text that don't lie on a graphic by more than 35 percent."""
    b = side(spark, sf_dir, "N").where(F.col("chars") >= LEAST)
    regions = side(spark, sf_dir, "A", "g").groupBy("doc").agg(F.collect_set(F.struct("gx0", "gy0", "gx1", "gy1")).alias("gs"))
    cover = lambda g: F.greatest(F.lit(0), F.least("x1", g["gx1"]) - F.greatest("x0", g["gx0"])) * F.greatest(F.lit(0), F.least("y1", g["gy1"]) - F.greatest("y0", g["gy0"]))
    on = F.exists("gs", lambda g: cover(g) > 0.35 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return b.join(regions, "doc", "left").where(~F.coalesce(on, F.lit(False))).drop("gs").distinct()


def drifting(spark, sf_dir):
    """Blocks set smaller than the source's block at their place by more than those like it: against the median of the page and of the
    blocks with the same expected size; pages with fewer than three pairs aren't judged."""
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    s = side(spark, sf_dir, "R").select("doc", *(F.col(c).alias("g" + c) for c in BOX), F.col("size").alias("s_size"), F.col("chars").alias("s_chars"))
    ov = overlap()
    met = free_blocks(spark, sf_dir).join(s, "doc").where(ov > 0.25 * area(""))
    best = F.max(F.struct((ov * ov / (area("") * area("g"))).alias("score"), (-F.col("gy0")).alias("a"), (-F.col("gx0")).alias("b"), (-F.col("s_chars")).alias("c"), F.col("s_size").alias("expected")))["expected"]
    key = ["doc", *BOX, "chars", "size", "style"]
    r = met.groupBy(*key).agg(best.alias("expected")).withColumn("ratio", F.col("size") / F.col("expected"))
    r = r.withColumn("k", F.bround("expected", 1))
    page = r.groupBy("doc").agg(F.median("ratio").alias("page"), F.count("*").alias("n")).where("n >= 3").drop("n")
    own = r.groupBy("doc", "k").agg(F.median("ratio").alias("own"), F.count("*").alias("n"))
    ref = F.when(F.col("n") >= 2, F.least("own", "page")).otherwise(F.col("page"))
    bad = r.join(page, "doc").join(own, ["doc", "k"]).withColumn("ref", ref).where((F.col("ratio") < F.col("ref") - TOLERANCE * F.col("ref")) | ((F.col("ref") < CRUSHED) & (F.col("ratio") < CRUSHED_OWN)))
    return first_per_key(bad, ["doc"], [F.asc(c) for c in ("y0", "x0", "x1", "y1", "chars", "size", "style")], SHOWN).select("doc", "x0", "y0", "expected", "ratio")


@CORE.query("font_drift", f"with {DRIFT} select doc, x0, y0, expected, round(ratio, 6) as ratio from drift")
def font_drift(spark, sf_dir):
    return drifting(spark, sf_dir).withColumn("ratio", F.round("ratio", 6))


SIBLINGS = f"""l as (select *, chars % 3 as mark, cast(floor(x0 / 24) as int) as col from free), sib as (select doc, mark, col, count(*) as items, min(size) as least_size, max(size) as most_size, arg_min(struct_pack(x0 := x0, y0 := y0), (size, y0, x0, x1, y1, chars)) as at_box from l where mark < 2 group by 1, 2, 3 having count(*) >= 2 and max(size) / min(size) > 1.05)"""


def siblings(spark, sf_dir):
    """Items of a list, by mark and column, whose sizes differ by more than 5 percent: the smallest one is reported. The remainder of
    the length stands for the mark."""
    items = free_blocks(spark, sf_dir).where("chars % 3 < 2").withColumns({"mark": F.col("chars") % 3, "col": F.floor(F.col("x0") / 24).cast("int")})
    g = items.groupBy("doc", "mark", "col").agg(F.count("*").alias("items"), F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.min(F.struct("size", "y0", "x0", "x1", "y1", "chars")).alias("at"))
    return g.where("items >= 2 and most_size / least_size > 1.05").select("doc", "mark", "col", "items", "least_size", "most_size", F.col("at.x0").alias("x0"), F.col("at.y0").alias("y0"))


@CORE.query("list_siblings", f"with {SIDES}, {FREE}, {SIBLINGS} select doc, mark, col, items, least_size, most_size, at_box.x0 as x0, at_box.y0 as y0 from sib")
def list_siblings(spark, sf_dir):
    return siblings(spark, sf_dir)


INK = f"""{PIXELS}, rr as (select vec_id, y, avg(dark::int) as p from ink group by 1, 2), ll as (select vec_id, list(round(p, 6) order by y) as r, round(avg(p), 6) as dense from rr group by 1),
e as (select vec_id, vec_id // 40 as page, dense, r[1] > 0.03 and r[1] <= 0.85 and r[2] > 0.03 and r[2] <= 0.85 as top_cut, r[8] > 0.03 and r[8] <= 0.85 and r[7] > 0.03 and r[7] <= 0.85 as foot_cut,
  least(r[1], r[2]) >= 0.35 and list_min(r[3:5]) <= 0.06 as top_bar, least(r[8], r[7]) >= 0.35 and list_min(r[4:6]) <= 0.06 as foot_bar, least(r[1], r[2]) as top_edge, least(r[8], r[7]) as foot_edge from ll)"""
CLIPS = """clips as (select page, vec_id, case when edge >= 0.12 then 'error' else 'warning' end as severity, edge from (select *, greatest(case when top_cut and not top_bar then top_edge else 0 end, case when foot_cut and not foot_bar then foot_edge else 0 end) as edge from e where 6 + vec_id % 40 <= 34 and 4 + vec_id % 30 >= 8 and dense <= 0.42) where edge >= 0.05)"""


def clipped(spark, sf_dir):
    """Small images of formulas whose ink reaches their upper or lower edge; bars that decorate an edge don't count. Images are too
    tall, narrow or dense for a formula beyond the bounds."""
    p = pixels(spark, sf_dir)
    p = p.select("vec_id", F.transform("ink", lambda r: F.round(F.aggregate(r, F.lit(0), lambda a, v: a + v) / 8, 6)).alias("r"))
    r = lambda i: F.col("r")[i - 1]
    partial = lambda c: (c > 0.03) & (c <= 0.85)
    bar = lambda a, b, rest: (F.least(r(a), r(b)) >= 0.35) & (F.array_min(rest) <= 0.06)
    top = F.when(partial(r(1)) & partial(r(2)) & ~bar(1, 2, F.slice("r", 3, 3)), F.least(r(1), r(2))).otherwise(0.0)
    foot = F.when(partial(r(8)) & partial(r(7)) & ~bar(8, 7, F.slice("r", 4, 3)), F.least(r(8), r(7))).otherwise(0.0)
    dense = F.aggregate("r", F.lit(0.0), lambda a, v: a + v) / 8
    small = (6 + F.col("vec_id") % 40 <= 34) & (4 + F.col("vec_id") % 30 >= 8) & (F.round(dense, 6) <= 0.42)
    e = p.where(small).select("vec_id", F.greatest(top, foot).alias("edge")).where("edge >= 0.05")
    return e.select(F.expr("vec_id div 40").alias("page"), "vec_id", F.when(F.col("edge") >= 0.12, "error").otherwise("warning").alias("severity"), "edge")


@CORE.query("formula_clipped", f"with {INK}, {CLIPS} select page, vec_id, severity, edge from (select *, row_number() over (partition by page order by vec_id) as o from clips) where o <= 5")
def formula_clipped(spark, sf_dir):
    return first_per_key(clipped(spark, sf_dir), ["page"], [F.asc("vec_id")], 5).drop("rank")


@CORE.query("formula_misaligned", f"""with {PIXELS}, cx as (select vec_id, avg(x) filter (dark) as c, count(*) filter (dark) as n from ink group by 1), d as (select a.vec_id, 10 * abs(a.c - b.c) as exact, 25 * abs(a.c - b.c) as wide from cx a join cx b on b.vec_id = a.vec_id + 1 where a.n > 0 and b.n > 0)
select vec_id // 40 as page, vec_id, round(wide, 6) as drift from (select *, row_number() over (partition by vec_id // 40 order by vec_id) as o from d where exact > 3 and wide > 14) where o <= 3""")
def formula_misaligned(spark, sf_dir):
    """Displayed formulas that moved sideways: the centre of their ink by more than 3 points within their box and by more than 14 in a
    wider window; the first three of a page. A vector's successor stands for the translation."""
    p = pixels(spark, sf_dir)
    total = F.aggregate("ink", F.lit(0), lambda a, r: a + F.aggregate(r, F.lit(0), lambda b, v: b + v))
    weight = F.aggregate("ink", F.lit(0), lambda a, r: a + F.aggregate(F.transform(r, lambda v, x: v * x), F.lit(0), lambda b, v: b + v))
    c = p.select("vec_id", total.alias("n"), (weight / F.nullif(total, F.lit(0))).alias("c")).where("n > 0")
    d = c.join(c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("c2")), "vec_id").withColumn("move", F.abs(F.col("c") - F.col("c2")))
    bad = d.where((10 * F.col("move") > 3) & (25 * F.col("move") > 14)).select(F.expr("vec_id div 40").alias("page"), "vec_id", F.round(25 * F.col("move"), 6).alias("drift"))
    return first_per_key(bad, ["page"], [F.asc("vec_id")], 3).drop("rank")


# Words of addresses of institutions, and of pseudo-code.
AFFILIATION = ["university", "institute", "department", "laboratory", "school", "college", "faculty"]
PSEUDO = ["if", "then", "else", "for", "while", "return", "repeat", "until", "end"]
WORDS = "list_transform(regexp_extract_all(t, '[A-Za-z]{2,}'), lambda x: lower(x))"
COUNT = lambda xs: f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in xs)})))"
PROFILE = f"""d as (select doc_id, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') as t from documents where text is not null), w as (select doc_id, t, {WORDS} as w, len(regexp_extract_all(t, '[㐀-鿿]')) as cjk from d),
n as (select doc_id, t, cast(len(w) as int) as words, cast(cjk as int) as cjk, cast({COUNT(STOPWORDS)} as int) as stops, {COUNT(AFFILIATION)} as places, {COUNT(PSEUDO)} as code from w)"""
# the rungs in order: the first that holds exempts a block
RUNGS = [
    ("empty", "t = ''"), ("few words", "words < 12"), ("translated", "cjk >= greatest(4, {div})"), ("caption", "{caption}"), ("no prose", "stops < 2"), ("affiliation", "places >= 2"), ("pseudo-code", "code >= 2 * stops"),
    ("sparse", "stops < greatest(2.0, words / 7.0) and words < 40"),
]


@CORE.query("untranslated_ladder", f"""with {PROFILE} select doc_id, words, cjk, stops, case {' '.join(f"when {test.format(div='words // 8', caption='regexp_matches(t, ' + repr('^(Figure|Table|Algorithm) [0-9]') + ')')} then '{name}'" for name, test in RUNGS)} else 'flagged' end as rung from n""")
def untranslated_ladder(spark, sf_dir):
    """For each text the first rule that exempts it from counting as prose left in English, or that it is flagged."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")).alias("t"))
    w = d.withColumns({"w": F.transform(F.regexp_extract_all("t", F.lit("([A-Za-z]{2,})"), F.lit(1)), F.lower), "cjk": F.regexp_count("t", F.lit("[㐀-鿿]"))})
    among = lambda xs: F.size(F.filter("w", lambda x: x.isin(xs)))
    n = w.select("doc_id", "t", F.size("w").alias("words"), "cjk", among(STOPWORDS).alias("stops"), among(AFFILIATION).alias("places"), among(PSEUDO).alias("code"))
    rung = "case " + " ".join(f"when {test.format(div='words div 8', caption='t rlike ' + repr('^(Figure|Table|Algorithm) [0-9]'))} then '{name}'" for name, test in RUNGS) + " else 'flagged' end"
    return n.select("doc_id", "words", "cjk", "stops", F.expr(rung).alias("rung"))


NEEDS = """lm as (select doc, style, min(x0) as m, max(x1 - x0) as cw from spans group by 1, 2), nb as (select b.doc, b.x0, b.y0, b.x1, b.y1, b.chars, b.size, b.style, min(struct_pack(d := abs(b.x0 - lm.m), m := lm.m, cw := lm.cw)) as c from b join lm on lm.doc = b.doc group by 1, 2, 3, 4, 5, 6, 7, 8)"""
STEPS = [
    ("tiny", "y1 - y0 < 10 or x1 - x0 < 16"), ("styled", "style = 'O' and chars % 5 = 0"), ("margin", "y0 < 40 or y1 > 620"), ("number at the edge", "chars <= 2 and (x0 + x1) / 2 <= 60"), ("number", "chars <= 2"),
    ("caption", "chars % 7 = 0"), ("label", "chars < 6 and x1 - x0 < 60"), ("small print", "size < 7"), ("off its column", "abs(x0 - {m}) > 12"), ("narrow", "x1 - x0 < {cw} * 0.5 and x1 - x0 < 90"),
]
FIXED = ("number at the edge", "small print", "off its column", "narrow")


@CORE.query("blocks_to_fix", f"""with {SIDES}, {NEEDS} select doc, x0, y0, x1, y1, chars, step, step in {FIXED} as fix from (select *, case {' '.join(f"when {t.format(m='c.m', cw='c.cw')} then '{n}'" for n, t in STEPS)} else 'sound' end as step from nb)""")
def blocks_to_fix(spark, sf_dir):
    """The first rule that decides whether a block is set anew; the order of the rules matters."""
    s = spans(spark, sf_dir)
    columns = s.groupBy("doc", "style").agg(F.min("x0").alias("m"), F.max(F.col("x1") - F.col("x0")).alias("cw")).groupBy("doc").agg(F.collect_list(F.struct("m", "cw")).alias("cs"))
    b = side(spark, sf_dir, "N").join(columns, "doc").withColumn("c", F.array_min(F.transform("cs", lambda c: F.struct(F.abs(F.col("x0") - c["m"]).alias("d"), c["m"].alias("m"), c["cw"].alias("cw")))))
    step = "case " + " ".join(f"when {t.format(m='c.m', cw='c.cw')} then '{n}'" for n, t in STEPS) + " else 'sound' end"
    return b.select("doc", *BOX, "chars", "size", "style", F.expr(step).alias("step")).distinct().select("doc", *BOX, "chars", "step", F.col("step").isin(*FIXED).alias("fix"))


@CORE.query("inspect_pages", f"""with {DRIFT}, {SIBLINGS}, {MERGED}, {CLUST}, tr as (select rl.doc, cl.g, rl.y, rl.x0, rl.x1 from rl join cl on cl.doc = rl.doc where rl.side = 'N' and rl.y between top - 6 and bottom + 6),
tm as (select distinct tr.doc, tr.g, tr.y from tr join cl1 on cl1.doc = tr.doc and cl1.g = tr.g where least(tr.x1, cl1.x1) - greatest(tr.x0, cl1.x0) >= 0.5 * (tr.x1 - tr.x0)), tn as (select doc, g, count(*) as found, min(y) as top, max(y) as bottom from tm group by 1, 2),
ts as (select cl.doc, case when found is null then 'lost' when found <> cl.rules then 'count' when greatest(abs(tn.top - cl.top), abs(tn.bottom - cl.bottom)) > 2.5 then 'drift' else 'kept' end as state from cl left join tn on tn.doc = cl.doc and tn.g = cl.g)
select doc, 1 as detector, 'font_size_drift' as code, 'error' as severity, count(*) as issues from drift group by 1 union all select doc, 2, 'list_font_inconsistent', 'error', count(*) from sib group by 1 union all select doc, 3, 'table_structure_mismatch', 'error', count(*) from ts where state <> 'kept' group by 1""")
def inspect_pages(spark, sf_dir):
    """The issues of all detectors of a page, by detector in their order."""
    parts = [(1, "font_size_drift", drifting(spark, sf_dir)), (2, "list_font_inconsistent", siblings(spark, sf_dir)), (3, "table_structure_mismatch", table_structure(spark, sf_dir).where("state <> 'kept'"))]
    out = None
    for i, code, df in parts:
        one = df.groupBy("doc").agg(F.count("*").alias("issues")).select("doc", F.lit(i).alias("detector"), F.lit(code).alias("code"), F.lit("error").alias("severity"), "issues")
        out = one if out is None else out.unionByName(one)
    return out


@CORE.query("preserved_ink", f"""with m as ({CORE.sql['mask_coverage']}), a as (select *, (vec_id % 60) * 40 as area, vec_id % 45 as foot from m) select vec_id, coverage, area from a where area >= 900 and not (foot <= 8) and coverage < 0.88""")
def preserved_ink(spark, sf_dir):
    """Preserved regions whose ink isn't that of the source: of an area of 900 or more, no running headers, covered by less than 0.88."""
    m = CORE.queries["mask_coverage"](spark, sf_dir).withColumns({"area": F.col("vec_id") % 60 * 40, "foot": F.col("vec_id") % 45})
    return m.where("area >= 900 and not (foot <= 8) and coverage < 0.88").select("vec_id", "coverage", "area")
