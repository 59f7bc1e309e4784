"""Issues of a document: scores, fingerprints, plans, messages, reports, comparison with a baseline, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes that a layout repair helps, that a new translation helps, and warnings that call for action.
LAYOUT = ["caption_overlap", "text_overlap"]
RETRANSLATE = ["untranslated_english", "untranslated_caption", "untranslated_formula_explanation", "untranslated_natural_language", "untranslated_block"]
ACTIONABLE = ["font_size_drift", "font_role_heading_mismatch", "text_overlap", "raster_ink_overlap", "formula_changed", "formula_clipped", "formula_visible_ink_mismatch", "display_formula_misaligned", "table_structure_mismatch", "untranslated_english", "untranslated_natural_language", "untranslated_block"]
#: The least visual score of a strict pass.
VISUAL = 0.55



def _error() -> Column:
    return F.col("severity") == "error"


def actionable() -> Column:
    return (F.col("severity") == "warning") & (F.col("code").isin(ACTIONABLE) | F.col("code").startswith("preserved_"))


def normal(issues: DataFrame) -> DataFrame:
    """Issues with page 0 for none, code unknown for none, and severity warning for anything but error."""
    return issues.withColumns({
        "page": F.coalesce("page", F.lit(0)), "code": F.coalesce("code", F.lit("unknown")), "message": F.coalesce("message", F.lit("")),
        "severity": F.when(_error(), "error").otherwise("warning"),
    })


def scores(issues: DataFrame, key: list[str]) -> DataFrame:
    """Errors, actionable warnings, all; whether errors can heal by themselves, any or only such."""
    heal = _error() & F.col("code").isin(RETRANSLATE)
    return issues.groupBy(*key).agg(
        F.count_if(_error()).alias("errors"), F.count_if(actionable()).alias("actionable"), F.count("*").alias("issues"),
        F.coalesce(F.bool_or(heal), F.lit(False)).alias("any_heals"),
        ((F.count_if(_error()) > 0) & (F.count_if(_error() & ~F.col("code").isin(RETRANSLATE)) == 0)).alias("only_heals"),
    )


def plans(issues: DataFrame, key: list[str]) -> DataFrame:
    """repair_layout, else retranslate, else stop. Keys without issues are not in the table: they are accepted."""
    layout, again = F.bool_or(F.col("code").isin(LAYOUT)), F.bool_or(_error() & F.col("code").isin(RETRANSLATE))
    return issues.groupBy(*key).agg(F.when(layout, "repair_layout").when(again, "retranslate").otherwise("stop").alias("action"))


def fingerprints(issues: DataFrame, key: list[str]) -> DataFrame:
    """Two identities of a set of issues, whatever their order: pages compared as numbers, and as text."""
    rows = F.array_sort(F.collect_list(F.struct("severity", "code", "page", "message")))
    text = lambda s: F.concat_ws("\t", s["severity"], s["code"], s["page"].cast("string"), s["message"])
    bars = lambda s: F.concat_ws("|", s["severity"], s["code"], s["page"].cast("string"), s["message"])
    g = issues.groupBy(*key).agg(rows.alias("xs"))
    cut = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return g.select(*key, cut(F.array_join(F.transform("xs", text), "\n")).alias("by_page"), cut(F.array_join(F.array_sort(F.transform("xs", bars)), "\n")).alias("by_text"))


def by_code(issues: DataFrame, key: list[str]) -> DataFrame:
    return issues.groupBy(*key, "code").agg(F.count("*").alias("n"), F.count_if(_error()).alias("errors"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))), ",").alias("pages"))


def messages(issues: DataFrame, key: list[str], order: str) -> DataFrame:
    """What a person is told: up to three codes in order of appearance, with up to five pages each."""
    # The words of the message.
    e = issues.where(_error()).groupBy(*key, "code").agg(F.min(order).alias("o"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"))
    one = lambda x: F.when(F.size(x["pages"]) > 0, F.concat(x["code"], F.lit("（第 "), F.array_join(F.slice(x["pages"], 1, 5).cast("array<string>"), "、"), F.lit(" 页）"))).otherwise(x["code"])
    g = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "code", "pages"))).alias("xs"), F.sum("n").alias("n"))
    more = F.when(F.size("xs") > 3, F.concat(F.lit("；另有 "), (F.size("xs") - 3).cast("string"), F.lit(" 类"))).otherwise("")
    return g.select(*key, F.concat(F.lit("译后检查未通过："), F.col("n").cast("string"), F.lit(" 个错误；"), F.array_join(F.transform(F.slice("xs", 1, 3), one), "；"), more).alias("message"))


def reports(scored: DataFrame, visual: DataFrame, key: list[str]) -> DataFrame:
    """Strict and plain passes: no errors, for a strict pass no actionable warning either, and a sound visual score."""
    r = visual.join(scored, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    ok = (n("errors") == 0) & (F.col("visual") >= VISUAL)
    return r.select(*key, n("errors").alias("errors"), n("actionable").alias("actionable"), n("issues").alias("issues"), "visual", (ok & (n("actionable") == 0)).alias("strict_pass"), ok.alias("plain_pass"))
