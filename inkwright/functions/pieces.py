"""Column builders that take texts apart: sentences, protected fragments, list marks, acronyms, licences, logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0b\x85\p{Z}]"
#: Characters that a part of a split sentence holds at least.
SHORTEST = 80
# What is protected in a text; marks of list items by style; how long a log may grow.
PROTECTED = r"\$[^$\n]+\$|https?://[^\s\x0b\x85\p{Z}]+|\\cite\{[^}]*\}"
MARKERS = [("bullet", "^[•▪◦‣·]"), ("dash", r"^[-*][ \t]"), ("number", r"^\(?[0-9]{1,2}[).][ \t]"), ("roman", r"^\(?[ivxIVX]{1,4}\)[ \t]")]
LONGEST_LOG = 2000
# Fixed value: the address of a licence in a page.
LICENSE = r"https?://(?:arxiv\.org/licenses|creativecommons\.org/(?:licenses|publicdomain))/[a-z0-9./-]+"
CUT = "\x01"


def split_point(c: Column, shortest: int = SHORTEST) -> Column:
    """The place behind the end of a sentence that is nearest to the middle of a text, with `shortest` characters on both sides;
    the first of two; null if there is none."""
    parts = F.split(F.regexp_replace(c, rf"([.!?]{BLANK}+)", "$1" + CUT), CUT)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(F.lit(None))), F.lit(0)) + F.length(p))))
    n = F.length(c)
    good = F.filter(F.slice(ends, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda e: (e >= shortest) & (e <= n - shortest))
    return F.array_min(F.transform(good, lambda e: F.struct(F.abs(e - n / 2).alias("d"), e.alias("e"))))["e"]


def protect(c: Column, pattern: str = PROTECTED) -> tuple[Column, Column]:
    """A text with numbered marks in place of protected fragments, and the fragments in their order."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    rest = F.split(c, pattern)
    marks = F.transform(rest, lambda p, i: F.concat(F.when(i > 0, F.concat(F.lit("⟦"), (i - 1).cast("string"), F.lit("⟧"))).otherwise(""), p))
    return F.array_join(marks, ""), found


def restore(c: Column, fragments: Column) -> Column:
    """The text with its fragments back in the places of their marks; marks beyond the fragments stay."""
    rest = F.split(c, r"⟦\d+⟧")
    marks = F.regexp_extract_all(c, F.lit(r"⟦(\d+)⟧"), F.lit(1))
    one = lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get(fragments, F.get(marks, i - 1).cast("int")), F.concat(F.lit("⟦"), F.get(marks, i - 1), F.lit("⟧")))).otherwise(""), p)
    return F.array_join(F.transform(rest, one), "")


def list_style(line: Column) -> Column:
    """The style of a list item by its mark; null for other lines."""
    t = F.regexp_replace(line, f"^{BLANK}+", "")
    return F.coalesce(*[F.when(t.rlike(p), name) for name, p in MARKERS])


def append_log(log: Column, message: Column, now: Column, longest: int = LONGEST_LOG) -> Column:
    """A log with a stamped line more, of which the last `longest` characters are kept."""
    line = F.concat(F.lit("["), F.date_format(now, "HH:mm:ss"), F.lit("] "), message)
    whole = F.when(F.coalesce(log, F.lit("")) == "", line).otherwise(F.concat(log, F.lit("\n"), line))
    return F.when(F.length(whole) > longest, F.substring(whole, F.length(whole) - longest + 1, F.lit(longest))).otherwise(whole)


def scope_name(c: Column) -> Column:
    """A workspace's name as a stable value: other characters than letters, digits and ._- become one underscore; `local` for none."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""), "[^0-9A-Za-z_.-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(F.substring(v, 1, 80), F.lit("")), F.lit("local"))


def parse_time(c: Column) -> Column:
    """A time in ISO form, with an offset or Z, or without one and then in UTC; null for anything else."""
    iso = c.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)?)?$")
    return F.when(iso, F.try_to_timestamp(F.when(c.rlike(r"(Z|[+-]\d\d:\d\d)$"), c).otherwise(F.when(F.length(c) > 10, F.concat(c, F.lit("Z"))).otherwise(F.concat(c, F.lit("T00:00:00Z"))))))


def filler(n: Column) -> Column:
    """A stand-in of a text of n characters, of a length that fits."""
    times = F.greatest(F.lit(1), F.least(F.lit(24), F.floor(n / 14).cast("int") + 1))
    return F.when(n <= 0, "").otherwise(F.concat(F.lit("中文占位译文。"), F.substring(F.repeat(F.lit("用于检查版面。"), 24), F.lit(1), F.greatest(F.lit(0), times * 7 - 7))))
