"""Column builders over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"
CJK_WIDE = "[㐀-鿿]"
#: White space of any script; \s alone is ASCII.
ANY_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
# Words that mark running English prose.
STOPWORDS = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "as", "by", "are", "from", "this", "which"]


def contains_ignoring_case(c: Column, value: str) -> Column:
    return F.lower(c).contains(value.lower())


def clean_hash(c: Column) -> Column:
    """64 hex digits however written; null for a blank, all-zero or otherwise meaningless hash."""
    h = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*(sha-?256\s*[:=]?\s*|0x)", ""), r"[^0-9a-z]", "")
    return F.when(h.rlike("^[0-9a-f]{64}$") & ~h.rlike("^0+$"), h)


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, f"^{ANY_SPACE}|{ANY_SPACE}$", "")


# What stands for Chinese without its region or script.
CHINESE = ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "华语", "華語", "普通话", "普通話", "国语", "國語", "简体中文", "繁体中文", "簡體中文", "繁體中文", "simplified chinese", "traditional chinese"]


def says_chinese(lang: Column) -> Column:
    """Whether a language is named as Chinese: a code with or without region and script, or a name; case and spaces aside."""
    name = F.lower(strip(lang))
    return F.coalesce(F.regexp_extract(name, r"^([^-_.(（]*[^-_.(（\s])\s*([-_.(（].*)?$", 1).isin(CHINESE), F.lit(False))


def placeholders(c: Column) -> Column:
    """The placeholders of a protected text, sorted: equal lists mean equal multisets."""
    return F.array_sort(F.regexp_extract_all(c, F.lit("⟦\\d+⟧"), F.lit(0)))


def word_key(c: Column) -> Column:
    """A term without hyphens, spare spaces and case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(c, F.lit("-"), F.lit(" ")), r"[\s\p{Z}]+", " ")))


def duration(seconds: Column) -> Column:
    """1小时02分, 3分04秒 or 5秒."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = (seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long")
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("秒")))
        .when(seconds < 3600, F.concat(m.cast("string"), F.lit("分"), pad(s), F.lit("秒")))
        .otherwise(F.concat(h.cast("string"), F.lit("小时"), pad(m), F.lit("分")))
    )


def last_eta(log: Column) -> Column:
    """Seconds of the last remaining time named in a log; null for none or zero."""
    last = F.try_element_at(F.regexp_extract_all(log, F.lit(r"预计剩余\s*(?:\d+小时)?(?:\d+分)?(?:\d+秒)?"), F.lit(0)), F.lit(-1))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(last, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.nullif(part("小时") * 3600 + part("分") * 60 + part("秒"), F.lit(0))


def text_height(c: Column, size: float, width: float) -> Column:
    """Height of a text set in lines of a width: wide characters take one size, others half; lines are 1.5 sizes apart."""
    wide = lambda x: F.length(F.regexp_replace(x, r"[\x{0}-\x{2E7F}]", ""))
    lines = F.transform(F.split(c, "\n"), lambda x: F.greatest(F.lit(1), F.ceil((wide(x) + F.length(x)) * (size / 2) / width)))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x) * (size * 1.5)


def clean_lines(c: Column) -> Column:
    """Without control characters, no-break spaces, lines that are only a line number, and line numbers glued to Han text."""
    flat = F.replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), F.lit("\xa0"), F.lit(" "))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.split(flat, "\n"), strip)
    lines = F.filter(lines, lambda x: ~x.rlike(r"^\d{1,3}$"))
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"([一-鿿　-〿＀-￯])\d{1,3}$", "$1")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# Phrases of injected prompts.
MARKERS = ["in your output", "must include", "ignore previous", "ignore all previous", "system prompt", "overall, i find this submission"]


def injected(c: Column) -> Column:
    """Two phrases of an injected prompt, or the strong one."""
    flat = F.regexp_replace(F.lower(c), r"\s+", " ")
    hits = sum((flat.contains(m).cast("int") for m in MARKERS), F.lit(0))
    return (hits >= 2) | flat.contains("in your output you must include")


# Rewrites of an error message, in order; the bound before and after.
REDACTIONS = [
    (r"(?i)Bearer\s+\S+", "Bearer [redacted]"),
    (r"(?i)(api[_-]?key|token|secret)\s*[=:]\s*\S+", "$1=[redacted]"),
    (r"\bsk-[a-zA-Z0-9_-]{8,}", "[redacted]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted]"),
    (r"\bgh[pousr]_[a-zA-Z0-9]{20,}\b", "[redacted]"),
    (r"\b[A-Z_]+(?:API_KEY|SECRET|TOKEN|PASSWORD)=[^\s,;]+", "[redacted]"),
    (r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "[redacted]"),
    (r"\b(?:mongodb|postgresql|mysql|redis|amqp)://[^\s]+", "[redacted]"),
    (r"-----BEGIN [A-Z ]+ KEY-----", "[redacted]"),
    (r"(?<![:/])/[a-zA-Z0-9._/-]+", "[path]"),
    (r"[A-Z]:\\[^\s:]+", "[path]"),
    (r'File "[^"]*", line \d+', 'File "[module]"'),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "[ip]"),
    (r"\[[0-9a-fA-F:%]+\](?::\d+)?", "[ip]"),
    (r"(?<![a-zA-Z0-9])[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,}(?:%\w+)?(?::\d+)?(?![a-zA-Z0-9])", "[ip]"),
    (r"\b[a-zA-Z0-9.-]+\.\w{2,}:\d+\b", "[host]"),
    (r"\blocalhost:\d+\b", "[host]"),
]
LONGEST_ERROR, SHOWN_ERROR = 500, 200


def redact_error(c: Column, capped: bool = True) -> Column:
    """A text without secrets, paths, addresses and hosts. `capped`, for error messages: only the first LONGEST_ERROR characters
    are taken, and of the result the first SHOWN_ERROR are shown."""
    out = F.substring(c, 1, LONGEST_ERROR) if capped else c
    for pattern, put in REDACTIONS:
        out = F.regexp_replace(out, pattern, put)
    return F.when(F.length(out) > SHOWN_ERROR, F.concat(F.substring(out, 1, SHOWN_ERROR), F.lit("..."))).otherwise(out) if capped else out


def safe_id(c: Column) -> Column:
    """Letters, digits, underscores and hyphens; all else becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")
