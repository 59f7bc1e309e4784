"""Column builders over the answers of language services: JSON in any wrapping, lists of texts in any shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwright.operators.scale import bind

# Where a list of texts may stand, in order, and the names of a text in an object.
LISTS = ["$.translations", "$.translated_texts", "$.results", "$.data.translations", "$.data.results"]
TEXTS = ["text", "translated_text", "translation"]


def without_fence(c: Column) -> Column:
    """The text inside a fence of backquotes, if there is one."""
    t = F.regexp_replace(c, r"^[\s]+|[\s]+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json|text)?\s*", ""), r"\s*```$", "")).otherwise(t)


def json_of(c: Column) -> Column:
    """The JSON of an answer as text: the whole without its fence, or else the part from the first bracket to the last of its
    kind; null if neither is JSON."""
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return bind(without_fence(c), lambda t: F.coalesce(valid(t), bind(F.regexp_extract(t, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1), valid)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text_list(v: Column) -> Column:
    """The texts of a variant that is a list of texts or of objects with one; null for anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")

    def one(x: Column) -> Column:
        named = [F.nullif(F.when(_kind(F.try_variant_get(x, f"$.{n}", "variant")) == "STRING", F.try_variant_get(x, f"$.{n}", "string")), F.lit("")) for n in TEXTS]
        return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(_kind(x).startswith("OBJECT"), F.coalesce(*named))

    texts = F.transform(items, one)
    return F.when(~F.exists(texts, lambda t: t.isNull()), texts)


def text_list(json: Column) -> Column:
    """The list of texts of a parsed answer: the whole, or the first of LISTS that is one; null if there is none."""
    return bind(F.try_parse_json(json), _first_list)


def _first_list(v: Column) -> Column:
    whole = F.when(_kind(v).startswith("ARRAY") & ~F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_kind(x) != "STRING", F.lit(True))), _text_list(v))
    return F.coalesce(whole, *[_text_list(F.try_variant_get(v, p, "variant")) for p in LISTS])


def chat_message(json: Column) -> Column:
    """The text of a chat answer: the first choice's message or text, or the text blocks of a content list in one; else null."""
    v = F.try_parse_json(json)
    string = lambda p: F.when(_kind(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    typed = F.filter(blocks, lambda b: F.coalesce((F.try_variant_get(b, "$.type", "string") == "text") & (_kind(F.try_variant_get(b, "$.text", "variant")) == "STRING"), F.lit(False)))
    joined = F.when(F.size(typed) > 0, F.array_join(F.transform(typed, lambda b: F.try_variant_get(b, "$.text", "string")), ""))
    return F.coalesce(string("$.choices[0].message.content"), string("$.choices[0].text"), joined)


def plain_text(c: Column) -> Column:
    """An answer taken as one text: the only text of its JSON, or the answer without its fence; null if nothing is left."""
    string = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    one = lambda json: F.coalesce(bind(F.try_parse_json(json), string), bind(text_list(json), lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))))
    return bind(F.trim(without_fence(c)), lambda t: F.nullif(F.trim(F.coalesce(bind(json_of(t), one), t)), F.lit("")))


def chat_url(c: Column) -> Column:
    """The address of a chat service, completed by what its end lacks."""
    u = F.regexp_replace(c, "/+$", "")
    return F.when(u.endswith("/chat/completions"), u).when(u.endswith("/v1"), F.concat(u, F.lit("/chat/completions"))).otherwise(F.concat(u, F.lit("/v1/chat/completions")))


def messages_url(c: Column) -> Column:
    """The same for a service that takes messages."""
    u = F.regexp_replace(c, "/+$", "")
    return F.when(u.endswith("/messages"), u).when(u.endswith("/v1"), F.concat(u, F.lit("/messages"))).otherwise(F.concat(u, F.lit("/v1/messages")))
