"""Raw glossary records: labels with values, in one of several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions.text import strip
from inkwright.operators.scale import bind, letters_digits

#: Labels without which a payload counts as cut off.
REQUIRED = ("field", "en", "zh")


# SQL that gives the (record_id, place, label, value) of the payloads of term_records, as payload_fields does, and the values of
# each record, as record_values does.
PAIRS_SQL = """pl as (select record_id, trim(payload, ' ') as p from term_records where payload is not null and record_id is not null),
js as (select record_id, unnest(json_keys(p)) as label, generate_subscripts(json_keys(p), 1) as place, p from pl where regexp_matches(p, '(?s)^\\{.*\\}$') and json_valid(p)),
jp as (select record_id, place, label, json_extract_string(p, '$."' || replace(label, '"', '\\"') || '"') as value from js),
sg as (select record_id, case when regexp_extract(p, '^[^:=|;]+([:=])', 1) = ':' then ':' else '=' end as sign, case when regexp_extract(p, '^[^:=|;]+([:=])', 1) = ':' then '|' else ';' end as bar, p from pl where not starts_with(p, '{') and regexp_matches(p, '^[^:=|;]+[:=]')),
s1 as (select record_id, sign, bar, unnest(string_split(p, bar)) as part, generate_subscripts(string_split(p, bar), 1) as i from sg),
s2 as (select *, case when i = 1 or regexp_matches(part, case when sign = ':' then '^[^:=|;]+:' else '^[^:=|;]+=' end) then 1 else 0 end as new from s1), s3 as (select *, sum(new) over (partition by record_id order by i) as g from s2),
s4a as (select record_id, g, any_value(sign) as sign, any_value(bar) as bar, list(part order by i) as parts from s3 group by record_id, g), s4 as (select record_id, g, sign, list_reduce(parts, lambda a, b: a || bar || b) as pair from s4a),
tp as (select record_id, g as place, substr(pair, 1, strpos(pair, sign) - 1) as label, substr(pair, strpos(pair, sign) + 1) as value from s4), raw as (select record_id, place, label, value from jp union all select record_id, place, label, value from tp)"""
NORMAL_SQL = "regexp_replace(replace(lower(upper({})), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
STRIP_SQL = "regexp_replace({0}, '^[\\s\\x0b\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+|[\\s\\x0b\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+$', '', 'g')"
VALUES_SQL = f"""{PAIRS_SQL}, nv as (select record_id, place, {NORMAL_SQL.format('label')} as label, {STRIP_SQL.format('value')} as value from raw), fv as (select * from nv where value <> '' and label in ('field', 'en', 'zh')),
rec as (select record_id, arg_min(value, place) filter (label = 'field') as field, arg_min(value, place) filter (label = 'en') as en, arg_min(value, place) filter (label = 'zh') as zh from fv group by 1 having count(distinct label) = 3)"""


def payload_fields(payload: Column) -> Column:
    """The array of (label, value) of a raw record, as written: a JSON object, or label and value joined by a colon with
    bars between pairs, or by an equals sign with semicolons between them. Null for what is none of these."""
    text = F.trim(payload)
    as_json = F.map_entries(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))

    def pairs(between: str, join: str) -> Column:
        return F.transform(
            F.split(text, between + r"(?=[^:=|;]+" + join + ")"),
            lambda x: F.struct(F.substring_index(x, join, 1).alias("key"), F.substring(x, F.locate(join, x) + 1, F.length(x)).alias("value")),
        )

    plain = bind(F.regexp_extract(text, r"^[^:=|;]+([:=])", 1), lambda sign: F.when(sign == ":", pairs(r"\|", ":")).when(sign == "=", pairs(";", "=")))
    return F.when(text.rlike(r"(?s)^\{.*\}$"), as_json).when(~text.startswith("{"), plain)


def record_values(records: DataFrame, *keep: str, payload_col: str = "payload") -> DataFrame:
    """(keep..., field, en, zh): the values of each record without outer white space, whatever its layout and however its labels
    are written; of a repeated label the first value counts. A blank, null or cut-off payload is no record and gives no row."""
    pairs = F.transform(payload_fields(F.col(payload_col)), lambda p: F.struct(letters_digits(p["key"]).alias("label"), strip(p["value"]).alias("value")))
    full = records.select(*keep, F.filter(pairs, lambda p: p["value"] != "").alias("pairs"))
    first = lambda k: F.get(F.filter("pairs", lambda p: p["label"] == k), F.lit(0))["value"].alias(k)
    return full.select(*keep, *map(first, REQUIRED)).dropna(subset=list(REQUIRED))
