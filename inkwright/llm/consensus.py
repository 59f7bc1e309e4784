"""One surviving value per field of a group of duplicates, by a weighted consensus of tokens.

The distinct values of a field are aligned progressively, the most trusted first, into columns of tokens; each column
votes; the existing value closest to the winning tokens is emitted, with the row that supplies it. Votes are added up, or,
where trust is a strict order, the most trusted backer of a token decides, as if each row outweighed all below it.

Values are reduced to distinct ones before they are gathered, and a group with more than BLOCK distinct values is aligned
in blocks whose winners are aligned again, so that no task holds an unbounded group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwright.operators.scale import fold_case, stage

BLOCK = 256
GAP = ""
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]")


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def _align(profile: list[dict[str, list[float]]], words: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs (column, token) of the cheapest global alignment; None marks a gap. A token costs nothing in a column that has it."""
    n, m = len(profile), len(words)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        cost[i][0] = i
    for j in range(1, m + 1):
        cost[0][j] = j
    for i in range(1, n + 1):
        col, above, here = profile[i - 1], cost[i - 1], cost[i]
        for j in range(1, m + 1):
            here[j] = min(above[j - 1] + (0.0 if words[j - 1] in col else 1.5), above[j] + 1, here[j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (0.0 if words[j - 1] in profile[i - 1] else 1.5):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and substitutions of tokens between two values."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def consensus(values: list[str], weights: list[float], strict: bool = False) -> tuple[list[str], int]:
    """The winning tokens, and the index of the existing value closest to them (ties: the earlier value). `values` come in
    falling trust; with `strict` the first backer of a token decides a column, else the sum of its backers' weights."""
    if len(values) == 1:
        return tokens(values[0]), 0
    profile: list[dict[str, list[float]]] = []
    split = [tokens(v) for v in values]
    for row, words in enumerate(split):
        merged = []
        for col, tok in _align(profile, words):
            votes = profile[col] if col is not None else {GAP: list(range(row))} if row else {}
            votes.setdefault(words[tok] if tok is not None else GAP, []).append(row)
            merged.append(votes)
        profile = merged
    pick = (lambda v: -min(v)) if strict else (lambda v: (sum(weights[i] for i in v), -min(v)))
    won = [max(votes.items(), key=lambda kv: pick(kv[1]))[0] for votes in profile]
    won = [w for w in won if w != GAP]
    return won, min(range(len(split)), key=lambda i: (distance(split[i], won), i))


def surviving_rows(df: DataFrame, group: list[str], value: str, row_id: str, trust: list[Column], weight: Column | None = None) -> DataFrame:
    """(group..., row_id): for each group the row that supplies the surviving `value`.

    trust: columns in whose ascending order rows are trusted; ties go to the smaller row_id. Without `weight` that order is
    strict; with it, the rows' weights are added up. A null value votes as an empty one. Groups without rows give none.
    """
    strict = weight is None
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)], F.col(row_id).alias("id"))
    own = df.select(*group, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"), order.alias("o"), (F.lit(1.0) if strict else weight).alias("w"))
    level = own.groupBy(*group, "v").agg(F.min("o").alias("o"), F.sum("w").alias("w"))
    level = stage(level, "values")
    sizes = level.groupBy(*group).agg(F.count("*").alias("n"))
    item = T.ArrayType(T.StructType([f for f in level.select("o", "v", "w").schema]))

    @F.pandas_udf("int")
    def winner(rows: pd.Series) -> pd.Series:
        return rows.map(lambda xs: consensus([x["v"] for x in xs], [x["w"] for x in xs], strict)[1])

    while True:
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        blocks = level.join(sizes, group).withColumn("b", F.when(F.col("n") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / BLOCK * 2))))
        lists = blocks.groupBy(*group, "b").agg(F.array_sort(F.collect_list(F.struct("o", "v", "w"))).alias("xs"))
        alone, many = lists.where("size(xs) = 1"), lists.where("size(xs) > 1")
        won = alone.withColumn("i", F.lit(0)).unionByName(many.withColumn("i", winner(F.col("xs").cast(item))))
        level = won.select(*group, F.col("xs")[F.col("i")].alias("x"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["w"]).alias("w")).select(*group, F.col("x.v").alias("v"), F.col("x.o").alias("o"), "w")
        if most <= BLOCK:
            break
        level = stage(level, "values")
        sizes = level.groupBy(*group).agg(F.count("*").alias("n"))
    return level.select(*group, F.col("o.id").alias(row_id))


# --- papers -------------------------------------------------------------------------------------------------------------

#: A first year whose times can't be true.
FUTURE = "2027-01-01"
# What stands for a missing file name.
FILLERS = ["", "n/a", "na", "null", "none", "nil", "-", "--", "undefined", "unknown", "tbd", "?", "nan"]


def file_key(name: Column) -> Column:
    """A file name without case, spacing, punctuation, encoded spaces, extension and marks of a copy, however many."""
    n = F.trim(F.regexp_replace(F.regexp_replace(fold_case(name), "(%20|\\+|_)", " "), r"[\s\p{Z}]+", " "))
    ext = r"\s*\.\s*(pdf|ps|djvu|docx?|tex)"
    mark = r"\s*[\s\-–]\s*(copy|kopie|copie)(\s*\(?\d{1,3}\)?)?|\s*\(\d{1,3}\)|\s*(的)?副本(\s*\(?\d{1,3}\)?)?"
    bare = F.regexp_replace(F.regexp_replace(n, f"({ext}|{mark})+$", ""), r"^((copy|kopie|copie)( \(\d+\))? (of|von|de) )+", "")
    only = F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")
    return F.when(only == "", F.regexp_replace(n, r"\s", "")).otherwise(only)


def best_papers(papers: DataFrame) -> DataFrame:
    """(group_id, status_id, file_id, name_id) of each group of two or more rows with one scope, size and file key.

    Rows whose scope, size or file name is null are in no group. An updated_at that is null, before created_at, or in 2027 or
    later isn't trusted: such rows come after all others and tie. A null created_at comes last. Ties: the smaller id.
    The rule names the most trusted row, so an aggregate takes it; a consensus has no say.
    """
    members = grouped(papers)
    status = first_rows(members, recent_first()).withColumnRenamed("id", "status_id")
    file = first_rows(filed(members), recent_first()).withColumnRenamed("id", "file_id")
    name = first_rows(members, oldest_first()).withColumnRenamed("id", "name_id")
    return status.join(file, "group_id", "left").join(name, "group_id").select("group_id", "status_id", F.coalesce("file_id", F.lit("")).alias("file_id"), "name_id")


def consensus_papers(papers: DataFrame) -> DataFrame:
    """(group_id, status_id, file_id, name_id) of the groups of `best_papers`, each row with one vote: the row whose value is
    closest to the consensus of tokens supplies it, the rows of one value in the order of `best_papers`. This isn't TESTDATA's rule."""
    members, g, one = grouped(papers), ["group_id"], F.lit(1.0)
    status = surviving_rows(members, g, "translation_status", "id", recent_first(), one).withColumnRenamed("id", "status_id")
    file = surviving_rows(filed(members), g, "translated_filename", "id", recent_first(), one).withColumnRenamed("id", "file_id")
    name = surviving_rows(members, g, "original_filename", "id", oldest_first(), one).withColumnRenamed("id", "name_id")
    return status.join(file, g, "left").join(name, g).select("group_id", "status_id", F.coalesce("file_id", F.lit("")).alias("file_id"), "name_id")


def first_rows(members: DataFrame, trust: list[Column]) -> DataFrame:
    """(group_id, id): the first row of each group in ascending order of `trust`; ties go to the smaller id."""
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)], F.col("id"))
    return members.groupBy("group_id").agg(F.min(order)["id"].alias("id"))


def recent_first() -> list[Column]:
    good = F.col("updated_at").isNotNull() & (F.col("updated_at") < F.lit(FUTURE).cast("timestamp_ntz")) & ~F.coalesce(F.col("updated_at") < F.col("created_at"), F.lit(False))
    late_first = F.when(good, -F.unix_micros(F.col("updated_at").cast("timestamp"))).otherwise(F.lit(0))
    return [F.when(good, 0).otherwise(1), late_first]


def oldest_first() -> list[Column]:
    return [F.col("created_at").isNull().cast("int"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))]


def filed(members: DataFrame) -> DataFrame:
    """The rows with a translated_filename that is neither blank nor a filler."""
    return members.where(~F.coalesce(F.lower(F.trim(F.regexp_replace("translated_filename", r"[\s\p{Z}]+", " "))), F.lit("")).isin(FILLERS))


def grouped(papers: DataFrame) -> DataFrame:
    """The rows of papers in groups of two or more, with their group_id."""
    key = ["access_scope", "file_size", "k"]
    rows = papers.select("id", "access_scope", "file_size", "translation_status", "translated_filename", "original_filename", "created_at", "updated_at", file_key(F.col("original_filename")).alias("k"))
    rows = stage(rows.dropna(subset=["id", *key]).dropDuplicates(["id"]), "papers")  # the keys are needed twice
    groups = rows.groupBy(*key).agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return stage(rows.join(groups, key).drop(*key), "members")
