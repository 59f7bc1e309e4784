"""Queries of a library: pages of a listing, totals, the newest row of a key, repeated uploads, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwright.functions.text import clean_hash, contains_ignoring_case


def scoped(papers: DataFrame, scope: str, title: str = "", status: str = "", tag: str = "") -> DataFrame:
    """The papers of one scope; empty arguments filter nothing. Title and tags match anywhere, case aside."""
    out = papers.where(F.col("access_scope") == scope)
    if title:
        out = out.where(contains_ignoring_case(F.col("title"), title))
    if status:
        out = out.where(F.col("translation_status") == status)
    return out.where(contains_ignoring_case(F.col("tags"), tag)) if tag else out


def page(df: DataFrame, newest: str, tie: str, limit: int, offset: int) -> DataFrame:
    """One page, newest first; limits lie in 1..200. A top-k over the input, never a full sort."""
    return df.orderBy(F.desc(newest), F.asc(tie)).offset(max(0, offset)).limit(min(max(1, limit), 200))


def totals(papers: DataFrame) -> DataFrame:
    return papers.groupBy("access_scope").agg(
        F.count("*").alias("papers"), F.count_if(F.col("translation_status") == "completed").alias("completed"),
        F.count_if(F.col("page_count") == 0).alias("without_pages"),
    )


def latest_states(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last state of each key, whatever the order of arrival: an aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    last = F.max(F.struct(*order, *rest)).alias("s")
    return rows.groupBy(key).agg(last).select(key, *[F.col(f"s.{c}").alias(c) for c in rows.columns if c != key])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank. Each task keeps k rows of a key before the shuffle, so that a key with
    much of all rows stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def repeated_uploads(uploads: DataFrame) -> DataFrame:
    """(scope, sha, file_size, uploads, first_id): contents that a scope holds, with the earliest upload."""
    u = uploads.select(F.lower(F.trim("access_scope")).alias("scope"), clean_hash(F.col("content_sha256")).alias("sha"), "file_size", F.struct("created_at", "id").alias("o")).dropna()
    return u.groupBy("scope", "sha", "file_size").agg(F.count("*").alias("uploads"), F.min("o").alias("o")).select("scope", "sha", "file_size", "uploads", F.col("o.id").alias("first_id"))


def chunk_plan(uploads: DataFrame) -> DataFrame:
    """(id, chunk, size): the chunks an upload must have; the last one is what is left."""
    n = F.expr("(file_size + chunk_size - 1) div chunk_size")
    return uploads.where("file_size > 0 and chunk_size > 0").select(
        "id", "file_size", "chunk_size", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk")
    ).select("id", "chunk", F.least(F.col("chunk_size").cast("long"), F.col("file_size") - F.col("chunk").cast("long") * F.col("chunk_size")).alias("size"))
