"""Queries of the problems about training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.llm import consensus, format_dedup, history_dedup, leakage, lookalike, pii, tokens
from inkwright.llm.sql import SQL
from inkwright.plans.registry import Registry
from inkwright.sources.tables import table

LLM = Registry()


def _query(name: str):
    return LLM.query(name, SQL.get(name))


@_query("p1_found")
def p1_found(spark, sf_dir):
    return history_dedup.repeats_of_accepted(table(spark, sf_dir, "pdf_upload_sessions"))


@_query("p2_found")
def p2_found(spark, sf_dir):
    return format_dedup.copies(table(spark, sf_dir, "term_records", "record_id", "payload"))


@_query("p2_counts")
def p2_counts(spark, sf_dir):
    """One row per distinct record with its number of copies."""
    return format_dedup.copy_counts(table(spark, sf_dir, "term_records", "record_id", "payload"))


@_query("p4_found")
def p4_found(spark, sf_dir):
    return lookalike.lookalike_pairs(table(spark, sf_dir, "corpus"))


@_query("p4_forms")
def p4_forms(spark, sf_dir):
    """Every term in its consistent form."""
    out = lookalike.consistent(table(spark, sf_dir, "corpus", "term_id", "en", "zh"), ["en", "zh"])
    return out.select("term_id", "en_form", "zh_form")


@_query("p5_found")
def p5_found(spark, sf_dir):
    return consensus.best_papers(table(spark, sf_dir, "papers"))


@_query("p5_consensus")
def p5_consensus(spark, sf_dir):
    """The rows that a consensus of tokens with equal votes picks, for comparison with p5_found."""
    return consensus.consensus_papers(table(spark, sf_dir, "papers"))


@_query("p6_ids")
def p6_ids(spark, sf_dir):
    return tokens.token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("p7_found")
def p7_found(spark, sf_dir):
    return leakage.leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


@_query("p8_found")
def p8_found(spark, sf_dir):
    return pii.found_values(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("p8_redacted")
def p8_redacted(spark, sf_dir):
    """Every text with placeholders for its personal information."""
    out = pii.redacted(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_values", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))
