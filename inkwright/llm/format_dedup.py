"""Records that differ only in case, white space, punctuation or the order of their fields.

Each (label, value) pair is normalized and hashed on its own; the hashes of a record are added, which no order of fields
can change. Records with equal sums meet in one group, where the fields themselves are compared, so that a collision of
hashes joins nothing. No fields are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.operators.records import REQUIRED, payload_fields
from inkwright.operators.scale import bind, join_hot, letters_digits, stage

#: Hashes are added modulo this prime, below 2^61, so that no sum overflows.
PRIME = (1 << 61) - 1


def normal_fields(payload: Column) -> Column:
    """The multiset of normalized (label, value) pairs; null if a required label or its value is missing. Pairs without a
    value say nothing and are left out. Labels and values may have any length."""
    pairs = F.transform(payload_fields(payload), lambda p: F.struct(letters_digits(p["key"]).alias("label"), F.coalesce(letters_digits(p["value"]), F.lit("")).alias("value")))
    whole = lambda ps: F.array_size(F.array_intersect(F.transform(ps, lambda p: p["label"]), F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED)
    return bind(F.filter(pairs, lambda p: p["value"] != ""), lambda ps: F.when(whole(ps), ps))


def equal_multisets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same members equally often."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    members = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) == F.size(b)) & members & (plain | F.forall(a, lambda x: times(a, x) == times(b, x)))


def multiset_hash(pairs: Column, seed: int) -> Column:
    """A hash of a multiset: the sum of the hashes of its members."""
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: (acc + F.pmod(F.xxhash64(F.lit(seed), p["label"], p["value"]), F.lit(PRIME))) % F.lit(PRIME))


def collapse_records(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, kept_id): every record with the smallest id of its group of copies. Null, blank and cut-off payloads are no
    records and give no row. A group may hold any share of all rows: groups are counted before anything is joined, and the rows
    of a hot group don't shuffle. Rows repeated under one id count once."""
    parsed = records.select(F.col(id_col).alias("record_id"), normal_fields(F.col(payload_col)).alias("pairs"))
    # filtered after the write: a filter before it would parse every payload twice
    recs = stage(parsed.select("record_id", "pairs", multiset_hash(F.col("pairs"), 1).alias("f1"), multiset_hash(F.col("pairs"), 2).alias("f2")), "records").where("pairs is not null and record_id is not null")
    keys = recs.select("record_id", "f1", "f2")
    groups = keys.groupBy("f1", "f2").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n"))
    shared = stage(groups.where("n > 1"), "groups")
    firsts = recs.join(shared.select(F.col("first_id").alias("record_id"), "f1", "f2"), ["record_id", "f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.first("pairs").alias("first_pairs"))
    met = join_hot(recs, shared.join(firsts, ["f1", "f2"]), ["f1", "f2"], "n", keys.count())
    same = equal_multisets(F.col("pairs"), F.col("first_pairs"))
    fields = F.array_join(F.array_sort(F.transform("pairs", lambda p: F.concat_ws("\x01", p["label"], p["value"]))), "\x02")
    met = stage(met.select("record_id", "first_id", bind(same, lambda s: F.when(~s, fields)).alias("other")), "met")
    equal = met.where("other is null").select("record_id", F.col("first_id").alias("kept_id"))
    # fields differ under one pair of sums: such rows, if any, are grouped by the fields themselves
    other = met.where("other is not null")
    other = other.join(other.groupBy("other").agg(F.min("record_id").alias("kept_id")), "other").select("record_id", "kept_id")
    single = keys.join(shared.select("f1", "f2"), ["f1", "f2"], "left_anti").select("record_id", F.col("record_id").alias("kept_id"))
    return equal.unionByName(other).unionByName(single).distinct()


def copies(records: DataFrame) -> DataFrame:
    """(kept_id, record_id): one row for each copy that isn't the kept record itself."""
    return collapse_records(records).where("record_id <> kept_id").select("kept_id", "record_id")


def copy_counts(records: DataFrame) -> DataFrame:
    """(kept_id, copies): one row per distinct record, with how many rows it had."""
    return collapse_records(records).groupBy("kept_id").agg(F.count("*").alias("copies"))
