"""New batches held against everything accepted before, through a segment index for edit distance.

The distinct chunk digests of a session, sorted, are a string whose characters are digests. Two such strings have an
edit distance by insertions and deletions of exactly the number of digests that occur in one of them only, so a Jaccard
similarity of at least 0.8 is the bounded distance d <= (n + m) / 9 for lengths n and m. The index stores, of each string
of length n, a number of segments fixed by n, by position; a string within the distance must hold at least one of them
whole, near its position. A batch probes the index with its own substrings, verifies the distance of what it meets, and
appends its segments. The hash of the content with the file size is a string that must agree whole: one segment.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.functions.text import clean_hash
from inkwright.operators.scale import join_split, scratch, stage

#: A similarity of at least THRESHOLD counts; as a bound on the distance, d <= (n + m) * BOUND.
THRESHOLD, BOUND = 0.8, 1 / 9
#: Strings up to this length have segments by position; longer ones by range of the digest's hash.
BY_POSITION = 60


def max_distance(n: int, m: int) -> int:
    """The largest distance of strings of lengths n and m that are similar; -1 if none can be."""
    d = math.floor((n + m) * BOUND + 1e-9)
    d -= (d - (n - m)) % 2
    return d if d >= abs(n - m) else -1


def partners(n: int) -> range:
    return range(math.ceil(THRESHOLD * n - 1e-9), math.floor(n / THRESHOLD + 1e-9) + 1)


@lru_cache(maxsize=None)
def segment_count(n: int) -> int:
    """One more than the errors that any similar string may have."""
    return 1 + max(max_distance(n, m) for m in partners(n))


def segment_spans(n: int) -> list[tuple[int, int]]:
    """(start from 0, length) of the segments of a string of length n."""
    s = segment_count(n)
    q, r = divmod(n, s)
    out, at = [], 0
    for i in range(s):
        size = q + (i >= s - r)
        out.append((at, size))
        at += size
    return out


def probe_plan(m: int) -> list[tuple[int, int, int, int]]:
    """(n, segment, start, length): the substrings of a string of length m to look up. A segment that survives has at
    most i errors to its left, s-1-i to its right, and all errors together within the bound."""
    out = []
    for n in partners(m):
        most, s = max_distance(n, m), segment_count(n) if n <= BY_POSITION else 0
        if most < 0 or not s:
            continue
        for i, (start, size) in enumerate(segment_spans(n)):
            for k in range(-min(i, most), min(i, most) + 1):
                rest = abs(m - n - k)
                if rest <= s - 1 - i and abs(k) + rest <= most and 0 <= start + k and start + k + size <= m:
                    out.append((n, i, start + k, size))
    return out


def _plans(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """What to store by n, and what to probe by m: rules, of a size that BY_POSITION bounds."""
    store = [(n, n, i, a, b) for n in range(1, BY_POSITION + 1) for i, (a, b) in enumerate(segment_spans(n))]
    probe = [(m, *p) for m in range(1, max(partners(BY_POSITION)) + 1) for p in probe_plan(m)]
    schema = "m int, n int, i int, start int, size int"
    return F.broadcast(spark.createDataFrame(store, schema)), F.broadcast(spark.createDataFrame(probe, schema))


def sessions(df: DataFrame) -> DataFrame:
    """(id, ord, scope, hkey, dkey, digests) of upload sessions. hkey stands for scope, content and size, dkey for scope and
    set of digests; null where they say nothing."""
    scope = F.lower(F.trim("access_scope"))
    own = F.expr("array_sort(transform(array_distinct(filter(chunk_digests, x -> x is not null)), x -> xxhash64(x)))")
    h = clean_hash(F.col("content_sha256"))
    return df.select(
        F.col("id"),
        F.struct(F.col("batch_no").alias("b"), F.col("created_at").alias("t"), F.col("id").alias("id")).alias("ord"),
        scope.alias("scope"),
        F.when(h.isNotNull() & F.col("file_size").isNotNull() & scope.isNotNull(), F.unhex(F.md5(F.concat_ws("\x01", scope, h, F.col("file_size"))))).alias("hkey"),
        F.when((F.size("chunk_digests") > 0) & (F.size(own) > 0), own).alias("digests"),
    ).withColumn("dkey", F.when(F.col("digests").isNotNull() & F.col("scope").isNotNull(), F.unhex(F.md5(F.concat_ws("\x01", "scope", F.array_join(F.transform("digests", lambda x: x.cast("string")), ","))))))


def _cells(sets: DataFrame, probe: bool) -> DataFrame:
    """(cell, dkey) of sets (dkey, scope, digests): what is stored for them, or looked up."""
    store_plan, probe_rows = _plans(sets.sparkSession)
    sized = sets.withColumn("m", F.size("digests"))
    by_pos = sized.join(probe_rows if probe else store_plan, "m").select(
        F.xxhash64("scope", "n", "i", F.expr("slice(digests, start + 1, size)")).alias("cell"), "dkey"
    )
    # long strings: more parts than errors, each a range of hash values; empty parts are no segment
    rank = "cast(floor(ln(m) / ln(1.25)) as int)"
    classes = f"array({rank} - 1, {rank}, {rank} + 1)" if probe else f"array({rank})"
    longer = sized.where(F.col("m") >= (min(partners(BY_POSITION)) if probe else BY_POSITION + 1))
    parts = longer.select("scope", "dkey", "digests", F.explode(F.expr(classes)).alias("c")).withColumn("p", F.expr("cast(2 * floor(power(1.25, c + 1) / 4) + 3 as int)"))
    by_range = (
        parts.select("scope", "dkey", "c", "p", F.explode("digests").alias("x"))
        .groupBy("scope", "dkey", "c", F.expr("shiftrightunsigned(x, 33) % p").alias("part"))
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
        .select(F.xxhash64("scope", F.lit("range"), "c", "part", "xs").alias("cell"), "dkey")
    )
    return by_pos.unionByName(by_range)


def _accept(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """nodes (hkey, dkey, ord) without a neighbour in the history; near (a, b), both ways. Those of them that are accepted:
    in order, each that no accepted one before it resembles. Rounds settle all nodes that wait for nobody."""
    spark = nodes.sparkSession
    hn = nodes.where("hkey is not null").groupBy("hkey").agg(F.count("*").alias("c")).where("c > 1").select("hkey")
    dn = nodes.where("dkey is not null").groupBy("dkey").agg(F.count("*").alias("c")).where("c > 1").select("dkey")
    live = nodes.where("dkey is not null").select(F.col("dkey").alias("b")).distinct()
    nn = near.join(live, "b", "left_semi").select(F.col("a").alias("dkey")).distinct()
    tangled = (
        nodes.join(hn.withColumn("x", F.lit(1)), "hkey", "left").join(dn.unionByName(nn).distinct().withColumn("y", F.lit(1)), "dkey", "left")
        .withColumn("state", F.when(F.col("x").isNull() & F.col("y").isNull(), 1).otherwise(0)).drop("x", "y")
    )
    tangled = stage(tangled, "nodes")
    free, open_ = tangled.where("state = 1"), tangled.where("state = 0")
    settled = []
    while True:
        if not open_.limit(1).count():
            break
        least = lambda key, s: F.min(F.when(F.col("state") == s, F.col("ord")))
        by_h = open_.where("hkey is not null").groupBy("hkey").agg(least("hkey", 1).alias("ha"), least("hkey", 0).alias("hu"))
        by_d = open_.where("dkey is not null").groupBy("dkey").agg(least("dkey", 1).alias("da"), least("dkey", 0).alias("du"))
        by_n = near.join(by_d.withColumnRenamed("dkey", "b"), "b").groupBy(F.col("a").alias("dkey")).agg(F.min("da").alias("na"), F.min("du").alias("nu"))
        seen = open_.join(by_h, "hkey", "left").join(by_d, "dkey", "left").join(by_n, "dkey", "left")
        before = lambda *cs: F.coalesce(F.array_min(F.array_compact(F.array(*cs))) < F.col("ord"), F.lit(False))
        new = F.when(F.col("state") != 0, F.col("state")).when(before("ha", "da", "na"), -1).when(~before("hu", "du", "nu"), 1).otherwise(0)
        open_ = stage(seen.select(*open_.columns[:-1], new.alias("state")).where("state >= 0"), "nodes")
        if not open_.where("state = 0").limit(1).count():
            break
    settled = [free, open_.where("state = 1")]
    out = settled[0].unionByName(settled[1])
    return out.select("hkey", "dkey", "ord")


class UploadHistory:
    """The accepted sessions and their segment index: tables in one folder of the cluster's shared storage, split by a hash of the
    key they are looked up by, grown by appending, and opened again by any later session.

    `feed(batch)` gives the pairs (repeat, accepted session it repeats) of one or more new batches and appends what they
    bring. A batch reads only the splits that its own keys fall into, so a small batch costs the same beside any history; the
    number of splits is chosen when the index is made, by its size. What a batch appends counts from one commit on, a file
    written last; a crash before it leaves nothing behind that a reader sees. Order is by batch_no, created_at, id, nulls
    first, so that feeding batches singly or together gives the same. Null or blank hashes and lists say nothing; null digests
    within a list are left out; a session without scope repeats nothing.
    """

    #: What is stored, and the key by which it is split.
    TABLES = {"cells": "cell", "sets": "dkey", "by_hash": "hkey", "by_set": "dkey"}
    #: Rows of the index in a split, and the most splits.
    SPLIT, MOST = 2_000_000, 4096

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = json.loads(spark.read.text(f"{self.path}/head.json", wholetext=True).first()[0])
        self.splits, self.schemas = head["splits"], head["schemas"]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> UploadHistory:
        """The index that an earlier session made at `path`."""
        return cls(spark, path)

    @classmethod
    def create(cls, accepted: DataFrame, path: str | None = None, split: int = SPLIT) -> UploadHistory:
        """A new index of sessions that are accepted as they stand. Without `path` it lasts as long as the session."""
        spark = accepted.sparkSession
        path = path or scratch(spark, "history")
        rows = stage(sessions(accepted), "sessions")
        sets = rows.where("dkey is not null").select("dkey", "scope", "digests").dropDuplicates(["dkey"])
        tables = cls._tables(rows, stage(sets, "sets"))
        splits = max(1, min(cls.MOST, math.ceil(tables["by_set"].count() * 8 / split)))
        schemas = {k: df.schema.json() for k, df in tables.items()}
        _write(spark, f"{path}/head.json", json.dumps({"splits": splits, "schemas": schemas}))
        new = cls(spark, path)
        new._append(tables)
        return new

    @staticmethod
    def _tables(rows: DataFrame, sets: DataFrame) -> dict[str, DataFrame]:
        return {
            "cells": _cells(sets, False), "sets": sets,
            "by_hash": rows.where("hkey is not null").select("hkey", "id", "ord"), "by_set": rows.where("dkey is not null").select("dkey", "id", "ord"),
        }

    def _split(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.splits)).cast("int")

    def _commits(self) -> list[int]:
        return sorted(int(n) for n in _names(self.spark, f"{self.path}/commits"))

    def _append(self, tables: dict[str, DataFrame]) -> None:
        """Adds rows to every table; they count from the commit on. A part that a crash left behind is overwritten."""
        n = max(self._commits(), default=-1) + 1
        for k, df in tables.items():
            df = df.withColumn("split", self._split(self.TABLES[k]))
            df = df.repartition("split") if self.splits > 1 else df
            df.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{self.path}/{k}/part={n}")
        _write(self.spark, f"{self.path}/commits/{n}", "")

    def _read(self, k: str, keys: DataFrame) -> DataFrame:
        """The rows of a table in the splits of `keys` (their numbers come to the driver: no more than MOST). A batch with at least
        as many keys as there are splits reads all of them."""
        from pyspark.sql.types import IntegerType, StructType

        key = self.TABLES[k]
        schema = StructType.fromJson(json.loads(self.schemas[k]))
        paths = [f"{self.path}/{k}/part={n}" for n in self._commits()]
        df = self.spark.read.schema(StructType(schema.fields).add("part", IntegerType()).add("split", IntegerType())).option("basePath", f"{self.path}/{k}").parquet(*paths).drop("part")
        if self.splits > 1 and keys.limit(self.splits).count() < self.splits:
            some = [r[0] for r in keys.select(self._split(key).alias("s")).distinct().collect() if r[0] is not None]
            df = df.where(F.col("split").isin(some))
        return df.drop("split")

    def _known(self, k: str, keys: DataFrame) -> DataFrame:
        """The rows of a table with one of `keys`."""
        key = self.TABLES[k]
        keys = keys.select(key).where(f"{key} is not null").distinct()
        return self._read(k, keys).join(keys, key, "left_semi")

    def similar(self, sets: DataFrame) -> DataFrame:
        """(a, b): dkeys of different sets, a from `sets` (new ones) and b from these or the index, whose edit distance is within
        the bound."""
        probes = _cells(sets, True).withColumnRenamed("dkey", "a")
        small = self.splits > 1 and sets.limit(self.splits).count() < self.splits  # then the splits are looked up, else all are read
        probes = stage(probes, "probes") if small else probes
        cells = self._read("cells", probes if small else sets.withColumn("cell", F.lit(0))).unionByName(_cells(sets, False)).withColumnRenamed("dkey", "b")
        met = stage(probes.join(cells, "cell").where(F.col("a") != F.col("b")).select("a", "b").distinct(), "met")
        every = self._known("sets", met.select(F.col("b").alias("dkey"))).unionByName(sets).dropDuplicates(["dkey"])
        one = sets.select(F.col("dkey").alias("a"), F.col("digests").alias("da"))
        two = every.select(F.col("dkey").alias("b"), F.col("digests").alias("db"))
        n, m, common = F.size("da"), F.size("db"), F.size(F.array_intersect("da", "db"))
        return met.join(one, "a").join(two, "b").where((n + m - 2 * common) * 9 <= n + m).select("a", "b")

    def feed(self, batch: DataFrame) -> DataFrame:
        """(repeat_id, kept_id) of the batch, and its accepted sessions appended."""
        rows = stage(sessions(batch), "sessions")
        sets = stage(rows.where("dkey is not null").select("dkey", "scope", "digests").dropDuplicates(["dkey"]), "sets")
        near = self.similar(sets)
        near = stage(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")
        # of the history, only what the batch meets
        old_h = stage(self._known("by_hash", rows.select("hkey")), "past").withColumnRenamed("hkey", "key")
        old_d = stage(self._known("by_set", rows.select("dkey").unionByName(near.select(F.col("b").alias("dkey")))), "past").withColumnRenamed("dkey", "key")

        nodes = rows.groupBy("hkey", "dkey").agg(F.min("ord").alias("ord"))
        past_h = old_h.select(F.col("key").alias("hkey")).distinct()
        past_d = old_d.select(F.col("key").alias("dkey")).distinct()
        past_n = near.join(past_d.withColumnRenamed("dkey", "b"), "b", "left_semi").select(F.col("a").alias("dkey")).distinct()
        fresh = nodes.join(past_h, "hkey", "left_anti").join(past_d.unionByName(past_n).distinct(), "dkey", "left_anti")
        # sessions about which nothing is known are all accepted
        silent = rows.where("hkey is null and dkey is null").select("hkey", "dkey", "ord")
        fresh = fresh.where("hkey is not null or dkey is not null")
        taken = stage(_accept(fresh, near).unionByName(silent), "taken").withColumn("id", F.col("ord.id"))

        repeats = stage(rows.join(taken.select("id"), "id", "left_anti").select("id", "ord", "hkey", "dkey"), "repeats")
        kept = lambda old, key: old.unionByName(taken.where(f"{key} is not null").select(F.col(key).alias("key"), "id", "ord")).select("key", F.col("id").alias("kept_id"), F.col("ord").alias("kept_ord"))
        mine = lambda key: repeats.where(f"{key} is not null").select(F.col(key).alias("key"), "id", "ord")
        links = near.join(repeats.select(F.col("dkey").alias("a")).where("a is not null").distinct(), "a", "left_semi")
        linked = repeats.select(F.col("dkey").alias("a"), "id", "ord").join(links, "a").select(F.col("b").alias("key"), "id", "ord")
        # of a key with many accepted sessions every repeat names all of them, so such keys are split
        out = join_split(mine("hkey"), kept(old_h, "hkey"), ["key"]).unionByName(join_split(mine("dkey").unionByName(linked), kept(old_d, "dkey"), ["key"]))
        out = stage(out.where(F.col("kept_ord") < F.col("ord")).select(F.col("id").alias("repeat_id"), "kept_id").distinct(), "pairs")
        new_sets = sets.join(taken.where("dkey is not null").select("dkey").distinct(), "dkey", "left_semi").join(past_d, "dkey", "left_anti")
        self._append(self._tables(taken, stage(new_sets, "sets")))
        return out


def repeats_of_accepted(uploads: DataFrame, history_batch: int = 0) -> DataFrame:
    """(upload_id_1, upload_id_2), smaller id first: each repeat with every accepted session it repeats. Batches up to
    `history_batch` are accepted as they stand; a null batch_no counts as history."""
    need = uploads.select("id", "batch_no", "created_at", "access_scope", "file_size", "content_sha256", "chunk_digests")
    past = F.coalesce(F.col("batch_no") <= history_batch, F.lit(True))
    pairs = UploadHistory.create(need.where(past)).feed(need.where(~past))
    return pairs.select(F.least("repeat_id", "kept_id").alias("upload_id_1"), F.greatest("repeat_id", "kept_id").alias("upload_id_2"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole under another name first; an existing one is an error, so that two writers can't both commit."""
    fs, p = _fs(spark, path)
    _, temp = _fs(spark, path + ".new")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(temp, p):
        raise FileExistsError(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().endswith(".new")] if fs.exists(p) else []
