"""What keeps plans sound on a cluster: cut lineage, bounded broadcasts, joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast, in bytes.
BYTES = 64 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a
    cluster gets an error, since its executors would write to folders of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="inkwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


@atexit.register
def release() -> None:
    """Deletes the tables that `stage` wrote."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `release` removes it."""
    path = f"{shared_dir(spark)}/inkwright/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, size: int = BYTES) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows and its values at most `size` bytes as text (counted on the
    executors, not guessed); else unmarked, so that the join shuffles."""
    text = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0)) if df.columns else F.lit(0)
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, share: int = 200) -> DataFrame:
    """Inner join of `rows` with `groups` (unique in `keys`; column `n`: its count of rows) where a few keys may hold
    much of all rows. Keys with more than total/share rows, of which there are fewer than `share`, are broadcast and their
    rows stay where they are; the others shuffle. Nothing is dropped."""
    hot = groups.where(F.col(n) * share > F.lit(total))
    cold = groups.where(F.col(n) * share <= F.lit(total))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def join_split(a: DataFrame, b: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """Inner join in which no task gets all rows of a key: the rows of `b` of a key with more than `most` of them are dealt out
    to parts, and the rows of `a` go to each part. Every pair comes out once; keys of `b` beyond `most` are few (rows / most)."""
    hot = b.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = small(stage(hot, "hot"), 1_000_000)
    parts = F.coalesce("_parts", F.lit(1))
    a = a.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    b = b.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in b.columns if c not in keys] or keys), parts).cast("int")).drop("_parts")
    return a.join(b, [*keys, "_part"]).drop("_part")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_case(c: Column) -> Column:
    """Letters alike for any case, with forms such as the micro sign and final sigma joined to their letter."""
    # lower(upper(c)) alone would be simplified to lower(c)
    return F.translate(F.lower(F.translate(F.upper(c), "\x00", "")), "ς", "σ")


def letters_digits(c: Column) -> Column:
    """Only letters and digits, without case."""
    return F.regexp_replace(fold_case(c), r"[^\p{L}\p{N}]+", "")
