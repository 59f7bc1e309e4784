"""Readers of the parquet tables, and the session used by tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of a data folder; with `columns`, only those."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; a table may be one file or a folder of them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    read = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "inkwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("INKWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
