"""Readers and writers of the text formats beside parquet: a dictionary in layers of JSON files, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.operators.scale import _names

LAYER = "map<string,map<string,string>>"


def object_or_error(text: Column) -> Column:
    """The JSON object of a text; an error for what is none."""
    v = F.try_parse_json(text)
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring(text, 1, 80))))


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, field, en, zh): the terms of all JSON files of a folder, {layer: ..., fields: {field: {en: zh}}}; the layer is named in
    the file. Fields that begin with an underscore are metadata. A missing folder gives no terms; a file that holds no JSON
    object is an error. A dictionary's file is one object and so one row; files spread over tasks."""
    if not _names(spark, folder):
        return spark.createDataFrame([], "layer string, field string, en string, zh string")
    raw = spark.read.text(folder, wholetext=True).select(object_or_error(F.col("value")).alias("j"))
    raw = raw.select(F.from_json("j", f"layer string, fields {LAYER}").alias("j"))
    terms = raw.select("j.layer", F.explode("j.fields").alias("field", "terms")).where("not startswith(field, '_')")
    return terms.select("layer", "field", F.explode("terms").alias("en", "zh"))


def write_layers(terms: DataFrame, folder: str) -> None:
    """terms (layer, field, en, zh), unique in layer, field and en: one indented JSON object a layer, with its letters as they are."""
    fields = terms.groupBy("layer", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("en", "zh")))).alias("terms"))
    whole = fields.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("field", "terms"))).alias("fields"))
    whole.repartition("layer").select(F.to_json(F.struct("layer", "fields"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def json_lines(lines: DataFrame, line: str, *fields: str) -> DataFrame:
    """`lines` with the string values of `fields` of the JSON object in column `line`; rows whose line is malformed or holds
    something other than an object are dropped."""
    v = lines.withColumn("_v", F.try_parse_json(line)).where(F.schema_of_variant("_v").startswith("OBJECT"))
    return v.select(*lines.columns, *(F.try_variant_get("_v", f"$.{f}", "string").alias(f"{f}") for f in fields)).drop(line)


def append_new_lines(new: DataFrame, folder: str, key: str) -> int:
    """Appends the rows of `new` whose `key` no line of the folder has yet, as JSON lines; the number of rows. Malformed lines
    that lie there already are passed over."""
    spark = new.sparkSession
    new = new.where(f"{key} is not null").dropDuplicates([key])
    if _names(spark, folder):
        old = json_lines(spark.read.text(folder), "value", key).select(key).where(f"{key} is not null").distinct()
        new = new.join(old, key, "left_anti")
    from inkwright.operators.scale import stage

    new = stage(new, "lines")
    new.write.mode("append").json(folder)
    return new.count()
