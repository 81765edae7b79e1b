"""Evaluation sets: one JSON object a line; blank lines and // comments are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """question STRING, expected_answer STRING, expected_document STRING,
 expected_location STRUCT<page: INT, sheet_name: STRING, cell_range: STRING, section: STRING>,
 expected_block_ids ARRAY<STRING>, content_type STRING, category STRING, no_answer BOOLEAN, _bad STRING"""


def read_lines(lines: DataFrame) -> DataFrame:
    """lines: value. Items; a line that is no JSON or lacks a question raises with its text."""
    item = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    items = lines.withColumn("value", F.trim("value")).where("value <> '' and value not like '//%'").select("value", item.alias("i"))
    bad = F.col("i").isNull() | F.col("i._bad").isNotNull() | F.col("i.question").isNull()
    return items.select(F.when(bad, F.raise_error(F.concat(F.lit("no item with a question: "), "value"))).otherwise(F.col("i")).alias("i")).select("i.*").drop("_bad")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark.read.text(path))
