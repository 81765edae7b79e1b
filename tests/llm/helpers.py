"""Rows that every operator on texts must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = "word " * 30_000 + "end."

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "s", 1),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (None, "a row without an id, licensed under the Apache License, Version 2.0.", "en", None, 1),
    (5, LONG, "en", "s", 1),
    (6, "một hai ba bốn năm sáu", "vi", "s", 1),
    (6, "một hai ba bốn năm sáu", "vi", "s", 1),
    (7, "Ünïcödé ﬁ Σίσυφος 日本 <|endoftext|> x", "xx", "s", 1),
    (6, "another text under the same id", "en", "s", 1),
]

#: Names that operators use inside, as extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").sortWithinPartitions("doc_id", "text")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/docs-{abs(hash(str(rows)[:5000]))}"
    extra = {c: F.lit("clash") for c in ("sha256", "row_key", "kept", "label", "head", "bucket", "n", "score", "length", "part", "rank", "ids", "tie", "row", "a", "b", "of", "q")}
    df.withColumns(extra).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return docs(spark, [])
