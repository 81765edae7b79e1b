"""Reads of a corpus by key: points, lists in the caller's order, distinct values,
JSON fields, latest rows, counts, and the short forms that are shown of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with that key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def in_order(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df for each entry of ids.ids (an array), with its place as pos, in that
    order; repeated entries give repeated rows, missing ones drop out."""
    wanted = ids.select(F.posexplode("ids").alias("pos", key))
    return wanted.join(df, key).orderBy("pos")


def distinct_values(df: DataFrame, field: str | Column) -> DataFrame:
    """The filled values of a column or expression, in order, as ``value``."""
    value = (F.col(field) if isinstance(field, str) else field).alias("value")
    return df.select(value).where("value is not null and cast(value as string) <> ''").distinct().orderBy("value")


def json_is(column: str, path: str, value) -> Column:
    """Whether a field of a JSON column has a value, compared as the value's own type."""
    kind = {bool: "boolean", int: "long", float: "double"}.get(type(value), "string")
    return F.get_json_object(column, path).cast(kind) == F.lit(value)


def latest(df: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` last rows by time, then key; top-k per task before the merge."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """name and n of several tables, in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def map_parts(path: Column | str, names: Mapping[str, str]) -> Column:
    """A path whose parts are replaced by a dictionary; others stay."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(path, lambda p: F.coalesce(known[p], p))


def corrected_headings(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """blocks with the parts of their section paths replaced by corrected headings.
    corrections: document_id, heading, corrected (the last in order of corrected
    where one heading has several). Paths are exploded and joined, so that a
    document may have any number of headings."""
    fixed = corrections.groupBy("document_id", F.col("heading").alias("part")).agg(F.max("corrected").alias("corrected"))
    parts = blocks.select("document_id", "block_id", F.posexplode("section_path").alias("pos", "part")).join(fixed, ["document_id", "part"], "left")
    part = F.struct("pos", F.coalesce("corrected", "part").alias("part"))
    paths = parts.groupBy("document_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]).alias("fixed_path"))
    joined = blocks.join(paths, ["document_id", "block_id"], "left")
    return joined.withColumn("section_path", F.coalesce("fixed_path", "section_path")).drop("fixed_path").select(*blocks.columns)


def documents_by_source(documents: DataFrame, source_file: str) -> DataFrame:
    """All versions of one input file, oldest stored name first."""
    return documents.where((F.col("original_name") == source_file) | (F.col("source_file") == source_file)).orderBy("source_file", "document_id")


PREVIEW = 500


def hit_rows(hits: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """What is shown of a hit: its place, scores and the beginning of its content."""
    rounded = [F.round(c, 6).alias(c) for c in ("rerank_score", "rrf_score") if c in hits.columns]
    kept = [c for c in ("query_id", "rank", "chunk_id", "document_id", "source_file", "chunk_type", "section_path", "page_start", "page_end", "sheet_name", "cell_range", "dense_rank", "sparse_rank") if c in hits.columns]
    return hits.select(*kept, *rounded, F.substring("content", 1, preview).alias("preview"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """document_id and a struct of what a profile says of a document at a glance."""
    wanted = [c for c in ("title", "doc_number", "issue_date", "issuer", "signers") if c in profiles.columns]
    return profiles.select("document_id", F.struct(*wanted).alias("summary"))


def artifact_ref(path: Column | str, root: str) -> Column:
    """A path below the corpus folder as one that moves with it; others stay."""
    c = F.col(path) if isinstance(path, str) else path
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(c, F.lit(base)), F.substring(c, len(base) + 1, 1 << 30)).otherwise(c)


def resolve_ref(ref: Column | str, root: str) -> Column:
    """The other way: a relative path below the corpus folder; absolute ones stay."""
    c = F.col(ref) if isinstance(ref, str) else ref
    return F.when(c.rlike(r"^(?:/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
