"""Hybrid retrieval for batches of questions: rankings, reciprocal-rank fusion,
late lookup, reranking, filters and entity boosts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fields that filters may name.
FILTER_FIELDS = ["document_id", "chunk_type", "source_file", "sheet_name", "entities"]
RRF_K = 60


def filter_chunks(chunks: DataFrame, filters: dict[str, str | list[str]]) -> DataFrame:
    """Chunks that meet all filters; empty values are ignored, unknown fields raise.
    An array field meets a filter with any of its values. Plain conditions, so
    they reach the Parquet scan."""
    for field, value in (filters or {}).items():
        if field not in FILTER_FIELDS and field not in chunks.columns:
            raise ValueError(f"unknown filter field {field}")
        if value in (None, "", []):
            continue
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        is_array = chunks.schema[field].dataType.typeName() == "array"
        chunks = chunks.where(F.arrays_overlap(F.col(field), F.array(*map(F.lit, values))) if is_array else F.col(field).isin(values))
    return chunks


def variants(query: Column, others: Column) -> Column:
    """The original question first, then other non-empty ones, each once."""
    return F.array_distinct(F.concat(F.array(query), F.filter(others, lambda v: v != "")))


def fuse(rankings: DataFrame, k: int = 24, rrf_k: int = RRF_K) -> DataFrame:
    """rankings: query_id, kind (dense or sparse), chunk_id, rank. Sum of
    1 / (rrf_k + rank), the best rank of each kind, and the place in the fused order."""
    fused = rankings.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf_score"),
        F.min(F.when(F.col("kind") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("kind") == "sparse", F.col("rank"))).alias("sparse_rank"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= k)


def look_up(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused ids to chunks; ids without a chunk drop out."""
    return fused.join(chunks, "chunk_id")


def token_overlap(query: str, text: str) -> float:
    """Stand-in for a cross-encoder: share of the query's words that the text has."""
    words = set(query.lower().split())
    return len(words & set(text.lower().split())) / len(words) if words else 0.0


def rerank(hits: DataFrame, score: Callable[[str, str], float] | None = token_overlap, top: int = 7) -> DataFrame:
    """hits: query_id, query, content, rrf_score. The ``top`` best by score, then fusion, then chunk_id. Without a scorer: by fusion."""
    if score is None:
        scored = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    elif score is token_overlap:  # the stand-in has a form in the JVM
        words = lambda c: F.array_distinct(F.filter(F.split(T.collapse(F.lower(F.coalesce(c, F.lit("")))), " "), lambda w: w != ""))
        asked = words("query")
        scored = hits.withColumn("rerank_score", F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words("content"))) / F.size(asked)).otherwise(0.0))
    else:

        @F.pandas_udf("double")
        def run(query: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series([float(score(q or "", t or "")) for q, t in zip(query, text, strict=True)])

        scored = hits.withColumn("rerank_score", run("query", "content"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc(F.round("rrf_score", 12)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def match_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, document_id, canonical, norm_key) of entities named in a query.
    The runs of words of a query, as long as keys are, meet the keys by a hash join
    (a test for containment would compare every query with every key)."""
    lengths = sorted(r["n"] for r in entities.where("norm_key is not null").select(F.size(F.split("norm_key", " ")).alias("n")).distinct().collect())
    words = F.split(T.normalize_key("query"), " ")
    runs = F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.size(words)), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    q = queries.where(F.length(T.normalize_key("query")) >= 3).select("query_id", F.explode(F.array_distinct(runs)).alias("norm_key"))
    return q.join(entities.select("document_id", "canonical", "norm_key"), "norm_key").select("query_id", "document_id", "canonical", "norm_key").distinct()


def confidence(hits: DataFrame, min_rerank: float = 0.05, min_rrf: float = 0.0, reranked: bool = True, enabled: bool = True) -> DataFrame:
    """hits with queries that may have none (left-joined): query_id, ok, reason."""
    best = hits.groupBy("query_id").agg(F.count("chunk_id").alias("n"), F.max("rerank_score").alias("rerank"), F.max("rrf_score").alias("rrf"))
    reason = F.when(F.col("n") == 0, "no_hits")
    if not enabled:
        reason = reason.otherwise("disabled")
    else:
        if reranked:
            reason = reason.when(F.col("rerank") < min_rerank, F.concat(F.lit("low_rerank_score:"), F.format_string("%.3f", "rerank")))
        reason = reason.when(F.col("rrf") < min_rrf, F.concat(F.lit("low_rrf_score:"), F.format_string("%.4f", "rrf"))).otherwise("ok")
    return best.withColumn("reason", reason).select("query_id", F.col("reason").isin("ok", "disabled").alias("ok"), "reason")


#: Words of a question that allow a filter on a chunk type.
TYPE_HINTS = {
    "table": ("bảng", "table"),
    "chart": ("biểu đồ", "chart", "đồ thị"),
    "flowchart": ("sơ đồ", "lưu đồ", "flowchart"),
    "image": ("hình", "ảnh", "image"),
    "kpi": ("kpi", "chỉ tiêu"),
}


def sanitize_plan(plans: DataFrame, max_queries: int = 2) -> DataFrame:
    """plans: query_id, query, semantic_queries, keyword_query, source_file,
    sheet_name, content_type, known_files, known_sheets. Rewrites must keep every
    number of the question; filters must be known and named in it."""
    numbers = F.regexp_extract_all("query", F.lit("([0-9][0-9.,/-]*)"), F.lit(1))
    texts = F.transform(F.coalesce("semantic_queries", F.array().cast("array<string>")), T.strip)
    kept = F.filter(texts, lambda t: (t != "") & (t != F.col("query")) & F.forall(numbers, lambda n: F.contains(t, n)))
    low = F.lower("query")
    named = lambda c: F.contains(low, F.lower(c))
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    hinted = F.lit(False)
    for kind, words in TYPE_HINTS.items():
        hinted = hinted | ((F.col("content_type") == kind) & low.rlike("|".join(words)))
    when = lambda ok, c: F.when(F.coalesce(ok, F.lit(False)), F.col(c))
    return plans.select(
        "query_id", "query", F.slice(kept, 1, max_queries).alias("semantic_queries"), F.nullif(T.strip("keyword_query"), F.lit("")).alias("keyword_query"),
        when(F.array_contains("known_files", F.col("source_file")) & (named("source_file") | named(stem)), "source_file").alias("source_file"),
        when(F.array_contains("known_sheets", F.col("sheet_name")) & named("sheet_name"), "sheet_name").alias("sheet_name"), when(hinted, "content_type").alias("chunk_type"),
    )
