"""Quality of retrieval and answers, and operational figures, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def expects_no_answer() -> Column:
    """Of an item with no_answer, expected_answer and category."""
    return F.coalesce("no_answer", F.lit(False)) | F.coalesce(F.col("expected_answer") == "", F.lit(True)) | F.coalesce(F.col("category") == "no_answer", F.lit(False))


def hit_matches() -> Column:
    """Whether a hit's chunk is evidence for an item, both in one row. Expected
    blocks decide where there are any; else document, page, sheet, range and
    section must fit as far as they are given, at least one of them."""
    item, norm = F.col("expected_location"), T.normalize_for_match
    page, sheet, area, section = item["page"], item["sheet_name"], item["cell_range"], item["section"]
    expected, actual = T.parse_cell_range(area), T.parse_cell_range("cell_range")
    document = F.nullif(F.col("expected_document"), F.lit(""))
    fits = (
        (document.isNull() | (norm(document) == norm("source_file")))
        & (page.isNull() | page.between(F.col("page_start"), F.coalesce("page_end", "page_start")))
        & (sheet.isNull() | (norm(sheet) == norm(F.coalesce("sheet_name", F.lit("")))))
        & (area.isNull() | T.ranges_overlap(expected, actual))
        & (section.isNull() | F.contains(norm(F.array_join("section_path", " > ")), norm(section)))
    )
    given = document.isNotNull() | page.isNotNull() | sheet.isNotNull() | area.isNotNull() | section.isNotNull()
    by_blocks = F.size("expected_block_ids") > 0
    return F.coalesce(F.when(by_blocks, F.arrays_overlap("expected_block_ids", "block_ids")).otherwise(fits & given), F.lit(False))


def first_matches(results: DataFrame) -> DataFrame:
    """results: query_id, content_type, rank (from 1, null without hits), matched. The rank of each query's first match."""
    return results.groupBy("query_id", F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.min(F.when(F.col("matched"), F.col("rank"))).alias("first"))


def retrieval_metrics(results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: evaluated, recall_at_k for each k, mrr."""
    recall = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_at_{k}") for k in ks]
    return first_matches(results).agg(F.count(F.lit(1)).alias("evaluated"), *recall, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def hit_rate_by_type(results: DataFrame, k: int = 10) -> DataFrame:
    return first_matches(results).groupBy("content_type").agg(F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias("hit_rate"))


def block_coverage(results: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of expected blocks among the first k hits' blocks. results: query_id, rank, block_ids, expected_block_ids."""
    found = results.where(F.size("expected_block_ids") > 0).groupBy("query_id", "expected_block_ids").agg(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("block_ids")))).alias("found"))
    share = F.size(F.array_intersect("expected_block_ids", "found")) / F.size(F.array_distinct("expected_block_ids"))
    return found.agg(F.round(F.avg(share), 4).alias("block_coverage"))


def answer_correct(answer: Column | str, expected: Column | str) -> Column:
    """The expected text stands in the answer, or all of its numbers do."""
    answer, expected = (F.col(c) if isinstance(c, str) else c for c in (answer, expected))
    rounded = lambda c: F.transform(T.extract_numbers(c), lambda x: F.round(x, 6))
    numbers = rounded(expected)
    by_number = (F.size(numbers) > 0) & (F.size(F.array_except(numbers, rounded(answer))) == 0)
    ok = F.contains(T.normalize_for_match(F.coalesce(answer, F.lit(""))), T.normalize_for_match(expected)) | by_number
    return F.when(F.coalesce(expected, F.lit("")) == "", False).otherwise(ok)


def citation_correct(citations: Column, document: Column, page: Column, sheet: Column) -> Column:
    """Null without an expected document."""
    norm = T.normalize_for_match
    number = page.cast("string")

    def fits(c: Column) -> Column:
        t = norm(c)
        on_page = F.contains(t, F.concat(F.lit("trang "), number)) | F.contains(t, F.concat(F.lit("-"), number))
        return F.contains(t, norm(document)) & (page.isNull() | on_page) & (sheet.isNull() | F.contains(t, norm(sheet)))

    return F.when(F.coalesce(document, F.lit("")) != "", F.exists(citations, fits))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """One row of rates, null where nothing counts. rows: expects_no_answer,
    expected_answer, correct, citation_correct, citation_valid, unsupported (count), refused."""
    wants, none = ~F.col("expects_no_answer"), F.col("expects_no_answer")
    rate = lambda when, c, name: F.round(F.avg(F.when(when, c.cast("double"))), 4).alias(name)
    numeric = wants & (F.size(T.extract_numbers(F.coalesce("expected_answer", F.lit("")))) > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("answered"), rate(wants, F.col("correct"), "correctness"), rate(numeric, F.col("correct"), "numeric_exact_match"),
        rate(wants, (F.col("unsupported") == 0) & F.col("citation_valid"), "faithfulness_proxy"), rate(wants & F.col("citation_correct").isNotNull(), F.col("citation_correct"), "citation_accuracy"),
        rate(none, F.col("refused"), "refusal_accuracy"), rate(wants, F.col("refused"), "false_refusal_rate"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    good = F.when(F.col("expects_no_answer"), F.col("refused")).otherwise(F.col("correct"))
    return rows.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(good.cast("double")), 4).alias("correct"))


def latency(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Exact median and maximum by stage."""
    return df.groupBy(F.col(stage).alias("stage")).agg(F.round(F.percentile(value, F.lit(0.5)), 1).alias("p50"), F.round(F.max(value), 1).alias("max"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy(F.concat_ws(":", "stage", "status").alias("stage_status")).agg(F.count(F.lit(1)).alias("count"))


def operational(statuses: DataFrame, chunks: int) -> DataFrame:
    """One row: parse_success_rate (skipped ones aside), ocr_vlm_issue_count, indexing_chunks_per_second."""
    parsed = (F.col("stage") == "parse") & (F.col("status") != "skipped")
    seconds = F.sum(F.when((F.col("stage") == "index") & (F.col("status") == "success"), F.col("duration_ms"))) / 1000
    return statuses.agg(
        F.round(F.avg(F.when(parsed, F.col("status").isin("success", "partial").cast("double"))), 4).alias("parse_success_rate"),
        F.count(F.when(F.col("stage").isin("ocr", "vlm"), 1)).alias("ocr_vlm_issue_count"),
        F.round(F.when(seconds > 0, F.lit(float(chunks)) / seconds), 2).alias("indexing_chunks_per_second"),
    )
