"""Queries of evaluation and operation figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import bm25, evaluation
from docloom.plans.queries_search import _TOKENS, _index, _questions
from docloom.plans.queries_text import read, values_sql
from docloom.plans.registry import query

_RANKED = """h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0),
m AS (SELECT b.item_id AS query_id, CASE WHEN b.item_id % 2 = 0 THEN 'text' ELSE 'table' END AS content_type, min(CASE WHEN contains(d.text, b.text) THEN h.rank END) AS first
  FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id AND h.rank <= 10 LEFT JOIN documents d USING (doc_id) GROUP BY ALL)"""


def _results(spark, sf_dir):
    """Hits of each benchmark passage; a document that holds the passage is a match."""
    q = _questions(spark, sf_dir)
    hits = bm25.search(_index(spark, sf_dir), q, 10).select("query_id", "chunk_id", "rank").join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    r = q.join(hits, "query_id", "left").withColumn("matched", F.coalesce(F.contains("text", F.col("query")), F.lit(False)))
    return r.withColumn("content_type", F.when(F.col("query_id") % 2 == 0, "text").otherwise("table"))


@query(
    "recall_mrr",
    f"""WITH {_TOKENS}, {_RANKED} SELECT count(*) AS evaluated, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM m""",
)
def recall_mrr(spark, sf_dir):
    return evaluation.retrieval_metrics(_results(spark, sf_dir))


@query("hit_rate_by_type", f"WITH {_TOKENS}, {_RANKED} SELECT content_type, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate FROM m GROUP BY content_type")
def hit_rate_by_type(spark, sf_dir):
    return evaluation.hit_rate_by_type(_results(spark, sf_dir))


def _answers(spark, sf_dir):
    """Labels as graded answers: quality as correctness, toxic ones as questions that expect none."""
    return read(spark, sf_dir, "labels").select(
        (F.col("toxic") == 1).alias("expects_no_answer"), F.when(F.col("doc_id") % 3 == 0, "499.000").otherwise("text").alias("expected_answer"), (F.col("quality") == 1).alias("correct"),
        F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 2 == 0).alias("citation_correct"), (F.col("doc_id") % 4 > 0).alias("citation_valid"), (F.col("doc_id") % 7 == 0).cast("int").alias("unsupported"),
        (F.col("doc_id") % 6 == 0).alias("refused"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("category"),
    )


@query(
    "answer_rates",
    """SELECT count(*) AS answered, round(avg(CASE WHEN toxic = 0 THEN CAST(quality = 1 AS INT) END), 4) AS correctness,
  round(avg(CASE WHEN toxic = 0 AND doc_id % 3 = 0 THEN CAST(quality = 1 AS INT) END), 4) AS numeric_exact_match, round(avg(CASE WHEN toxic = 0 THEN CAST(doc_id % 7 <> 0 AND doc_id % 4 > 0 AS INT) END), 4) AS faithfulness_proxy,
  round(avg(CASE WHEN toxic = 0 AND doc_id % 5 > 0 THEN CAST(doc_id % 2 = 0 AS INT) END), 4) AS citation_accuracy, round(avg(CASE WHEN toxic = 1 THEN CAST(doc_id % 6 = 0 AS INT) END), 4) AS refusal_accuracy,
  round(avg(CASE WHEN toxic = 0 THEN CAST(doc_id % 6 = 0 AS INT) END), 4) AS false_refusal_rate FROM labels""",
)
def answer_rates(spark, sf_dir):
    return evaluation.answer_metrics(_answers(spark, sf_dir))


@query("by_category", "SELECT 'c' || (doc_id % 3) AS category, count(*) AS count, round(avg(CASE WHEN toxic = 1 THEN CAST(doc_id % 6 = 0 AS INT) ELSE CAST(quality = 1 AS INT) END), 4) AS correct FROM labels GROUP BY ALL")
def by_category(spark, sf_dir):
    return evaluation.by_category(_answers(spark, sf_dir))


@query("latency_p50", "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 1) AS p50, round(max(value), 1) AS max FROM events GROUP BY event_type")
def latency_p50(spark, sf_dir):
    return evaluation.latency(read(spark, sf_dir, "events"), "event_type", "value")


def _statuses(spark, sf_dir):
    """Events as a status log."""
    stage = F.when(F.col("event_type").isin("click", "view"), "parse").when(F.col("event_type") == "purchase", "index").otherwise("ocr")
    status = F.when(F.col("event_id") % 10 == 0, "failed").when(F.col("event_id") % 10 == 1, "skipped").when(F.col("event_id") % 10 == 2, "partial").otherwise("success")
    return read(spark, sf_dir, "events").select(stage.alias("stage"), status.alias("status"), F.col("value").alias("duration_ms"))


_STATUS = """s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'parse' WHEN event_type = 'purchase' THEN 'index' ELSE 'ocr' END AS stage,
  CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'partial' ELSE 'success' END AS status, value FROM events)"""


@query("status_counts", f"WITH {_STATUS} SELECT stage || ':' || status AS stage_status, count(*) AS count FROM s GROUP BY ALL")
def status_counts(spark, sf_dir):
    return evaluation.status_counts(_statuses(spark, sf_dir))


@query(
    "operational_metrics",
    f"""WITH {_STATUS} SELECT round(avg(CASE WHEN stage = 'parse' AND status <> 'skipped' THEN CAST(status IN ('success', 'partial') AS INT) END), 4) AS parse_success_rate,
  count(*) FILTER (stage = 'ocr') AS ocr_vlm_issue_count, round(1000.0::DOUBLE / (sum(value) FILTER (stage = 'index' AND status = 'success') / 1000), 2) AS indexing_chunks_per_second FROM s""",
)
def operational_metrics(spark, sf_dir):
    return evaluation.operational(_statuses(spark, sf_dir), 1000)


#: id, expected blocks, document, location (page, sheet, range, section), then the chunk: blocks, file, pages, sheet, range, path; whether it matches
HITS = [
    (0, ["b1"], None, None, ["b1", "b2"], "f", 1, 1, None, None, [], True), (1, ["b9"], "f", (1, None, None, None), ["b1"], "f", 1, 1, None, None, [], False),
    (2, [], "Phi.PDF", (12, None, None, None), ["b"], "phi.pdf", 12, 12, None, None, [], True), (3, [], "phi.pdf", (13, None, None, None), ["b"], "phi.pdf", 12, 12, None, None, [], False),
    (4, [], None, (None, "doanh thu", "B2:B3", None), ["b"], "x", None, None, "Doanh Thu", "A1:C5", [], True), (5, [], None, (None, None, None, "phí > thẻ"), ["b"], "x", None, None, None, None, ["Phí", "Thẻ vàng"], True),
    (6, [], None, None, ["b"], "x", 1, 1, None, None, [], False),
]


@query("hit_matches", values_sql([(h[0], h[-1]) for h in HITS], ["id", "matched"]))
def hit_matches(spark, sf_dir):
    schema = "id long, expected_block_ids array<string>, expected_document string, expected_location struct<page:int,sheet_name:string,cell_range:string,section:string>, block_ids array<string>, source_file string, page_start int, page_end int, sheet_name string, cell_range string, section_path array<string>"
    return spark.createDataFrame([h[:-1] for h in HITS], schema).select("id", evaluation.hit_matches().alias("matched"))


ANSWERS = [(0, "Phí là 499000 đồng", "499.000 VND", True), (1, "Không rõ", "499.000", False), (2, "Thủ đô là HÀ  NỘI.", "hà nội", True), (3, "x", "", False)]


@query("answer_correct", values_sql([(a[0], a[-1]) for a in ANSWERS], ["id", "correct"]))
def answer_correct(spark, sf_dir):
    df = spark.createDataFrame([a[:-1] for a in ANSWERS], "id long, answer string, expected string")
    return df.select("id", evaluation.answer_correct("answer", "expected").alias("correct"))


@query("no_answer_items", "SELECT doc_id, toxic = 1 OR doc_id % 4 = 0 OR doc_id % 5 = 0 AS none FROM labels")
def no_answer_items(spark, sf_dir):
    items = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, True).alias("no_answer"), F.when(F.col("doc_id") % 4 > 0, "x").alias("expected_answer"), F.when(F.col("doc_id") % 5 == 0, "no_answer").alias("category"))
    return items.select("doc_id", evaluation.expects_no_answer().alias("none"))
