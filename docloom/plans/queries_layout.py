"""Queries of page layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.plans.queries_text import read, values_sql
from docloom.plans.registry import query


@query(
    "outside_tables",
    """WITH b AS (SELECT l_partkey AS document_id, l_linenumber AS page, l_quantity AS x0, l_quantity + 4 AS x1, l_discount * 100 AS y0, l_discount * 100 + 2 AS y1, l_orderkey, l_returnflag FROM lineitem)
SELECT a.l_orderkey, a.page FROM b a WHERE a.l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.l_returnflag = 'R' AND t.document_id = a.document_id AND t.page = a.page
  AND (a.x0 + a.x1) / 2 BETWEEN t.x0 - 2 AND t.x1 + 2 AND (a.y0 + a.y1) / 2 BETWEEN t.y0 - 2 AND t.y1 + 2)""",
)
def outside_tables(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").selectExpr("l_partkey as document_id", "l_linenumber as page", "l_quantity as x0", "l_quantity + 4 as x1", "l_discount * 100 as y0", "l_discount * 100 + 2 as y1", "l_orderkey", "l_returnflag")
    return layout.outside_tables(b.where("l_returnflag = 'N'"), b.where("l_returnflag = 'R'")).select("l_orderkey", "page")


@query(
    "font_profile",
    """WITH s AS (SELECT c_nationkey AS document_id, round(8 + c_custkey % 9, 1) AS size, sum(length(c_name)) AS n FROM customer GROUP BY ALL),
b AS (SELECT document_id, arg_max(size, n * 1000 - size) AS body FROM s GROUP BY ALL)
SELECT s.document_id, CAST(body AS DOUBLE) AS body, count(*) FILTER (size >= body * 1.15) AS larger FROM s JOIN b USING (document_id) GROUP BY ALL""",
)
def font_profile(spark, sf_dir):
    spans = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document_id"), (F.lit(8.0) + F.col("c_custkey") % 9).alias("size"), F.col("c_name").alias("text"))
    return layout.font_profile(spans, most=100).select("document_id", "body", F.size("headings").cast("long").alias("larger"))


LINES = [("Chương I", 18.0, 0.0, 1), ("Mục 1", 14.0, 0.0, 2), ("2.1. Phạm vi", 11.0, 0.9, 4), ("Phạm vi", 11.0, 0.9, 3), ("Câu thường.", 18.0, 0.0, None), ("12/3", 18.0, 0.0, None), ("chữ thường", 11.0, 0.1, None)]


@query("heading_levels", values_sql([(i, x[-1]) for i, x in enumerate(LINES)], ["i", "level"]))
def heading_levels(spark, sf_dir):
    df = spark.createDataFrame([(i, *x[:-1]) for i, x in enumerate(LINES)], "i long, t string, size double, bold double")
    return df.select("i", layout.heading_level(F.col("t"), F.col("size"), F.col("bold"), F.lit(11.0), F.array(F.lit(18.0), F.lit(14.0))).cast("long").alias("level"))


@query("page_order", values_sql([("t0", 0), ("tab", 1), ("t1", 2), ("img", 3)], ["id", "reading_order"]))
def page_order(spark, sf_dir):
    rows = [("t0", "text", 0, 10.0), ("t1", "text", 1, 50.0), ("tab", "table", 0, 30.0), ("img", "image", 1, 90.0)]
    df = spark.createDataFrame([("d", 1, *r) for r in rows], "document_id string, page int, id string, kind string, n int, y0 double")
    return layout.page_order(df).select("id", F.col("reading_order").cast("long").alias("reading_order"))


@query("range_values", "SELECT '''nation''!$B$2:$C$3' AS ref, 'r' || 2 || 'c' || 2 || ',r2c3,r3c2,r3c3' AS joined")
def range_values(spark, sf_dir):
    cells = spark.range(1, 6).withColumnRenamed("id", "row").crossJoin(spark.range(1, 5).withColumnRenamed("id", "col")).selectExpr("'Nation' as sheet", "row", "col", "concat('r', row, 'c', col) as value")
    refs = spark.createDataFrame([("'nation'!$B$2:$C$3",), ("'other'!A1",)], "ref string")
    return layout.range_values(cells, refs).select("ref", F.array_join("values", ",").alias("joined"))


IMAGES = [("Biểu đồ 1", "", [], "chart"), ("", "", ["Chart_area"], "chart"), ("Sơ đồ duyệt", "", [], "flowchart"), ("", "a -> b → c", [], "flowchart"), ("", "Bắt đầu\nx", [], "flowchart"), ("Hình 1", "text", [], "image")]


@query("image_kinds", values_sql([(i, x[-1]) for i, x in enumerate(IMAGES)], ["i", "kind"]))
def image_kinds(spark, sf_dir):
    df = spark.createDataFrame([(i, *x[:-1]) for i, x in enumerate(IMAGES)], "i long, c string, t string, l array<string>")
    return df.select("i", layout.classify_image(F.col("c"), F.col("t"), F.col("l")).alias("kind"))


@query("large_images", "SELECT p_partkey FROM part WHERE p_size * 10 >= 220 AND p_retailprice / 8 >= 120")
def large_images(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).alias("width"), (F.col("p_retailprice") / 8).alias("height"))
    return layout.large_images(p).select("p_partkey")


@query("layout_blocks", values_sql([(0, "text", "Xin chào", 0.9), (1, "table", "<table/>", None)], ["pos", "label", "content", "confidence"]))
def layout_blocks(spark, sf_dir):
    raw = '{"res": {"parsing_res_list": [{"block_label": "TEXT", "block_content": " Xin chào ", "block_bbox": [0, 1, 2, 3], "score": 0.9}, {"x": [{"type": "table", "html": "<table/>", "bbox": ["a"]}]}, {"label": "text", "text": " "}]}}'
    b = spark.createDataFrame([(raw,)], "raw string").select(F.posexplode(layout.layout_blocks("raw")).alias("pos", "b"))
    return b.select(F.col("pos").cast("long").alias("pos"), "b.label", "b.content", "b.confidence")


@query("model_outcomes", values_sql([("a", "success", 1), ("b", "needs_review", 2), ("c", "failed", 2)], ["t", "status", "tries"]))
def model_outcomes(spark, sf_dir):
    def model(text):
        if text == "c":
            raise ValueError("no")
        return "good" if text == "a" else "bad"

    df = layout.apply_model(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), ["t"], model, tries=2, valid=lambda x: x == "good")
    return df.select("t", "output.status", F.col("output.tries").cast("long").alias("tries"))


@query("derived_blocks", values_sql([("a", 0), ("i", 1), ("v", 2), ("b", 3)], ["block_id", "reading_order"]))
def derived_blocks(spark, sf_dir):
    b = spark.createDataFrame([("d", "a", 0), ("d", "i", 1), ("d", "b", 2)], "document_id string, block_id string, reading_order int")
    new = spark.createDataFrame([("d", "v", "i", 0)], "document_id string, block_id string, derived_from string, reading_order int")
    return layout.insert_derived(b, new).select("block_id", F.col("reading_order").cast("long").alias("reading_order"))


@query("page_spans", "SELECT l_orderkey, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end, count(DISTINCT l_linenumber) AS n_pages FROM lineitem GROUP BY l_orderkey")
def page_spans(spark, sf_dir):
    s = layout.span_of_pages(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return s.select("l_orderkey", "page_start", "page_end", F.size("pages").cast("long").alias("n_pages"))


@query(
    "previous_page",
    """SELECT conv_id, turn, CASE WHEN p IS NULL THEN '' WHEN length(p) <= 5000 THEN p ELSE 'long' END AS previous FROM (SELECT a.conv_id, a.turn, b.text AS p FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)""",
)
def previous_page(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("page"), F.lit(0).alias("reading_order"), F.col("text").alias("content"))
    return layout.previous_page_text(c, 5000).select(F.col("document_id").alias("conv_id"), F.col("page").cast("long").alias("turn"), "previous")


@query(
    "correction_stats",
    """SELECT conv_id AS document_id, count(*) AS components, count(*) FILTER (role = 'user') AS success, count(*) FILTER (role = 'system') AS failed, CAST(sum(length(text)) AS BIGINT) AS chars_in FROM conversations GROUP BY conv_id""",
)
def correction_stats(spark, sf_dir):
    status = F.when(F.col("role") == "user", "success").when(F.col("role") == "system", "failed").otherwise("partial")
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), status.alias("status"), F.col("text").alias("content_raw"), F.upper("text").alias("content"))
    return layout.correction_stats(c).select("document_id", "components", "success", "failed", "chars_in")
