"""Queries of the document graph, chunks, profiles, computations and the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T
from docloom.operators import chunking, compute, graph, lookup, profile, regions
from docloom.plans import fixtures, store
from docloom.plans.queries_text import read, values_sql
from docloom.plans.registry import query
from docloom.sources import files, web


def _turns(spark, sf_dir):
    """Conversations as blocks: a system turn is a heading that names its section."""
    c = read(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    return c.select(
        key.alias("document_id"), F.concat_ws("/", "conv_id", "turn").alias("block_id"), F.when(F.col("role") == "system", "heading").otherwise("text").alias("block_type"), F.col("text").alias("content"),
        F.array(F.lit("s")).alias("section_path"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet_name"), F.col("turn").cast("int").alias("reading_order"), "role",
    )


@query(
    "next_in_order",
    "SELECT source_id, target_id FROM (SELECT conv_id || '/' || turn AS source_id, lead(conv_id || '/' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target_id FROM conversations) WHERE target_id IS NOT NULL",
)
def next_in_order(spark, sf_dir):
    return graph.reading_order(_turns(spark, sf_dir)).select("source_id", "target_id")


@query(
    "section_asof",
    """SELECT source_id, target_id FROM (SELECT conv_id || '/' || turn AS source_id, role,
  last_value(CASE WHEN role = 'system' THEN conv_id || '/' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_id FROM conversations)
WHERE role <> 'system' AND target_id IS NOT NULL""",
)
def section_asof(spark, sf_dir):
    return graph.sections(_turns(spark, sf_dir)).select("source_id", "target_id")


@query(
    "gaps_islands_runs",
    """SELECT conv_id, turn, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (
  SELECT conv_id, turn, CASE WHEN role <> 'user' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM conversations)""",
)
def gaps_islands_runs(spark, sf_dir):
    """Stretches of turns of one role; a user's turn (here no text block) always ends one."""
    c = _turns(spark, sf_dir).withColumn("block_type", F.when(F.col("role") == "user", "image").otherwise("text")).withColumn("section_path", F.array("role"))
    r = chunking.text_runs(c)
    return r.select(F.split("block_id", "/")[0].cast("long").alias("conv_id"), F.split("block_id", "/")[1].cast("long").alias("turn"), F.col("run").cast("long").alias("run"))


@query(
    "section_paths",
    """WITH RECURSIVE b AS (SELECT conv_id, turn, role = 'user' AS heading, 1 + length(text) % 4 AS level, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, CASE WHEN heading THEN [text] ELSE [] END AS path FROM b WHERE i = 1
  UNION ALL SELECT b.conv_id, b.turn, b.i, CASE WHEN heading THEN list_append(p.path[1:level - 1], text) ELSE p.path END FROM p JOIN b ON b.conv_id = p.conv_id AND b.i = p.i + 1)
SELECT conv_id, turn, CAST(len(path) AS INTEGER) AS depth, md5(array_to_string(path, ' > ')) AS path FROM p""",
)
def section_paths(spark, sf_dir):
    """Turns as blocks, a user's turn as a heading of a level between 1 and 4."""
    c = read(spark, sf_dir, "conversations")
    b = c.select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("/", "conv_id", "turn").alias("block_id"), F.when(F.col("role") == "user", "heading").otherwise("text").alias("block_type"),
        F.col("text").alias("content"), (1 + F.length("text") % 4).cast("int").alias("level"), F.col("turn").cast("int").alias("reading_order"),
    )
    p = chunking.section_paths(b)
    return p.select(F.col("document_id").cast("long").alias("conv_id"), F.col("reading_order").cast("long").alias("turn"), F.size("section_path").alias("depth"), F.md5(F.array_join("section_path", " > ").cast("binary")).alias("path"))


@query("page_blocks", r"""SELECT page_id, count(*) AS n_blocks, count(*) FILTER (regexp_matches(p, '(?i)^<h[1-6]')) AS n_headings FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>')) AS p FROM pages) GROUP BY page_id""")  # fmt: skip
def page_blocks(spark, sf_dir):
    """Headings, paragraphs and list items of web pages as blocks."""
    b = chunking.section_paths(web.blocks(read(spark, sf_dir, "pages")))
    return b.groupBy(F.col("document_id").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n_blocks"), F.count(F.when((F.col("block_type") == "heading") & (F.size("section_path") > 0), 1)).alias("n_headings"))


# --------------------------------------------------- the block fixture's graph


def _blocks(spark):
    return spark.createDataFrame(fixtures.BLOCKS, fixtures.BLOCK_SCHEMA)


@query("graph_edges", values_sql(fixtures.EDGES, ["source_id", "target_id", "relation_type"]))
def graph_edges(spark, sf_dir):
    edges, _ = graph.build(_blocks(spark))
    return edges.where("relation_type <> 'next_in_reading_order'").select("source_id", "target_id", "relation_type")


@query("graph_attributes", values_sql(fixtures.ATTRIBUTES, ["block_id", "caption", "attached_to", "n_references", "inherited"]))
def graph_attributes(spark, sf_dir):
    _, full = graph.build(_blocks(spark))
    return full.select("block_id", "caption", "attached_to", F.size(F.coalesce("references", F.array())).cast("long").alias("n_references"), F.coalesce(F.array_join("inherited_header", "|"), F.lit("")).alias("inherited")).where("caption is not null or attached_to is not null or n_references > 0 or inherited <> ''")


@query("related_edges", values_sql([("t1", "c1", "captioned_by"), ("t1", "p1", "referenced_by"), ("t2", "t1", "continues")], ["source_id", "target_id", "relation_type"]))
def related_edges(spark, sf_dir):
    edges, _ = graph.build(_blocks(spark))
    return graph.related(edges, spark.createDataFrame([("t1",)], "block_id string"), ["captioned_by", "referenced_by", "continues"]).select("source_id", "target_id", "relation_type")


@query("chunks", values_sql(fixtures.CHUNKS, ["document_id", "ordinal", "chunk_type", "n_blocks", "page_start", "page_end"]))
def chunks(spark, sf_dir):
    _, full = graph.build(_blocks(spark))
    c = chunking.chunk(full)
    return c.select("document_id", *[F.col(x).cast("long").alias(x) for x in ("ordinal",)], "chunk_type", F.size("block_ids").cast("long").alias("n_blocks"), *[F.col(x).cast("long").alias(x) for x in ("page_start", "page_end")])


@query(
    "interval_overlap",
    """WITH s AS (SELECT l_suppkey, l_linenumber, min(l_orderkey) AS a, max(l_orderkey) AS z, min(l_partkey) + 1 AS row FROM lineitem GROUP BY ALL)
SELECT x.l_suppkey, x.l_linenumber AS chart, y.l_linenumber AS source FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.row BETWEEN y.a + 1 AND y.z + 1""",
)
def interval_overlap(spark, sf_dir):
    """Charts and the tables whose ranges they read: a sheet for each supplier, a
    table over the rows of each line number's orders, a chart that reads one row."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("z"), F.min("l_partkey").alias("row"))
    text = lambda c: F.col(c).cast("string")
    line = lambda c: (F.col(c) + 1).cast("string")
    none = F.lit(None)
    common = [text("l_suppkey").alias("document_id"), F.lit("Sheet 1").alias("sheet_name")]
    tables = s.select(*common, F.concat(F.lit("t"), text("l_linenumber")).alias("block_id"), F.lit("table").alias("block_type"), F.concat(F.lit("B"), line("a"), F.lit(":D"), line("z")).alias("cell_range"), none.cast("array<string>").alias("source_ranges"))
    charts = s.select(*common, F.concat(F.lit("c"), text("l_linenumber")).alias("block_id"), F.lit("chart").alias("block_type"), none.cast("string").alias("cell_range"), F.array(F.concat(F.lit("'sheet 1'!$C$"), line("row"))).alias("source_ranges"))
    e = graph.chart_sources(tables.unionByName(charts))
    number = lambda c: F.substring(c, 2, 9).cast("int")
    return e.select(F.col("document_id").cast("long").alias("l_suppkey"), number("source_id").alias("chart"), number("target_id").alias("source"))


GRID = [(1, 1), (1, 2), (3, 1), (3, 2), (4, 1), (4, 4), (5, 4), (5, 5), (9, 3)]


@query("sheet_regions", values_sql([("s", 1, 1, 1, 2), ("s", 3, 4, 1, 2), ("s", 4, 5, 4, 5), ("s", 9, 9, 3, 3)], ["sheet", "first_row", "last_row", "first_col", "last_col"]))
def sheet_regions(spark, sf_dir):
    cells = spark.createDataFrame([("s", r, c) for r, c in GRID], "sheet string, row long, col long")
    return regions.find_regions(cells)


@query("profile_case", values_sql([("123/QĐ-UBND", "2025-03-05", "Trần Thị Mai", "ỦY BAN NHÂN DÂN HUYỆN X")], ["doc_number", "issue_date", "signer", "issuer"]))
def profile_case(spark, sf_dir):
    p, _ = profile.build(spark.createDataFrame(fixtures.OFFICIAL, fixtures.BLOCK_SCHEMA))
    return p.select("doc_number", "issue_date", F.get(F.filter("signers", lambda x: x == "Trần Thị Mai"), F.lit(0)).alias("signer"), "issuer")


@query("profile_entities", values_sql([("nguyen van an", "Nguyễn Văn An", 2, "person")], ["key", "canonical", "count", "kind"]))
def profile_entities(spark, sf_dir):
    _, e = profile.build(spark.createDataFrame(fixtures.OFFICIAL, fixtures.BLOCK_SCHEMA))
    return e.where("key = 'nguyen van an'").select("key", "canonical", "count", "kind")


# ---------------------------------------------------------------- computations


def _sheets(spark, sf_dir):
    """Customers of each nation as a table block, with a row of totals."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.struct(F.col("c_custkey").alias("k"), F.array(F.col("c_name"), F.col("c_mktsegment"), F.format_string("%.2f", "c_acctbal")).alias("r"))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    rows = F.concat(F.array(F.array(F.lit("Customer"), F.lit("Segment"), F.lit("Balance"))), body, F.array(F.array(F.lit("Total"), F.lit(""), F.lit("1.00"))))
    return c.groupBy("n_name").agg(rows.alias("rows")).select(F.col("n_name").alias("block_id"), "rows", F.lit(None).cast("array<string>").alias("inherited_header"), F.lit("python").alias("numeric_repr"))


QUESTIONS = {"sum": "total balance of segment BUILDING", "avg": "average balance for MACHINERY", "max": "highest balance of AUTOMOBILE", "min": "lowest balance", "count": "how many BUILDING rows"}
_WHERE = {"sum": "c_mktsegment = 'BUILDING'", "avg": "c_mktsegment = 'MACHINERY'", "max": "c_mktsegment = 'AUTOMOBILE'", "min": "TRUE", "count": "c_mktsegment = 'BUILDING'"}
_AGG = {"sum": "sum(b)", "avg": "avg(b)", "max": "max(b)", "min": "min(b)", "count": "CAST(count(*) AS DOUBLE)"}


@query(
    "compute_answers",
    "WITH c AS (SELECT *, round(c_acctbal, 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey)) "
    + " UNION ALL ".join(f"SELECT '{op}' AS operation, (SELECT min(n_name) FROM c) AS block_id, round({_AGG[op]}, 4) AS value, count(*) AS rows_used FROM c WHERE {_WHERE[op]}" for op in QUESTIONS),
)
def compute_answers(spark, sf_dir):
    """The five operations over one plan; tables of equal fit give way to the first."""
    q = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query string")
    a = compute.compute(q, _sheets(spark, sf_dir))
    return a.select("operation", "block_id", F.round("value", 4).alias("value"), "rows_used")


@query("compute_case", values_sql([("sum", 350.5, "Doanh thu", "miền bắc", None), ("max", 400.0, "Doanh thu", None, "CN3 | Miền Nam | 400")], ["operation", "value", "column_name", "filter_value", "label"]))
def compute_case(spark, sf_dir):
    rows = [["Chi nhánh", "Khu vực", "Doanh thu"], ["CN1", "Miền Bắc", "100"], ["CN2", "Miền Bắc", "250.5"], ["CN3", "Miền Nam", "400"], ["Tổng", "", "750.5"]]
    blocks = spark.createDataFrame([("t", rows, None, "python")], "block_id string, rows array<array<string>>, inherited_header array<string>, numeric_repr string")
    q = spark.createDataFrame([(1, "Tổng doanh thu miền Bắc là bao nhiêu?"), (2, "Chi nhánh có doanh thu cao nhất")], "query_id long, query string")
    a = compute.compute(q, blocks)
    return a.select("operation", "value", F.col("column").alias("column_name"), F.get("filters", F.lit(0))["value"].alias("filter_value"), F.col("label_of_extreme").alias("label"))


# ----------------------------------------------------------------------- store


@query(
    "upsert_final_state",
    "SELECT doc_id, 'new' AS state, n_chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'old', n_chars FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0",
)
def upsert_final_state(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old, new = d.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), d.where("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    return store.upsert(old, new, "doc_id").select("doc_id", "state", "n_chars")


@query("delete_cascade", "SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT' GROUP BY o_orderkey")
def delete_cascade(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    o, li = store.delete(read(spark, sf_dir, "orders"), gone, "o_orderkey"), store.delete(read(spark, sf_dir, "lineitem"), gone.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_lines"))


@query("dedupe_versions", "SELECT source, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT source, sha256(text) FROM documents WHERE doc_id % 2 = 0")
def dedupe_versions(spark, sf_dir):
    """New versions only: (name, hash) not known, repeats of a batch once."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.sha2("text", 256).alias("content_hash"))
    return files.new_versions(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select(F.col("name").alias("source"), "content_hash")


@query(
    "inventory_diff",
    """(SELECT p_partkey, p_name, 'left' AS side FROM (SELECT p_partkey, p_name FROM part WHERE p_size < 20 EXCEPT ALL SELECT p_partkey, p_name FROM part WHERE p_size > 10))
UNION ALL (SELECT p_partkey, p_name, 'right' FROM (SELECT p_partkey, p_name FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_partkey, p_name FROM part WHERE p_size < 20))""",
)
def inventory_diff(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return store.inventory_difference(p.where("p_size < 20").select("p_partkey", "p_name"), p.where("p_size > 10").select("p_partkey", "p_name"))


@query("point_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return lookup.by_id(read(spark, sf_dir, "documents"), "doc_id", 42).select("doc_id", "lang", "source")


@query("blocks_in_order", "SELECT pos, doc_id, lang FROM (SELECT unnest([5, 3, 999999, 7, 3]::BIGINT[]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN documents USING (doc_id)")
def blocks_in_order(spark, sf_dir):
    """Lookup of a list of ids that keeps the list's order; missing ids drop out."""
    ids = spark.createDataFrame([([5, 3, 999999, 7, 3],)], "ids array<long>")
    return lookup.in_order(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ids).select("pos", "doc_id", "lang")


@query("list_values", "SELECT DISTINCT source FROM documents ORDER BY 1")
def list_values(spark, sf_dir):
    return lookup.distinct_values(read(spark, sf_dir, "documents"), "source").withColumnRenamed("value", "source")


@query("json_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 3 AND event_type = 'click'")
def json_filter(spark, sf_dir):
    """A predicate on a JSON field beside one that reaches the scan."""
    return read(spark, sf_dir, "events").where("event_type = 'click'").where(lookup.json_is("props", "$.k", 3)).select("event_id")


@query("table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_counts(spark, sf_dir):
    return lookup.counts({t: read(spark, sf_dir, t) for t in ("documents", "pages", "conversations")})


@query(
    "long_tables",
    "SELECT n_name AS block_id, c_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT n_name, 'Total' FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def long_tables(spark, sf_dir):
    t = store.long_tables(_sheets(spark, sf_dir).withColumn("block_type", F.lit("table")))
    return t.where("header = 'Customer'").select("block_id", "value")


@query("unique_headers", values_sql([(0, "a"), (1, "column_2"), (2, "a_1"), (3, "b"), (4, "a_2")], ["pos", "name"]))
def unique_headers(spark, sf_dir):
    df = spark.createDataFrame([(["a", " ", "a", "b", "a "],)], "h array<string>")
    return df.select(F.posexplode(T.unique_headers("h")).alias("pos", "name")).select(F.col("pos").cast("long").alias("pos"), "name")


@query(
    "latest_statuses",
    "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50",
)
def latest_statuses(spark, sf_dir):
    return lookup.latest(read(spark, sf_dir, "events"), "ts", "event_id", 50).select("event_id", "event_type")


@query("heading_map", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Người dùng' ELSE role END AS part FROM conversations")
def heading_map(spark, sf_dir):
    """Parts of a path replaced by a dictionary; others stay."""
    c = read(spark, sf_dir, "conversations").withColumn("path", lookup.map_parts(F.array("role"), {"user": "Người dùng"}))
    return c.select("conv_id", "turn", F.col("path")[0].alias("part"))


@query(
    "continuation_lag",
    """WITH t AS (SELECT conv_id, turn, turn // 2 AS page, 1 + length(text) % 2 AS width, role FROM conversations),
l AS (SELECT *, lag(page) OVER w AS p_page, lag(width) OVER w AS p_width, lag(role) OVER w AS p_role, lag(turn) OVER w AS p_turn,
  row_number() OVER (PARTITION BY conv_id, page ORDER BY turn) AS first, lag(c) OVER w = lag(n) OVER w AS p_last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, page ORDER BY turn) AS c, count(*) OVER (PARTITION BY conv_id, page) AS n FROM t)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, p_turn AS previous, role = p_role AS repeated, CASE WHEN role <> p_role THEN p_role END AS header FROM l WHERE page = p_page + 1 AND width = p_width AND first = 1 AND p_last""",
)
def continuation_lag(spark, sf_dir):
    """Turns as tables, two on a page, whose header is the role (in one or two columns)."""
    c = read(spark, sf_dir, "conversations")
    header = F.when(F.length("text") % 2 == 0, F.array("role")).otherwise(F.array("role", "role"))
    b = c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("block_id"), F.lit("table").alias("block_type"), F.col("text").alias("content"), F.floor(F.col("turn") / 2).cast("int").alias("page"), F.col("turn").cast("int").alias("reading_order"), F.array(header).alias("rows"))
    t = graph.table_continuations(b)
    return t.select(F.col("document_id").cast("long").alias("conv_id"), F.col("block_id").cast("long").alias("turn"), F.col("previous_id").cast("long").alias("previous"), F.col("repeated_header").alias("repeated"), F.col("inherited_header")[0].alias("header"))


@query(
    "archive_entries",
    "SELECT doc_id || '.txt' AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error_code FROM documents",
)
def archive_entries(spark, sf_dir):
    """Texts go into ZIP archives, and these are read back entry by entry."""
    folder = scratch.path(spark, "archives")
    d = read(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    scratch.saved(files.write_archives(d, folder), "written")
    found = files.expand_archives(files.discover(spark, [folder]))
    return found.select("name", "length", F.sha2("content", 256).alias("sha256"), "error_code")
