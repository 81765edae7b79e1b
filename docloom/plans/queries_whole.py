"""Operators over whole tables whose cases are otherwise written by hand: numbers,
ranges, operations, corrections, derived blocks, filled chunks and budgeted contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T
from docloom.operators import chunking, context, graph
from docloom.plans.queries_text import by_order, read
from docloom.plans.registry import query


def _pick(key: Column, options: list[Column]) -> Column:
    """The option whose place is key modulo their number."""
    return F.element_at(F.array(*options), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


@query(
    "parsed_amounts",
    """WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, round(CASE o_orderkey % 7 WHEN 0 THEN cents / 100.0::DOUBLE WHEN 1 THEN cents / 100.0::DOUBLE WHEN 2 THEN -cents / 100.0::DOUBLE WHEN 3 THEN cents / 10000.0::DOUBLE WHEN 4 THEN -(cents // 100) WHEN 5 THEN cents // 100 END, 6) AS value FROM o""",
)
def parsed_amounts(spark, sf_dir):
    """Each order's price, written in one of seven notations, and read back."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    whole, part = F.floor(F.col("cents") / 100).cast("long"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    english = F.format_number(whole, 0)
    vietnamese = F.translate(english, ",", ".")
    forms = [
        F.concat(vietnamese, F.lit(","), part, F.lit(" đồng")), F.concat(english, F.lit("."), part, F.lit(" USD")), F.concat(F.lit("("), whole.cast("string"), F.lit("."), part, F.lit(")")),
        F.concat(whole.cast("string"), F.lit(","), part, F.lit("%")), F.concat(F.lit("-"), whole.cast("string")), F.concat(F.lit(" "), vietnamese, F.lit(" VNĐ ")), F.concat(F.lit("HD"), whole.cast("string")),
    ]
    return o.select("o_orderkey", F.round(T.parse_number(_pick(F.col("o_orderkey"), forms)), 6).alias("value"))


@query(
    "ranges_of_lines",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS r1, CAST(l_partkey % 60 + 1 AS INT) AS r2, CAST(l_partkey % 700 + 1 AS INT) AS c1, CAST(l_suppkey % 700 + 1 AS INT) AS c2 FROM lineitem),
n AS (SELECT *, CASE WHEN c1 > 26 THEN chr(64 + (c1 - 1) // 26) ELSE '' END || chr(65 + (c1 - 1) % 26) AS a, CASE WHEN c2 > 26 THEN chr(64 + (c2 - 1) // 26) ELSE '' END || chr(65 + (c2 - 1) % 26) AS b FROM l)
SELECT l_orderkey, l_partkey, '''Sheet ' || l_linenumber || '''!$' || a || '$' || r1 || ':' || b || r2 AS ref, 'Sheet ' || l_linenumber AS sheet, least(r1, r2) AS min_row, greatest(r1, r2) AS max_row, least(c1, c2) AS min_col, greatest(c1, c2) AS max_col,
  c1 BETWEEN 10 AND 100 OR c2 BETWEEN 10 AND 100 OR (least(c1, c2) < 10 AND greatest(c1, c2) > 100) AS meets FROM n""",
)
def ranges_of_lines(spark, sf_dir):
    """References made from the numbers of each line, parsed; whether they meet the columns J to CV."""
    number = lambda c: F.col(c).cast("int")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", number("l_quantity").alias("r1"), (F.col("l_partkey") % 60 + 1).cast("int").alias("r2"), (F.col("l_partkey") % 700 + 1).alias("c1"), (F.col("l_suppkey") % 700 + 1).alias("c2"))  # noqa: E741
    text = lambda c: F.col(c).cast("string")
    ref = F.concat(F.lit("'Sheet "), text("l_linenumber"), F.lit("'!$"), T.column_name(F.col("c1")), F.lit("$"), text("r1"), F.lit(":"), T.column_name(F.col("c2")), text("r2"))
    parsed = l.select("l_orderkey", "l_partkey", ref.alias("ref")).withColumn("r", T.parse_cell_range("ref"))
    return parsed.select("l_orderkey", "l_partkey", "ref", "r.*", T.ranges_overlap(F.col("r"), T.parse_cell_range(F.lit("J1:CV1000"))).alias("meets"))


#: Words of a question, and the operation that each asks for; some only look like one.
ASKING = [("Trung bình", "avg"), ("mean", "avg"), ("CAO NHẤT", "max"), ("max", "max"), ("thấp  nhất", "min"), ("lowest", "min"), ("tổng", "sum"), ("total", "sum"), ("có bao nhiêu", "count"), ("how many", "count"), ("summary", None), ("maximum", None), ("giá", None)]
_ASK = ", ".join(f"({i}, {repr(op) if op else 'NULL'}, {order})" for i, (_, op) in enumerate(ASKING) for order in [["avg", "max", "min", "sum", "count", None].index(op)])


@query(
    "operations_of_orders",
    f"""WITH w(i, op, place) AS (VALUES {_ASK}) SELECT o_orderkey, CASE WHEN a.place <= b.place THEN a.op ELSE b.op END AS operation
FROM orders JOIN w a ON a.i = o_orderkey % {len(ASKING)} JOIN w b ON b.i = o_custkey % {len(ASKING)}""",
)
def operations_of_orders(spark, sf_dir):
    """A question for each order with two words of the list; the first operation in precedence counts."""
    words = [F.lit(w) for w, _ in ASKING]
    asked = F.concat(_pick(F.col("o_orderkey"), words), F.lit(" của đơn "), F.col("o_orderkey").cast("string"), F.lit(", "), _pick(F.col("o_custkey"), words), F.lit("?"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.detect_operation(asked).alias("operation"))


_RAW = "'Khách hàng ' || o_custkey || ' đặt đơn HD' || o_orderkey || ' mức ' || o_orderpriority"


@query(
    "corrections_of_orders",
    f"""WITH r AS (SELECT o_orderkey, o_custkey, {_RAW} AS raw FROM orders),
c AS (SELECT *, CASE o_custkey % 6 WHEN 0 THEN raw WHEN 1 THEN '  ' WHEN 2 THEN repeat(raw, 4) WHEN 3 THEN replace(raw, 'HD' || o_orderkey, 'HD' || (o_orderkey + 1)) WHEN 4 THEN replace(raw, 'Khách hàng', 'Khach hang') ELSE substr(raw, 1, 5) END AS new FROM r)
SELECT o_orderkey, CASE WHEN trim(new) = '' THEN 'empty_output' WHEN length(new) > 3 * length(raw) OR length(new) < 0.35 * length(raw) THEN 'length_ratio'
  WHEN NOT list_has_all(regexp_extract_all(new, 'HD[0-9]+|[0-9]+'), regexp_extract_all(raw, 'HD[0-9]+|[0-9]+')) THEN 'protected_token_changed' END AS reason FROM c""",
)
def corrections_of_orders(spark, sf_dir):
    """A sentence of each order and a correction of one of six kinds."""
    o = read(spark, sf_dir, "orders").withColumn("raw", F.expr(_RAW))
    sign = lambda n: F.concat(F.lit("HD"), n.cast("string"))
    new = [
        F.col("raw"), F.lit("  "), F.repeat("raw", 4), F.replace("raw", sign(F.col("o_orderkey")), sign(F.col("o_orderkey") + 1)),
        F.replace("raw", F.lit("Khách hàng"), F.lit("Khach hang")), F.substring("raw", 1, 5),
    ]
    return o.select("o_orderkey", T.validate_correction(F.col("raw"), _pick(F.col("o_custkey"), new)).alias("reason"))


# ------------------------------------------------- an order's lines as text blocks

_SORT = "l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice"
_BLOCKS = f"""b AS (SELECT CAST(l_orderkey AS VARCHAR) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) AS n, l_returnflag, l_partkey, l_quantity FROM lineitem),
l AS (SELECT d, n, l_returnflag, 'Part ' || l_partkey || ' ' || n || ' ' || repeat('x', CAST(l_quantity AS INT)) AS t FROM b)"""


def _lines(spark, sf_dir) -> DataFrame:
    """Each line of an order as a text of 10 to 70 characters; every second one is
    said to be made from the line before, every fifth from none of its document."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(*_SORT.split(", ")))
    b = by_order(spark, sf_dir).withColumn("n", n)
    at = lambda n: F.concat("document_id", F.lit("/"), n.cast("string"))
    origin = F.when(F.col("n") % 5 == 0, F.lit("nowhere")).when(F.col("n") % 2 == 0, at(F.col("n") - 1))
    text = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit(" "), F.expr("repeat('x', cast(l_quantity as int))"))
    none = lambda kind: F.lit(None).cast(kind)
    return b.select(
        "document_id", at(F.col("n")).alias("block_id"), F.lit("text").alias("block_type"), text.alias("content"), F.concat("document_id", F.lit(".docx")).alias("source_file"), F.array().cast("array<string>").alias("section_path"),
        F.lit(1).alias("page"), none("string").alias("sheet_name"), none("string").alias("cell_range"), F.col("n").alias("reading_order"), none("array<array<string>>").alias("rows"), origin.alias("derived_from"),
        none("array<string>").alias("source_ranges"), none("string").alias("image_type"), none("string").alias("numeric_repr"), F.col("l_returnflag").alias("flag"),
    )


@query("derived_lines", f"WITH {_BLOCKS} SELECT d || '/' || n AS source_id, d || '/' || (n - 1) AS target_id, 'derived_from' AS relation_type FROM l WHERE n % 2 = 0 AND n % 5 <> 0")
def derived_lines(spark, sf_dir):
    """Lines to the line of their order that they were made from."""
    return graph.derived(_lines(spark, sf_dir)).select("source_id", "target_id", "relation_type")


@query(
    "relations_of_lines",
    f"""WITH {_BLOCKS}, e AS (SELECT a.d, a.n, a.l_returnflag AS f, b.l_returnflag AS g FROM l a JOIN l b ON a.d = b.d AND b.n = a.n - 1 WHERE a.n % 2 = 0 AND a.n % 5 <> 0)
SELECT d || '/' || n AS source_id, d || '/' || (n - 1) AS target_id FROM e WHERE f = 'R' OR g = 'R'""",
)
def relations_of_lines(spark, sf_dir):
    """Derivations of which either end is a returned line."""
    lines = _lines(spark, sf_dir)
    edges = graph.derived(lines).unionByName(graph.reading_order(lines))
    return graph.related(edges, lines.where("flag = 'R'").select("block_id"), ["derived_from"]).select("source_id", "target_id")


FILL, ROOM = 120, 200
_FILLED = f"""{_BLOCKS}, f AS (SELECT d, n, 0 AS g, length(t) AS used FROM l WHERE n = 1
  UNION ALL SELECT l.d, l.n, CASE WHEN used + 2 + length(t) <= {FILL} THEN g ELSE g + 1 END, CASE WHEN used + 2 + length(t) <= {FILL} THEN used + 2 + length(t) ELSE length(t) END FROM f JOIN l ON l.d = f.d AND l.n = f.n + 1),
c AS (SELECT d, g, count(*) AS n_blocks, string_agg(t, chr(10) || chr(10) ORDER BY n) AS content FROM f JOIN l USING (d, n) GROUP BY d, g)"""


def _filled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(edges, blocks) of the lines without their derivations."""
    return graph.build(_lines(spark, sf_dir).withColumn("derived_from", F.lit(None).cast("string")).drop("flag"))


@query("filled_chunks", f"WITH RECURSIVE {_FILLED} SELECT d AS document_id, CAST(g AS BIGINT) AS ordinal, n_blocks, md5(content) AS content FROM c")
def filled_chunks(spark, sf_dir):
    """An order's lines in chunks of at most 120 characters, each filled before the next begins."""
    chunks = chunking.chunk(_filled(spark, sf_dir)[1], text_chars=FILL)
    return chunks.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), F.size("block_ids").cast("long").alias("n_blocks"), F.md5(F.col("content").cast("binary")).alias("content"))


@query(
    "budgeted_contexts",
    f"""WITH RECURSIVE {_FILLED}, r AS (SELECT d, max(g) + 1 AS g, {ROOM} AS room, false AS shown FROM c GROUP BY d
  UNION ALL SELECT c.d, c.g, CASE WHEN length(content) <= room THEN room - length(content) ELSE room END, length(content) <= room FROM r JOIN c ON c.d = r.d AND c.g = r.g - 1)
SELECT d AS query_id, 'SOURCE_' || row_number() OVER (PARTITION BY d ORDER BY g) AS source_id, md5(content) AS content, '[' || d || '.docx, trang 1]' AS citation FROM r JOIN c USING (d, g) WHERE shown""",
)
def budgeted_contexts(spark, sf_dir):
    """Of the chunks of each order, best last: those that still fit into 200 characters, in order of the text."""
    edges, full = _filled(spark, sf_dir)
    edges = scratch.saved(edges.where(F.col("relation_type").isin(list(context.EXPANSION))), "edges")
    chunks = scratch.saved(chunking.chunk(full, text_chars=FILL), "chunks")
    # What is shown of a block is as it came, so the blocks are not kept.
    blocks = _lines(spark, sf_dir)
    hits = chunks.select(F.col("document_id").alias("query_id"), "chunk_id", (F.lit(1_000_000) - F.col("ordinal")).alias("rank"))
    found = context.expand(hits, chunks, edges, blocks, neighbours=0, budget=ROOM)
    return found.select("query_id", "source_id", F.md5(F.col("content").cast("binary")).alias("content"), "citation")
