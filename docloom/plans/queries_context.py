"""Queries of context: related blocks, expansion, names of chunks, index payloads, uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import scratch
from docloom.operators import chunking, context, graph, layout, profile
from docloom.plans import fixtures
from docloom.plans.queries_text import by_order, read, values_sql
from docloom.plans.registry import query
from docloom.streaming import correction


def _corpus(spark):
    edges, full = graph.build(spark.createDataFrame(fixtures.BLOCKS, fixtures.BLOCK_SCHEMA))
    full = full.cache()  # a handful of blocks that several joins read
    return edges.cache(), full, chunking.chunk(full).cache()


def _hits(spark, chunks, block: str):
    return chunks.where(F.array_contains("block_ids", block)).select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.lit(1).alias("rank"), "block_ids")


@query("related_blocks", values_sql([("c1", 1), ("p1", 2), ("t2", 3)], ["block_id", "place"]))
def related_blocks(spark, sf_dir):
    """What goes with a table: its caption, the text that names it, its continuation."""
    edges, full, chunks = _corpus(spark)
    return context.related_blocks(_hits(spark, chunks, "t1"), edges, full).select("block_id", F.col("place").cast("long").alias("place"))


@query("context_expansion", values_sql([("SOURCE_1", "[d1.docx, trang 1]", True, True)], ["source_id", "citation", "has_caption", "has_mention"]))
def context_expansion(spark, sf_dir):
    edges, full, chunks = _corpus(spark)
    e = context.expand(_hits(spark, chunks, "t1").drop("block_ids"), chunks, edges, full)
    return e.select("source_id", "citation", F.contains("content", F.lit("Bảng 2: Phí thẻ")).alias("has_caption"), F.contains("content", F.lit("Xem Bảng 2")).alias("has_mention"))


@query("chunk_entities", values_sql([("o", "Nguyễn Văn An")], ["document_id", "entity"]))
def chunk_entities(spark, sf_dir):
    """Names that a chunk mentions, by key."""
    blocks = spark.createDataFrame(fixtures.OFFICIAL, fixtures.BLOCK_SCHEMA)
    _, full = graph.build(blocks)
    p, e = profile.build(blocks)
    a = profile.attach(chunking.chunk(full), p, e)
    return a.select("document_id", F.explode("entities").alias("entity")).where("entity = 'Nguyễn Văn An'").distinct()


@query(
    "entity_rows",
    "SELECT CAST(c_nationkey AS VARCHAR) AS document_id, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Group' AS canonical, count(*) AS mentions FROM customer GROUP BY ALL",
)
def entity_rows(spark, sf_dir):
    """Rows of names for lookup: canonical form, key, aliases, mentions."""
    texts = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" Group")).alias("content"))
    return profile.ledger(texts).select("document_id", "canonical", F.col("count").alias("mentions"))


@query("index_payload", values_sql([("d1", 6, "Tiêu đề"), ("d2", 3, None)], ["document_id", "n_chunks", "doc_title"]))
def index_payload(spark, sf_dir):
    _, _, chunks = _corpus(spark)
    docs = spark.createDataFrame([("d1", "Tiêu đề", None, None, None, "d1.docx", "h")], "document_id string, title string, doc_number string, issue_date string, signers array<string>, original_name string, content_hash string")
    p = layout.index_payload(chunks, docs)
    return p.groupBy("document_id", "doc_title").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("stream_uploads", "SELECT DISTINCT source AS name, sha256(text) AS sha256 FROM documents")
def stream_uploads(spark, sf_dir):
    """A stream of uploads over several micro-batches; each (name, hash) passes once."""
    base = scratch.path(spark, "uploads")
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.sha2("text", 256).alias("sha256"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    d.repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    once = correction.repeat_uploads(stream).select("name", "sha256")
    once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{base}/out")


# ------------------------------------------- a document for each order of lineitem


def _orders(spark, sf_dir):
    """Each order as a document: for each of its lines a caption, a table and a text
    that names the table of the line before (the first line's its own)."""
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("document_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    b = by_order(spark, sf_dir).select("document_id", line.alias("n"), F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supp"), F.col("l_returnflag").alias("mode"))
    number, before = F.col("n").cast("string"), F.greatest(F.lit(1), F.col("n") - 1).cast("string")
    kinds = F.array(
        F.struct(F.lit("caption").alias("block_type"), F.lit("c").alias("k"), F.lit(0).alias("at"), F.concat(F.lit("Bảng "), number, F.lit(": part "), "part").alias("content"), F.lit(None).cast("array<array<string>>").alias("rows")),
        F.struct(F.lit("table").alias("block_type"), F.lit("t").alias("k"), F.lit(1).alias("at"), F.lit("table").alias("content"), F.array(F.array(F.lit("Part"), F.lit("Supplier")), F.array("part", "supp")).alias("rows")),
        F.struct(F.lit("text").alias("block_type"), F.lit("x").alias("k"), F.lit(2).alias("at"), F.concat(F.lit("Line "), number, F.lit(" by "), "mode", F.lit(" as Bảng "), before).alias("content"), F.lit(None).cast("array<array<string>>").alias("rows")),
    )
    none = lambda kind: F.lit(None).cast(kind)
    return b.select("document_id", "n", F.inline(kinds)).select(
        "document_id", F.concat("document_id", F.lit("/"), "k", F.col("n").cast("string")).alias("block_id"), "block_type", "content", F.concat("document_id", F.lit(".docx")).alias("source_file"), F.array().cast("array<string>").alias("section_path"),
        F.lit(1).alias("page"), none("string").alias("sheet_name"), none("string").alias("cell_range"), (3 * F.col("n") + F.col("at")).cast("int").alias("reading_order"), "rows", none("string").alias("derived_from"), none("array<string>").alias("source_ranges"), none("string").alias("image_type"), none("string").alias("numeric_repr"),
    )


_LINES = "l AS (SELECT CAST(l_orderkey AS VARCHAR) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n, l_partkey, l_suppkey, l_returnflag FROM lineitem)"
_NOTES = """r AS (SELECT t.d, t.n, array_agg('Line ' || x.n || ' by ' || x.l_returnflag || ' as Bảng ' || t.n ORDER BY x.n) AS notes FROM l t JOIN l x ON x.d = t.d AND greatest(1, x.n - 1) = t.n GROUP BY t.d, t.n)"""


@query(
    "graph_of_orders",
    f"""WITH {_LINES} SELECT d || '/t' || n AS source_id, d || '/c' || n AS target_id, 'captioned_by' AS relation_type FROM l
UNION ALL SELECT d || '/t' || greatest(1, n - 1), d || '/x' || n, 'referenced_by' FROM l
UNION ALL SELECT d || '/c' || n, d || '/t' || n, 'next_in_reading_order' FROM l UNION ALL SELECT d || '/t' || n, d || '/x' || n, 'next_in_reading_order' FROM l
UNION ALL SELECT a.d || '/x' || a.n, a.d || '/c' || b.n, 'next_in_reading_order' FROM l a JOIN l b ON a.d = b.d AND b.n = a.n + 1""",
)
def graph_of_orders(spark, sf_dir):
    """All relations of captioned and mentioned tables, over all lines."""
    edges, _ = graph.build(_orders(spark, sf_dir))
    return edges.select("source_id", "target_id", "relation_type")


@query(
    "chunks_of_orders",
    f"""WITH {_LINES}, {_NOTES}
SELECT d AS document_id, 2 * n - 2 AS ordinal, 'table' AS chunk_type, md5('Table title: Bảng ' || n || ': part ' || l_partkey || chr(10) || '| Part | Supplier |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || l_partkey || ' | ' || l_suppkey || ' |' || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || 'Referenced by: ' || array_to_string(notes, ' | ') END) AS content
FROM l LEFT JOIN r USING (d, n) UNION ALL SELECT d, 2 * n - 1, 'text', md5('Line ' || n || ' by ' || l_returnflag || ' as Bảng ' || greatest(1, n - 1)) FROM l""",
)
def chunks_of_orders(spark, sf_dir):
    """Their chunks in order, with whole contents."""
    _, full = graph.build(_orders(spark, sf_dir))
    c = chunking.chunk(full)
    return c.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_type", F.md5(F.col("content").cast("binary")).alias("content"))


@query(
    "related_of_orders",
    f"""WITH {_LINES}, e AS (
  SELECT d, 1 AS kind, 0 AS o, d || '/c1' AS block_id, '[RELATED CAPTION – caption, trang 1]' || chr(10) || 'Bảng 1: part ' || l_partkey AS rendered FROM l WHERE n = 1
  UNION ALL SELECT d, 2, n, d || '/x' || n, '[RELATED TEXT – đoạn văn tham chiếu, trang 1]' || chr(10) || 'Line ' || n || ' by ' || l_returnflag || ' as Bảng 1' FROM l WHERE n <= 2)
SELECT d AS query_id, block_id, row_number() OVER (PARTITION BY d ORDER BY kind, o) AS place, rendered FROM e""",
)
def related_of_orders(spark, sf_dir):
    """What belongs to the first table of each order, rendered."""
    blocks = _orders(spark, sf_dir)
    edges, _ = graph.build(blocks)
    # What is shown of a block is as it came, so the blocks with their captions and references need not be made.
    hits = blocks.where("block_id like '%/t1'").select(F.col("document_id").alias("query_id"), F.col("block_id").alias("chunk_id"), F.array("block_id").alias("block_ids"))
    r = context.related_blocks(hits, edges, blocks)
    return r.select("query_id", "block_id", F.col("place").cast("long").alias("place"), "rendered")
