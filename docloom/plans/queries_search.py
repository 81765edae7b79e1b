"""Queries of search: BM25, dense vectors, fusion, filters, boosts, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T
from docloom.operators import bm25, context, dense, graph, profile, retrieval, segments
from docloom.plans.queries_text import read, values_sql
from docloom.plans.registry import query

_TOKENS = r"""t0 AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[-/.][\p{L}\p{N}_]+)*')) AS token FROM documents
), tokens AS MATERIALIZED (
  SELECT doc_id, x AS term FROM (SELECT doc_id, token AS x FROM t0
  UNION ALL SELECT doc_id, regexp_replace(token, '[-/.]', '', 'g') FROM t0 WHERE regexp_matches(token, '[-/.]')
  UNION ALL SELECT doc_id, unnest(string_split_regex(token, '[-/.]')) FROM t0 WHERE regexp_matches(token, '[-/.]')) WHERE x <> ''
), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
dl AS MATERIALIZED (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS dl FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id) USING (doc_id)),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
least AS MATERIALIZED (SELECT 0.25 * avg(raw) AS least FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN least ELSE raw END AS idf FROM raw, least),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[-/.][\p{L}\p{N}_]+)*')) AS term FROM benchmark),
q2 AS MATERIALIZED (SELECT query_id, x AS term, count(*) AS qtf FROM (SELECT query_id, term AS x FROM q
  UNION ALL SELECT query_id, regexp_replace(term, '[-/.]', '', 'g') FROM q WHERE regexp_matches(term, '[-/.]')
  UNION ALL SELECT query_id, unnest(string_split_regex(term, '[-/.]')) FROM q WHERE regexp_matches(term, '[-/.]')) WHERE x <> '' GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q2 JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL)"""


def _index(spark, sf_dir):
    return bm25.build(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "bm25_topk",
    f"WITH {_TOKENS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10",
)
def bm25_topk(spark, sf_dir):
    hits = bm25.search(_index(spark, sf_dir), _questions(spark, sf_dir), 10)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "bm25_segments",
    f"WITH {_TOKENS.replace('documents', '(SELECT * FROM documents WHERE doc_id % 7 <> 3)')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10",
)
def bm25_segments(spark, sf_dir):
    """An index that grew by sources, of which every seventh document has been deleted
    since: as a build of what is left."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text", "source")
    late = F.col("source").isin("src1", "src2")
    index = segments.SegmentedIndex(spark, scratch.path(spark, "index")).add(d.where(F.coalesce(~late, F.lit(True))), F.col("text")).add(d.where(late), F.col("text"))
    hits = index.delete(d.where("document_id % 7 = 3")).search(_questions(spark, sf_dir), 10)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "dense_grid",
    """SELECT query_id, vec_id, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.label <> 4) WHERE rank <= 5""",
)
def dense_grid(spark, sf_dir):
    """Queries and vectors both dealt into blocks."""
    e = read(spark, sf_dir, "embeddings")
    v = e.where("label <> 4").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    hits = dense.search(v, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, block=16, vector_block=16_384)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query("bm25_idf", f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_filtered",
    f"WITH {_TOKENS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM scores s JOIN documents d USING (doc_id) WHERE score > 0 AND lang IN ('fr', 'de') AND source = 'src3') WHERE rank <= 10",
)
def bm25_filtered(spark, sf_dir):
    """Filters are applied before scoring, as a semi-join of the postings."""
    keep = retrieval.filter_chunks(read(spark, sf_dir, "documents"), {"lang": ["fr", "de"], "source": "src3"}).select(F.col("doc_id").alias("chunk_id"))
    index = _index(spark, sf_dir)
    index = bm25.Bm25Index(index.postings.join(keep, "chunk_id", "left_semi"), index.terms, index.lengths, index.corpus)
    hits = bm25.search(index, _questions(spark, sf_dir), 10)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "dense_topk",
    """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
)
def dense_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    hits = dense.search(v, v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "dense_filtered",
    """SELECT query_id, vec_id, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.label IN (1, 3)) WHERE rank <= 5""",
)
def dense_filtered(spark, sf_dir):
    """The filter reaches the scan, before any distance is computed."""
    e = read(spark, sf_dir, "embeddings")
    v = retrieval.filter_chunks(e, {"label": [1, 3]}).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    hits = dense.search(v, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


_RRF = """r AS (
  SELECT query_id, 'sparse' AS kind, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0
), dense_like AS (
  SELECT item_id AS query_id, 'dense' AS kind, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY abs(d.n_chars - length(b.text)), doc_id) AS rank FROM benchmark b, documents d
), fused AS (
  SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(CASE WHEN kind = 'dense' THEN rank END) AS dense_rank, min(CASE WHEN kind = 'sparse' THEN rank END) AS sparse_rank
  FROM (SELECT * FROM r WHERE rank <= 30 UNION ALL SELECT * FROM dense_like WHERE rank <= 30) GROUP BY ALL)"""


def _rankings(spark, sf_dir):
    """BM25, and as second ranking the nearness of lengths (the small tables hold no vectors of documents)."""
    sparse = bm25.search(_index(spark, sf_dir), _questions(spark, sf_dir), 30).select("query_id", F.lit("sparse").alias("kind"), "chunk_id", "rank")
    q = _questions(spark, sf_dir).select("query_id", F.length("query").alias("n"))
    near = F.abs(F.col("n_chars") - F.col("n"))
    # Documents of equal length tie for every query, so only the least 30 ids of each length can be among the best.
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("n_chars").orderBy("chunk_id"))).where("at <= 30").drop("at")
    d = scratch.saved(d, "near")
    d = d.repartition(d.count() * q.count() // bm25.SCORED + 1, "chunk_id").join(F.broadcast(q), how="cross")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(near, "chunk_id"))).where("rank <= 30").select("query_id", F.lit("dense").alias("kind"), "chunk_id", "rank")
    return sparse.unionByName(d)


@query(
    "rrf_fusion",
    f"WITH {_TOKENS}, {_RRF} SELECT query_id, doc_id, round(rrf, 9) AS rrf, dense_rank, sparse_rank, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS fused_rank FROM fused) WHERE fused_rank <= 24",
)
def rrf_fusion(spark, sf_dir):
    f = retrieval.fuse(_rankings(spark, sf_dir))
    return f.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("rrf_score", 9).alias("rrf"), *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "sparse_rank", "fused_rank")])


@query(
    "entity_boost",
    f"""WITH {_TOKENS}, r AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0
), b AS (
  SELECT query_id, s.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM scores s JOIN documents d USING (doc_id) WHERE score > 0 AND source = 'src' || (query_id % 20)
), fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM r WHERE rank <= 30 UNION ALL SELECT * FROM b WHERE rank <= 30) GROUP BY ALL)
SELECT query_id, doc_id, round(rrf, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS k FROM fused) WHERE k <= 24""",
)
def entity_boost(spark, sf_dir):
    """A second ranking within the documents that a query is about (here: of one source), fused softly with the first."""
    index, q = _index(spark, sf_dir), _questions(spark, sf_dir)
    about = q.withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "source").select("query_id", "chunk_id")
    rank = lambda allowed: bm25.search(index, q, 30, allowed).select("query_id", F.lit("sparse").alias("kind"), "chunk_id", "rank")
    f = retrieval.fuse(rank(None).unionByName(rank(about)))
    return f.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("rrf_score", 9).alias("rrf"))


@query("filtered_search", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1')")
def filtered_search(spark, sf_dir):
    return retrieval.filter_chunks(read(spark, sf_dir, "documents"), {"lang": ["en", "fr"], "source": "src1", "text": ""}).select("doc_id", "lang", "source")


ENTITIES = [("d1", "Nguyễn Văn An", "nguyen van an"), ("d1", "Hà Nội", "ha noi"), ("d2", "Visa Platinum", "visa platinum"), ("d3", "An", "an")]
ENTITY_QUERIES = [(1, "Ông Nguyễn Văn  An ký ngày nào?"), (2, "thẻ visa PLATINUM ở Hà Nội"), (3, "visa"), (4, "a")]


@query("entity_match", values_sql([(1, "d1", "Nguyễn Văn An"), (1, "d3", "An"), (2, "d1", "Hà Nội"), (2, "d2", "Visa Platinum")], ["query_id", "document_id", "canonical"]))
def entity_match(spark, sf_dir):
    e = spark.createDataFrame(ENTITIES, "document_id string, canonical string, norm_key string")
    return retrieval.match_entities(spark.createDataFrame([(i, q.replace("?", " ?")) for i, q in ENTITY_QUERIES], "query_id long, query string"), e).select("query_id", "document_id", "canonical")


@query("query_variants", values_sql([(1, 0, "q"), (1, 1, "v"), (2, 0, "only")], ["query_id", "pos", "variant"]))
def query_variants(spark, sf_dir):
    df = spark.createDataFrame([(1, "q", ["", "q", "v", "v"]), (2, "only", [])], "query_id long, query string, others array<string>")
    return df.select("query_id", F.posexplode(retrieval.variants(F.col("query"), F.col("others"))).alias("pos", "variant")).select("query_id", F.col("pos").cast("long").alias("pos"), "variant")


@query("sanitize_plan", values_sql([(1, "phí VG-01 năm", "bieu_phi.xlsx", None, "table")], ["query_id", "first_variant", "source_file", "sheet_name", "chunk_type"]))
def sanitize_plan(spark, sf_dir):
    row = (1, "Bảng phí thẻ VG-01 trong bieu_phi", ["phí thẻ", "phí VG-01 năm"], " ", "bieu_phi.xlsx", "Sheet9", "table", ["bieu_phi.xlsx"], ["Sheet1"])
    df = spark.createDataFrame([row], "query_id long, query string, semantic_queries array<string>, keyword_query string, source_file string, sheet_name string, content_type string, known_files array<string>, known_sheets array<string>")
    return retrieval.sanitize_plan(df).select("query_id", F.col("semantic_queries")[0].alias("first_variant"), "source_file", "sheet_name", "chunk_type")


@query(
    "confidence_gate",
    """SELECT o_custkey % 50 AS query_id, CASE WHEN max(o_totalprice) / 500000 < 0.75 THEN 'low' ELSE 'ok' END AS gate FROM orders GROUP BY ALL""",
)
def confidence_gate(spark, sf_dir):
    h = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") / 500000).alias("rerank_score"), F.lit(0.01).alias("rrf_score"))
    return retrieval.confidence(h, min_rerank=0.75).select("query_id", F.when(F.startswith("reason", F.lit("low_rerank")), "low").otherwise(F.col("reason")).alias("gate"))


@query(
    "rerank_topk",
    f"""WITH {_TOKENS}, h AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0),
c AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS rrf FROM h WHERE rank <= 12),
w AS (SELECT c.query_id, c.doc_id, rrf, (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(b.text), '[^ \\t\\n\\r]+')) AS x) u WHERE list_contains(regexp_extract_all(lower(d.text), '[^ \\t\\n\\r]+'), x))
   / (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(lower(b.text), '[^ \\t\\n\\r]+')) AS x))::DOUBLE AS s FROM c JOIN benchmark b ON b.item_id = c.query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, round(s, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, round(rrf, 12) DESC, doc_id) AS rank FROM w) WHERE rank <= 7""",
)
def rerank_topk(spark, sf_dir):
    q = _questions(spark, sf_dir)
    hits = bm25.search(_index(spark, sf_dir), q, 12).withColumn("rrf_score", 1.0 / (60 + F.col("rank"))).drop("rank", "score")
    hits = hits.join(q, "query_id").join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return retrieval.rerank(hits).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query(
    "late_lookup",
    f"WITH {_TOKENS} SELECT query_id, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0) JOIN documents USING (doc_id) WHERE rank <= 3 AND doc_id % 7 <> 0",
)
def late_lookup(spark, sf_dir):
    """Fused ids to their rows; ids without a row drop out."""
    hits = bm25.search(_index(spark, sf_dir), _questions(spark, sf_dir), 3)
    there = read(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"), "lang", "n_chars")
    return retrieval.look_up(hits, there).select("query_id", F.col("chunk_id").alias("doc_id"), "lang", "n_chars")


@query(
    "prompt_budget_cut",
    """SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 28000""",
)
def prompt_budget_cut(spark, sf_dir):
    items = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    return context.prompt_budget(items).select(F.col("query_id").alias("source"), F.col("position").alias("doc_id"))


CITATIONS = [
    ("f.xlsx", "S1", "A1:B2", None, None, [], '[f.xlsx, sheet "S1", vùng A1:B2]'), ("f.xlsx", "S1", None, None, None, [], '[f.xlsx, sheet "S1"]'), ("f.pdf", None, None, 3, 3, ["A"], "[f.pdf, trang 3]"),
    ("f.pdf", None, None, 3, 5, [], "[f.pdf, trang 3-5]"), ("f.docx", None, None, None, None, ["A", "B"], '[f.docx, mục "A > B"]'), ("f.txt", None, None, None, None, [], "[f.txt]"),
]


@query("citations", values_sql([(i, c[-1]) for i, c in enumerate(CITATIONS)], ["i", "citation"]))
def citations(spark, sf_dir):
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(CITATIONS)], "i long, source_file string, sheet_name string, cell_range string, page_start int, page_end int, section_path array<string>")
    return df.select("i", context.citation().alias("citation"))


@query("answer_sources", values_sql([(1, 2, 1, False), (2, 0, 0, True), (3, 1, 0, True)], ["query_id", "n_valid", "n_invalid", "citation_valid"]))
def answer_sources(spark, sf_dir):
    known = {"SOURCE_1": "[a]", "SOURCE_2": "[b]"}
    rows = [(1, "x [SOURCE_2] y [SOURCE_9]", ["SOURCE_1"], known), (2, "Tôi không tìm thấy đủ thông tin trong tài liệu được cung cấp.", [], known), (3, "z [SOURCE_1]", ["SOURCE_1"], known)]
    a = context.answer_sources(spark.createDataFrame(rows, "query_id long, answer string, declared array<string>, known map<string,string>"))
    return a.select("query_id", F.size("source_ids").cast("long").alias("n_valid"), F.size("invalid_source_ids").cast("long").alias("n_invalid"), "citation_valid")


@query(
    "neighbor_chunks",
    """WITH c AS (SELECT conv_id, turn, conv_id || '/' || turn AS chunk_id, conv_id % 3 AS section FROM conversations)
SELECT a.chunk_id AS hit_id, b.chunk_id FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.section = b.section AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn WHERE a.turn % 2 = 0""",
)
def neighbor_chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.array((F.col("conv_id") % 3).cast("string")).alias("section_path"),
        F.col("turn").cast("int").alias("ordinal"), F.lit("text").alias("chunk_type"),
    )
    return graph.neighbours(c, c.where("ordinal % 2 = 0")).select("hit_id", "chunk_id")


@query(
    "embedding_cache_misses",
    """SELECT d.doc_id FROM documents d WHERE sha1('hash@default|' || d.text) NOT IN (SELECT sha1('hash@default|' || text) FROM documents WHERE doc_id % 3 = 0)""",
)
def embedding_cache_misses(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", dense.cache_key(F.col("text"), "hash").alias("cache_key"))
    return dense.cache_misses(d, d.where("doc_id % 3 = 0").select("cache_key")).select("doc_id")


@query(
    "entity_ledger",
    """SELECT CAST(d AS VARCHAR) AS document_id, lower(k) AS key, CAST(sum(n) AS BIGINT) AS count, count(*) - 1 AS n_aliases FROM (
  SELECT d, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Group' AS k, CASE WHEN c_custkey % 4 = 0 THEN 'e' ELSE 'é' END AS spell, count(*) AS n
  FROM (SELECT c_nationkey AS d, c_mktsegment, c_custkey FROM customer) GROUP BY ALL) GROUP BY ALL""",
)
def entity_ledger(spark, sf_dir):
    """Two spellings of each segment's name, with and without a mark, count as one name."""
    name = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" Group"))
    marked = F.when(F.col("c_custkey") % 4 == 0, name).otherwise(F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" Gróup")))
    texts = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), F.concat(F.lit("theo "), marked, F.lit(", và hơn")).alias("content"))
    e = profile.ledger(texts)
    return e.select("document_id", "key", "count", F.size("aliases").cast("long").alias("n_aliases"))


@query(
    "keyword_bigrams",
    r"""WITH w0 AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS ws FROM documents)),
w AS (SELECT doc_id, lower(x) AS x, lower(lead(x) OVER (PARTITION BY doc_id ORDER BY i)) AS y FROM w0),
c AS (SELECT doc_id, x || ' ' || y AS term, count(*) AS n FROM w WHERE length(x) > 1 AND length(y) > 1 AND x NOT IN ("""
    + ", ".join(f"'{w}'" for w in profile.STOPWORDS)
    + ") AND y NOT IN ("
    + ", ".join(f"'{w}'" for w in profile.STOPWORDS)
    + """) GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 12""",
)
def keyword_bigrams(spark, sf_dir):
    b = profile.bigrams(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")))
    return b.select(F.col("document_id").alias("doc_id"), "term", "n", F.col("rank").cast("long").alias("rank"))


@query(
    "entity_terms",
    """WITH n AS (SELECT n_regionkey, n_name AS canonical, lower(n_name) AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 2)
SELECT n_regionkey AS document_id, canonical, rank FROM (SELECT *, row_number() OVER w AS rank, sum(length(canonical) + 2) OVER w AS used FROM n WINDOW w AS (PARTITION BY n_regionkey ORDER BY n DESC, key)) WHERE rank <= 4 AND used <= 30""",
)
def entity_terms(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("document_id"), F.lower("n_name").alias("key"), F.col("n_name").alias("canonical")).agg(F.count(F.lit(1)).alias("count"))
    return profile.terms(c, 2, 4, 30).select("document_id", "canonical", F.col("rank").cast("long").alias("rank"))
