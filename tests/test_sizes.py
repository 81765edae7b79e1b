"""What steps hold and deal out: no more copies, and no larger batches, than they need."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import splitters
from docloom.operators import chunking, context, dense, graph, profile, segments
from docloom.plans import catalog, fixtures, queries_text
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_not_copied_for_few_queries(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 4))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "chunk_id long, vector array<double>").repartition(4)
    hits = dense.search(v, v.withColumnRenamed("chunk_id", "query_id"), 3, block=16, vector_block=1000)
    assert "explode([0,1,2,3" not in _plan(hits)  # a copy for each 16 queries
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u @ u.T).round(12), axis=1, kind="stable")[:, :3]
    got = {(r.query_id, r["rank"]): r.chunk_id for r in hits.collect()}
    assert got == {(i, k + 1): int(j) for i, row in enumerate(want) for k, j in enumerate(row)}


def test_texts_are_split_few_at_a_time(spark):
    run = splitters._each(lambda t: [t]).func
    out = list(run(iter([pa.array(["x" * 400_000, None, "y"] * 400)])))
    assert sum(map(len, out)) == 1200 and max(map(len, out)) <= 9
    assert len(list(run(iter([pa.array([""] * 1000)])))) == 4


def test_pairs_of_words_are_counted_where_their_texts_are(spark):
    b = spark.createDataFrame([("d", "trời mưa ướt trời mưa ướt"), ("d", "trời mưa"), ("e", "x y")], "document_id string, content string").repartition(2)
    found = profile.bigrams(b, least=2)
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert [(r.document_id, r.term, r.n) for r in found.orderBy("rank").collect()] == [("d", "trời mưa", 3), ("d", "mưa ướt", 2)]


def test_lines_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(queries_text, "LINES", 100)
    lines = queries_text.by_order(spark, SF)
    assert lines.rdd.getNumPartitions() == -(-lines.count() // 100)


def test_related_blocks_read_edges_once(spark):
    edges = spark.createDataFrame([("t", "c", "captioned_by", "d"), ("t", "x", "referenced_by", "d"), ("y", "t", "continues", "d")], "source_id string, target_id string, relation_type string, document_id string")
    blocks = spark.createDataFrame([("d", b, "text", b, i) for i, b in enumerate("tcxy")], "document_id string, block_id string, block_type string, content string, reading_order int")
    blocks = blocks.selectExpr("*", "1 as page", "cast(null as string) as sheet_name", "cast(null as string) as cell_range")
    hits = spark.createDataFrame([(1, "k", ["t"])], "query_id long, chunk_id string, block_ids array<string>")
    found = context.related_blocks(hits, edges, blocks)
    assert _plan(found).count("Scan ExistingRDD[source_id") == 1
    assert [(r.place, r.block_id) for r in found.orderBy("place").collect()] == [(1, "c"), (2, "x"), (3, "y")]


def test_blocks_of_filled_chunks_stay_where_they_are(spark, monkeypatch):
    saved, made = scratch.saved, []
    monkeypatch.setattr(scratch, "saved", lambda df, what: made.append(what) or saved(df, what))
    catalog.queries()["filled_chunks"](spark, SF)
    assert not made


def test_scores_of_live_chunks_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(i, i, f"a b{i % 3}") for i in range(60)], "document_id long, chunk_id long, text string")
    index = segments.SegmentedIndex(spark, scratch.path(spark, "index")).add(chunks, F.col("text")).delete(chunks.where("document_id < 7"))
    q = scratch.saved(spark.createDataFrame([(1, "b1", 1.0, 20), (2, "b2", 1.0, 20)], "query_id long, term string, w double, df long"), "q")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = index._scores(q)
        assert "hashpartitioning(seg" not in _plan(found)
        assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(k, i) for i in range(7, 60) for k in (1, 2) if i % 3 == k}
    finally:
        spark.conf.set(key, before)


def test_claims_are_not_written_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "coalesce", None)
    assert catalog.queries()["upload_claims"](spark, SF).count() > 0


def test_chunks_are_made_in_one_pass_over_blocks_in_order(spark):
    p = _plan(catalog.queries()["chunks_of_orders"](spark, SF))
    assert p.count("MapInArrow") == 1 and p.count("ArrowEvalPython") == 1  # the second: choice of captions
    assert "posexplode" not in p


def test_runs_go_on_over_batches(spark):
    """Runs of several blocks, long texts, empty ones, tables and visuals; two rows a batch."""
    blank = dict.fromkeys(f.name for f in spark.createDataFrame([], fixtures.BLOCK_SCHEMA).schema.fields)
    texts = ["a", " b ", "", "c" * 30, "word " * 20, "d", None, "TABLE", "e", "f" * 25, "g" * 25, " \u3000", "IMAGE " * 12, "IMAGE", "h"]
    rows = []
    for d in ("x", "y"):
        for i, text in enumerate(texts):
            kind = "table" if text == "TABLE" else "image" if text and text.startswith("IMAGE") else "text"
            rows.append(blank | {"document_id": d, "block_id": f"{d}{i:02}", "block_type": kind, "content": text, "source_file": d, "section_path": [], "page": i // 20, "reading_order": i, "rows": [["a|b", "c  d\n"], ["1"]] if kind == "table" else None})
    _, full = graph.build(spark.createDataFrame([tuple(r.values()) for r in rows], fixtures.BLOCK_SCHEMA))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    try:
        chunks = chunking.chunk(full, text_chars=40, visual_chars=50).orderBy("document_id", "ordinal").collect()
    finally:
        spark.conf.set(key, before)
    want = [("a\n\n b\n\n" + "c" * 30, [0, 1, 2, 3]), *((p, [4]) for p in splitters.split_text_py(texts[4], 40)), ("d", [5, 6]), ("| a\\|b | c d |\n| --- | --- |\n| 1 |  |", [7])]
    want += [("e\n\n" + "f" * 25, [8, 9]), ("g" * 25, [10, 11])]
    shown = [(r.content, [int(b[1:]) for b in r.block_ids]) for r in chunks if r.document_id == "x"]
    assert shown[: len(want)] == want and sorted({b for _, ids in shown[len(want) :] for b in ids}) == [12, 13, 14]
    assert [r.ordinal for r in chunks if r.document_id == "y"] == list(range(len(shown)))
    assert [r.chunk_type for r in chunks].index("table") == [b for _, b in want].index([7]) and (chunks[0].page_start, chunks[0].page_end) == (0, 0)


def test_blocks_and_texts_of_contexts_are_not_kept_and_dealt_again(spark, monkeypatch):
    saved, made = scratch.saved, []
    monkeypatch.setattr(scratch, "saved", lambda df, what: made.append(what) or saved(df, what))
    p = _plan(catalog.queries()["budgeted_contexts"](spark, SF))
    assert "lines" not in made and "collect_list(struct(ordinal" not in p
    assert "LeftOuter" not in p  # hits beside their related blocks and tables


def test_related_blocks_and_tables_stand_beside_their_hits(spark):
    kinds = "document_id string, source_file string, section_path array<string>, sheet_name string, cell_range string, chunk_type string, content string, block_ids array<string>, page_start int, page_end int, table_file string, ordinal int, chunk_id string"
    chunks = spark.createDataFrame([("d", "f", [], None, None, "table", "preview", ["t"], 1, 1, "t.xlsx", 0, "k"), ("d", "f", [], None, None, "text", "text", ["x"], 2, 2, None, 1, "m")], kinds)
    blocks = spark.createDataFrame([("d", "t", "table", "c", 1, [["a"], ["1"]]), ("d", "c", "caption", "named", 0, None), ("d", "x", "text", "text", 2, None)], "document_id string, block_id string, block_type string, content string, reading_order int, rows array<array<string>>")
    blocks = blocks.selectExpr("*", "1 as page", "cast(null as string) as sheet_name", "cast(null as string) as cell_range")
    edges = spark.createDataFrame([("t", "c", "captioned_by", "d")], "source_id string, target_id string, relation_type string, document_id string")
    hits = spark.createDataFrame([(q, k, r) for q in (1, 2) for r, k in enumerate("km")], "query_id long, chunk_id string, rank int")
    for n in (0, 1):
        found = context.expand(hits.where("query_id = 1 or chunk_id = 'k'"), chunks, edges, blocks, neighbours=n).orderBy("query_id", "source_id").collect()
        table = "| a |\n| --- |\n| 1 |\n\n[RELATED CAPTION – caption, trang 1]\nnamed"
        assert [(r.query_id, r.chunk_id, r.content) for r in found] == [(1, "k", table), (1, "m", "text"), (2, "k", table)]
