"""Queries take all rows of their tables: plain Python on the smallest tables and on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.splitters import split_segments_py
from docloom.operators import dense, retrieval
from docloom.plans import catalog
from docloom.streaming.correction import PREVIOUS_CHARS, SEGMENT_CHARS, tail_py
from tests.conftest import SF


TURNS = [
    ("a", 0, "Die Straße ist lang. " * 90),
    ("a", 1, ""),
    ("a", 3, "Word after word, number 42. " * 60),
    ("a", 4, "short"),
    ("b", 2, "x" * 501 + " ß."),
    ("b", 5, "end 7"),
]


def upper(text):
    """Upper case, segment by segment; an empty segment stays."""
    return "".join(s.upper() for s in split_segments_py(text, SEGMENT_CHARS))


@pytest.mark.parametrize("fixture", [True, False])
def test_all_turns_are_corrected(spark, tmp_path, fixture):
    folder = SF
    if fixture:
        folder = f"file://{tmp_path}"
        spark.createDataFrame(TURNS, "conv_id string, turn long, text string").write.parquet(f"{folder}/conversations.parquet")
    turns: dict[str, list] = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns.setdefault(str(r.conv_id), []).append((r.turn, r.text or ""))
    assert any(len(t) > SEGMENT_CHARS for x in turns.values() for _, t in x)
    want = set()
    for conv, x in turns.items():
        previous = ""
        for i, (_, t) in enumerate(sorted(x)):
            assert upper(t) == t.upper()
            want.add((conv, i, t.upper(), previous))
            previous = tail_py(t.upper(), PREVIOUS_CHARS)
    got = catalog.queries()["stream_ordered_correction"](spark, folder).collect()
    assert len(got) == len(want) and {(r.document_id, r["index"], r["content"], r.previous_upper) for r in got} == want


def test_interval_overlap_of_all_rows(spark):
    span: dict[tuple, list] = {}
    rows: dict[tuple, int] = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey").collect():
        key = r.l_suppkey, r.l_linenumber
        span.setdefault(key, []).append(r.l_orderkey)
        rows[key] = min(rows.get(key, r.l_partkey), r.l_partkey)
    want = {(s, n, m) for s, n in span for t, m in span if s == t and min(span[t, m]) <= rows[s, n] <= max(span[t, m])}
    got = catalog.queries()["interval_overlap"](spark, SF).collect()
    assert len(got) == len(want) and {(r.l_suppkey, r.chart, r.source) for r in got} == want


def test_outside_tables_of_all_rows(spark):
    boxes: dict[tuple, list] = {}
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    box = lambda r: (float(r.l_quantity), float(r.l_quantity) + 4, float(r.l_discount) * 100, float(r.l_discount) * 100 + 2)
    for r in rows:
        if r.l_returnflag == "R":
            boxes.setdefault((r.l_partkey, r.l_linenumber), []).append(box(r))

    def inside(r):
        a, b, c, d = box(r)
        x, y = (a + b) / 2, (c + d) / 2
        return any(x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2 for x0, x1, y0, y1 in boxes.get((r.l_partkey, r.l_linenumber), []))

    asked = [r for r in rows if r.l_returnflag == "N"]
    want = sorted((r.l_orderkey, r.l_linenumber) for r in asked if not inside(r))
    assert max(r.l_orderkey for r in rows) > 600 and len(want) < len(asked)
    assert sorted((r.l_orderkey, r.page) for r in catalog.queries()["outside_tables"](spark, SF).collect()) == want


def test_dense_search_in_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    rows = {r.chunk_id: np.array(r.vector, float) / np.linalg.norm(r.vector) for r in e.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got: dict[int, list] = {}
    for r in dense.search(e.repartition(3), e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert sorted(got) == [i for i in ids if i % 20 == 0] and len(got) > 7
    for q, found in got.items():
        assert found == ids[np.argsort(-(x @ rows[q]).round(12), kind="stable")[:10]].tolist()
    none = e.limit(0).withColumnRenamed("chunk_id", "query_id")
    assert dense.search(e, none, 10).count() == 0


@pytest.mark.parametrize("name", ["dense_topk", "dense_filtered"])
def test_dense_queries(spark, name):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert catalog.queries()[name](spark, SF).select("query_id").distinct().count() == asked


def test_long_names_match(spark):
    name = "uy ban nhan dan thanh pho ho chi minh quan nhat"
    e = spark.createDataFrame([("d", name.title(), name), ("d", "An Binh", "an binh")], "document_id string, canonical string, norm_key string")
    q = spark.createDataFrame([(1, f"Theo {name.title()} va An Binh"), (2, "An")], "query_id long, query string")
    assert {(r.query_id, r.norm_key) for r in retrieval.match_entities(q, e).collect()} == {(1, name), (1, "an binh")}
    assert retrieval.match_entities(q, e.limit(0)).count() == 0
