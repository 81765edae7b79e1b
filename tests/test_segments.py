"""The segmented index: equal to a build at once, whatever was added, deleted and merged."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, segments

WORDS = [f"w{i}" for i in range(60)] + ["a-b", "c/d.e"]


def texts(n, seed=0):
    r = random.Random(seed)
    common = lambda: WORDS[min(int(r.expovariate(0.15)), len(WORDS) - 1)]
    return [(f"d{i // 3}", f"c{i}", " ".join(common() for _ in range(r.randint(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, chunk_id string, text string")


def found(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in hits.collect())


QUERIES = [(1, "w0 w1 w2"), (2, "w40 w3 w3 a-b"), (3, "unknown"), (4, "w0 w1 w2 w3 w4 w5 w6 w30 w31"), (5, ""), (6, "w25")]


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def test_segments_equal_a_build_at_once(spark, tmp_path, queries):
    rows = texts(150)
    index = segments.SegmentedIndex(spark, str(tmp_path))
    assert index.search(queries, 5).count() == 0
    seen = set()
    for a in range(0, 150, 30):  # five additions
        index = index.add(frame(spark, rows[a : a + 30]), F.col("text"))
        seen |= set(index.paths())
    assert [x["chunks"] for x in index.state["segments"]] == [120, 30] and len(seen) == 5  # four became one
    dead = ["d3", "d4", "d20", "d49"]
    index = index.delete(frame(spark, [(d, "", "") for d in dead])).delete(frame(spark, [("no such", "", "")]))
    index = index.add(frame(spark, [("d3", "c10", "w0 w1 new w25"), ("d99", "c999", "w40")]), F.col("text"))  # an id comes back with another text
    live = [r for r in rows if r[0] not in dead] + [("d3", "c10", "w0 w1 new w25"), ("d99", "c999", "w40")]
    whole = bm25.build(frame(spark, live), "chunk_id", F.col("text"))
    assert index.chunks == len(live)
    weights = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.select("term", "df", "idf").collect())
    assert weights(index.weights()) == weights(whole.terms)
    want = found(bm25.search(whole, queries, 5))
    assert found(index.search(queries, 5)) == want and found(index.search(queries, 5, worth=0)) == want
    some = spark.createDataFrame([(i, f"c{c}") for i in (1, 4) for c in range(0, 150, 7)], "query_id long, chunk_id string")
    assert found(index.search(queries, 5, some)) == found(bm25.search(whole, queries, 5, some))
    again = segments.SegmentedIndex(spark, str(tmp_path), index.state)  # the state is all a reader needs
    assert found(again.search(queries, 5)) == want


def test_a_small_addition_writes_only_its_segment(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path)).add(frame(spark, texts(300)), F.col("text"))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    index = index.add(frame(spark, [("new", "n1", "w1 w2 w3")]), F.col("text")).delete(frame(spark, [("d7", "", "")]))
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert [s["chunks"] for s in index.state["segments"]] == [300, 1] and index.chunks == 298
    assert spark.read.parquet(f"{tmp_path}/{index.paths()[1]}/postings").count() == 3


def test_vectors_follow_their_chunks(spark, tmp_path):
    rows = texts(40)
    vec = lambda some: frame(spark, some).select("document_id", "chunk_id", F.array(F.length("text").cast("float")).alias("vector"))
    index = segments.SegmentedIndex(spark, str(tmp_path))
    for a in (0, 20):
        index = index.add(frame(spark, rows[a : a + 20]), F.col("text"), vec(rows[a : a + 20]))
    index = index.delete(frame(spark, [("d0", "", ""), ("d13", "", "")]))
    assert sorted(r.chunk_id for r in index.vectors().collect()) == sorted(r[1] for r in rows if r[0] not in ("d0", "d13"))
    index = index.delete(frame(spark, [(d, "", "") for d in {r[0] for r in rows} if int(d[1:]) < 5]))  # half of a segment: it is merged
    left = sum(int(r[0][1:]) >= 5 and r[0] != "d13" for r in rows)
    assert index.vectors().count() == index.chunks == left and sum(s["chunks"] for s in index.state["segments"]) < 40


def test_pruned_search_scores_fewer_postings(spark, tmp_path):
    """Rare words with one very common: the common word's postings make no candidates."""
    r = random.Random(4)
    rows = [(f"d{i}", f"c{i}", "the " * r.randint(1, 3) + " ".join(f"x{r.randint(0, 400)}" for _ in range(20)) + (" odd strange" if i % 40 == 0 else "")) for i in range(800)]
    index = segments.SegmentedIndex(spark, str(tmp_path)).add(frame(spark, rows), F.col("text"))
    q = spark.createDataFrame([(1, "the odd strange"), (2, "the")], "query_id long, query string")
    weighted = q.select("query_id", F.explode(F.split("query", " ")).alias("term")).join(index.weights(), "term").select("query_id", "term", F.col("idf").alias("w"), "df")
    plan = {(p.query_id, p.term): p for p in index.plan(weighted, 5).collect()}
    assert plan[1, "the"].pruned and not plan[1, "the"].essential and plan[1, "odd"].essential and not plan[2, "the"].pruned
    assert sum(p.df for (i, _), p in plan.items() if i == 1 and p.essential) * 10 < sum(p.df for (i, _), p in plan.items() if i == 1)
    assert found(index.search(q, 5, worth=0)) == found(index.search(q, 5))
