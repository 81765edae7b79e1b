"""BM25 scores: what is shuffled, and what a task holds."""

import re

from pyspark.sql import functions as F

from docloom.operators import bm25
from docloom.plans import queries_search


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_made_in_bounded_tasks_where_postings_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(bm25, "SCORED", 1000, raising=False)
    index, q = queries_search._index(spark, sf), queries_search._questions(spark, sf)
    terms = q.select("query_id", F.explode(bm25.T.tokenize("query")).alias("term")).distinct()
    work = index.postings.join(terms, "term").count()
    allowed = spark.range(200).selectExpr("id AS chunk_id").crossJoin(q.select("query_id")).where("(chunk_id + query_id) % 3 = 0")
    every, some = bm25.scores(index, q), bm25.scores(index, q, allowed)
    for df in (every, some):
        assert not re.search(r"hashpartitioning\((query_id#\d+L?, chunk_id|chunk_id#\d+L?, query_id)", _plan(df))
    sizes = every.groupBy(F.spark_partition_id()).count().count()
    assert work > 5000 and sizes > work / 1000 / 2
    rows = lambda df: {(r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect()}
    assert rows(some) == {r for r in rows(every) if (r[0] + r[1]) % 3 == 0}


def test_build_counts_terms_where_texts_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(bm25, "INDEXED", 20_000, raising=False)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    queries_search._index(spark, sf)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsList().size())]
    assert not [p for p in plans if re.search(r"hashpartitioning\(term#\d+, chunk_id", p)]
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert texts > 100_000 and any(f", {texts // 20_000 + 1})" in p and "REPARTITION_BY_NUM" in p for p in plans)
