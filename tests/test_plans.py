"""Plans stay as they should: filters and columns reach the scan, no row-at-a-time Python, no nested loops over tables."""

import re

import pytest

from docloom.operators import graph
from docloom.plans import catalog
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.queries()["point_lookup"](spark, SF))
    assert "EqualTo(doc_id,42)" in p and re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,source:string>", p)
    p = plan(catalog.queries()["filtered_search"](spark, SF))
    assert "In(lang" in p and "EqualTo(source,src1)" in p
    p = plan(catalog.queries()["table_counts"](spark, SF))
    assert "ReadSchema: struct<>" in p


@pytest.mark.parametrize("name", ["tokenize_counts", "normalize_text", "mask_pii", "html_text", "extract_numbers", "format_number", "unsupported_numbers"])
def test_text_functions_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|ArrowEval", plan(catalog.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", ["next_in_order", "section_asof", "gaps_islands_runs", "neighbor_chunks", "interval_overlap", "embedding_cache_misses", "dedupe_versions", "delete_cascade", "entity_match"])
def test_joins_by_key(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_related_edges_need_no_nested_loop(spark):
    e = spark.createDataFrame([("a", "b", "continues", "d")], "source_id string, target_id string, relation_type string, document_id string")
    p = plan(graph.related(e, spark.createDataFrame([("a",)], "block_id string"), ["continues"]))
    assert "NestedLoop" not in p


def test_top_k_is_cut_before_the_shuffle(spark):
    p = plan(catalog.queries()["bm25_topk"](spark, SF))
    assert "WindowGroupLimit" in p


def test_blocks_dealt_by_document_are_not_dealt_again(spark):
    """One exchange of the lines for the blocks, one for their captions, one of finished chunks for their ordinals."""
    assert plan(catalog.queries()["chunks_of_orders"](spark, SF)).count("Exchange hashpartitioning") == 3


def test_derivations_stand_beside_their_origin(spark):
    p = plan(catalog.queries()["derived_lines"](spark, SF))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_contexts_of_many_queries_go_through_a_task_at_once(spark):
    p = plan(catalog.queries()["budgeted_contexts"](spark, SF))
    assert "MapInArrow" in p and "FlatMapGroups" not in p
