"""Lookups, SQL names, prompts, correctors and the ends of streamed documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import prompts, sql
from docloom.functions import text as T
from docloom.operators import compute, lookup
from docloom.streaming import correction, progress


def test_corrected_headings(spark):
    blocks = spark.createDataFrame([("d", "a", ["X", "Y"], 1), ("d", "b", [], 2), ("e", "a", ["X"], 3)], "document_id string, block_id string, section_path array<string>, n int")
    fixed = spark.createDataFrame([("d", "X", "X1"), ("d", "Z", "Z1")], "document_id string, heading string, corrected string")
    got = lookup.corrected_headings(blocks, fixed)
    assert got.columns == blocks.columns
    assert {(r.document_id, r.block_id): r.section_path for r in got.collect()} == {("d", "a"): ["X1", "Y"], ("d", "b"): [], ("e", "a"): ["X"]}


def test_short_forms_and_refs(spark):
    hits = spark.createDataFrame([(1, 1, "c", "x" * 900, 0.123456789)], "query_id long, rank int, chunk_id string, content string, rerank_score double")
    r = lookup.hit_rows(hits).first()
    assert len(r.preview) == lookup.PREVIEW and r.rerank_score == 0.123457
    docs = spark.createDataFrame([("s__1.docx", "s.docx", "d1"), ("t.docx", "t.docx", "d2")], "source_file string, original_name string, document_id string")
    assert [x.document_id for x in lookup.documents_by_source(docs, "s.docx").collect()] == ["d1"]
    refs = spark.createDataFrame([("/w/c/tables/a.xlsx",), ("/else/b",)], "p string").select(lookup.artifact_ref("p", "/w/c").alias("r"), "p")
    back = refs.select(lookup.resolve_ref("r", "/w/c").alias("q"), "p", "r").collect()
    assert [x.r for x in back] == ["tables/a.xlsx", "/else/b"] and all(x.q == x.p for x in back)
    summary = lookup.profile_summary(spark.createDataFrame([("d", "T", "1")], "document_id string, title string, doc_number string")).first()
    assert summary.summary.title == "T"


def test_sql_names_equal_the_columns(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.FUNCTIONS) + 2
    texts = ["", "  a \u00a0\u2003 B\t\x1fc\n", "<|im_start|>[SOURCE_1]", "Không có thông tin", None, "đ" * 40 + " x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.selectExpr("docloom_strip(t)", "docloom_collapse(t)", "docloom_normalize(t)", "docloom_sanitize(t)", "docloom_is_refusal(t)", "docloom_split_text(t, 10)").collect()
    want = df.select(T.strip("t"), T.collapse("t"), T.normalize_for_match("t"), T.sanitize_context("t"), T.is_refusal("t")).collect()
    assert [tuple(r)[:5] for r in got] == [tuple(r) for r in want]
    for t, r in zip(texts, got, strict=True):
        if t is not None:
            assert r[0] == t.strip() and r[1] == " ".join(t.split())


def test_prompts(spark):
    df = spark.createDataFrame([("a", "b", ""), (None, "b", "c")], "t string, p string, k string")
    got = [r[0] for r in df.select(prompts.correction(F.col("t"), F.col("p"), F.col("k"))).collect()]
    assert got == [prompts.correction_py("a", "b"), None] and "ĐOẠN:\na" in got[0]


def test_json_corrector():
    fix = correction.json_corrector(lambda system, user: '```json\n{"corrected_text": "xin chào 12"}\n```')
    assert fix("xin chao 12", "") == "xin chào 12"
    for bad in ('{"corrected_text": 1}', '{"corrected_text": "a", "more": 1}', "text", "[]"):
        with pytest.raises((ValueError, AttributeError)):
            correction.json_corrector(lambda s, u, bad=bad: bad)("a", "")
    with pytest.raises(ValueError):
        correction.json_corrector(lambda s, u: "{}", most=10)("a" * 11, "")
    assert correction.correct_text("abc 12", "", correction.json_corrector(lambda s, u: "nothing")) == ("abc 12", "failed")


def test_corrected_tables(spark):
    t = spark.createDataFrame([("d", "b", [["Ten", "12"], ["xau", ""]])], "document_id string, block_id string, rows array<array<string>>")
    assert correction.correct_tables(t, lambda text, _: text.replace("xau", "xấu")).first().rows == [["Ten", "12"], ["xấu", ""]]


def test_end_abort_and_blanks(spark):
    rows = [
        ("a", 1, 0, "text", "one"), ("a", 1, 2, "text", "three"), ("a", 1, 3, correction.END, None), ("a", 1, 7, "text", "late"),
        ("b", 1, 0, "text", "gone"), ("b", 1, 1, correction.ABORT, None), ("c", 1, 0, "text", "  "), ("c", 1, 1, "text", "two"),
    ]
    got = correction.correct(spark.createDataFrame(rows, correction.INPUT), lambda text, _: text.upper()).collect()
    out = sorted((r.document_id, r["index"], r.content, r.previous, r.status) for r in got)
    assert out == [("a", 0, "ONE", "", "success"), ("a", 2, "THREE", "ONE", "success"), ("c", 0, "  ", "", "skipped"), ("c", 1, "TWO", "  ", "success")]


def test_progress(spark, tmp_path):
    said = []
    listener = progress.watch(spark, lambda *x: said.append(x))
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("five").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if any(x[1] == "done" for x in said):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [x[1] for x in said if x[0] == "five"][0] == "started" and sum(x[3] for x in said if x[1] == "batch") == 5


def plain_compute(tables, question, op):
    """The rules of compute() in plain Python, over {block_id: rows} with unique lower-case values."""
    best = None
    for block, (head, *rows) in sorted(tables.items()):
        numeric = [c for c in range(len(head)) if all(r[c].lstrip("-").isdigit() for r in rows)]
        left, filters = list(range(len(rows))), []
        for c in range(len(head)):
            if c in numeric:
                continue
            values = {rows[i][c] for i in left}
            named = sorted((v for v in values if f" {v} " in f" {question} "), key=lambda v: (-len(v), v))
            if named and len(named) < len(values):
                left = [i for i in left if rows[i][c] == named[0]]
                filters.append((head[c], named[0]))
        words = set(question.split())
        if op == "count":
            score, value = 1 + len(filters), float(len(left))
        elif not numeric:
            continue
        else:
            over = lambda c: len(set(head[c].split()) & words) / len(set(head[c].split()))
            c = min(numeric, key=lambda c: (-over(c), c))
            xs = [float(rows[i][c]) for i in left]
            score, value = over(c) + 0.5 * len(filters), {"sum": sum(xs), "max": max(xs), "min": min(xs), "avg": sum(xs) / len(xs)}[op]
        if best is None or score > best[0]:
            best = score, block, value, filters, len(left)
    return best[1:] if best else None


def test_compute_equals_plain_code(spark):
    rng = random.Random(3)
    words = ["north", "south", "east", "gold", "silver", "north east", "tin"]
    tables = {}
    for k in range(12):
        head = ["place", "metal", *rng.sample(["sales", "net sales", "cost", "staff"], 2)]
        tables[f"t{k:02d}"] = [head, *[[rng.choice(words), rng.choice(words), str(rng.randint(1, 99)), str(rng.randint(1, 99))] for _ in range(rng.randint(1, 8))]]
    asks = {"sum": "total", "avg": "average", "max": "highest", "min": "lowest", "count": "how many"}
    questions = [(i, op, f"{asks[op]} {rng.choice(['sales', 'net sales', 'cost', 'staff', 'things'])} of {rng.choice(words)} and {rng.choice(words)}") for i, op in enumerate(list(asks) * 8)]
    blocks = spark.createDataFrame([(b, rows, None, "python") for b, rows in tables.items()], "block_id string, rows array<array<string>>, inherited_header array<string>, numeric_repr string")
    q = spark.createDataFrame([(i, text) for i, _, text in questions], "query_id long, query string")
    got = {r.query_id: r for r in compute.compute(q, blocks).collect()}
    for i, op, text in questions:
        block, value, filters, n = plain_compute(tables, text, op)
        r = got[i]
        assert (r.operation, r.block_id, r.rows_used, [tuple(f) for f in r.filters]) == (op, block, n, filters), text
        assert abs(r.value - value) < 1e-9
    some = spark.createDataFrame([(i, "t03") for i, *_ in questions], "query_id long, block_id string")
    only = {r.query_id: r for r in compute.compute(q, blocks, some).collect()}
    for i, op, text in questions:
        assert (only[i].block_id, only[i].rows_used) == ("t03", plain_compute({"t03": tables["t03"]}, text, op)[3])
    assert json.dumps(sorted(got)) == json.dumps(sorted(only))
