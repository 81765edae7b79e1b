"""State of streams ends, failed claims are released, known spellings reach the corrector."""

import time

import pytest
from pyspark.sql import functions as F

from docloom.functions.names import name_candidates, name_candidates_py
from docloom.operators import profile
from docloom.plans.queries_stream import _rocksdb
from docloom.streaming import correction
from tests.conftest import SF

TEXTS = ["Ông Nguyễn Văn An và Bà Trần Thị Bình", "NGUYEN Van An, Nguyen Van An.", "a Hà Nội\nHà Nội b", "", None, "Visa Platinum2 x Ab", "Éloi Ça va", "Tổng Công Ty  Điện Lực"]


def test_names_in_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    for r in df.select("text", name_candidates("text").alias("names")).collect():
        assert name_candidates_py(r.text) == r.names, r.text


def test_ledger_gives_the_terms_of_the_profile(spark):
    texts = ["Nguyen Van An gặp Hà Nội", "theo Nguyễn Văn An, và Nguyễn Văn An", "Hà Nội. Ha Noi. Visa Platinum", "Lê Lợi", "Lê Lợi"]
    ledger = correction.Ledger()
    for t in texts:
        ledger.add(t)
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, reading_order int, content string")
    want = [r.canonical for r in profile.terms(profile.ledger(df)).orderBy("rank").collect()]
    assert ledger.terms() == want == ["Hà Nội", "Nguyễn Văn An", "Lê Lợi"]
    assert ledger.terms(limit=1) == ["Hà Nội"] and ledger.terms(max_chars=10) == ["Hà Nội"] and correction.Ledger().terms() == []


def test_glossary_of_a_document(spark):
    """Each segment sees the spellings of the corrected text before it, of its own document."""

    def corrector(text, previous, terms):
        return text.replace("Ha Noi", "Hà Nội") + f" <{terms}>"

    rows = [("a", 1, i, "text", t) for i, t in enumerate(["Ha Noi xa", "Ha Noi gần", "ở Ha Noi"])] + [("b", 1, 0, "text", "Ha Noi"), ("a", 2, 0, "text", "mới")]
    first = spark.createDataFrame([r for r in rows if r[1] == 1], correction.INPUT)
    got = {(r.document_id, r["index"]): r.content for r in correction.correct(first, corrector, glossary=True).collect()}
    assert got == {("a", 0): "Hà Nội xa <>", ("a", 1): "Hà Nội gần <>", ("a", 2): "ở Hà Nội <Hà Nội>", ("b", 0): "Hà Nội <>"}
    again = {(r.document_id, r["index"], r.generation): r.content for r in correction.correct(spark.createDataFrame(rows, correction.INPUT), corrector, glossary=True).collect()}
    assert again["a", 0, 2] == "mới <>"


def test_second_try_goes_without_context_and_terms():
    calls = []

    def corrector(text, previous, terms):
        calls.append((previous, terms))
        raise ValueError

    ledger = correction.Ledger()
    for _ in range(2):
        ledger.add("theo Nguyễn Văn An")
    assert correction.correct_text("abc", "trước", corrector, ledger=ledger) == ("abc", "failed")
    assert calls == [("trước", "Nguyễn Văn An"), ("", "")]


def run(spark, tmp_path, stream, seconds=60):
    """Start a stream into memory of files, until its state is empty and stays so."""
    with _rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
        try:
            began, left, seen = time.time(), None, False
            while time.time() - began < seconds and q.isActive:
                time.sleep(0.3)
                progress = q.lastProgress
                if progress and progress["stateOperators"]:
                    left = progress["stateOperators"][0]["numRowsTotal"]
                    seen = True
                    if left == 0:
                        break
            return left
        finally:
            q.stop()


def test_state_of_closed_and_silent_documents_ends(spark, tmp_path):
    rows = [("a", 1, 0, "text", "one"), ("a", 1, 1, correction.END, None), ("b", 1, 0, correction.ABORT, None), ("c", 1, 0, "text", "zero"), ("c", 1, 2, "text", "two"), ("c", 1, 4, "text", "four")]
    spark.createDataFrame(rows, correction.INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(correction.INPUT).parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, correction.correct(stream, lambda text, _: text.upper(), keep_seconds=0.5, idle_seconds=1)) == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.document_id, r["index"], r.content, r.previous) for r in got.collect()) == [("a", 0, "ONE", ""), ("c", 0, "ZERO", ""), ("c", 2, "TWO", "ZERO"), ("c", 4, "FOUR", "TWO")]


def claims(spark, rows):
    return spark.createDataFrame(rows, correction.CLAIMS)


def test_failed_uploads_can_come_again(spark, tmp_path):
    rows = [("f", "h", 1, "claim"), ("f", "h", 2, "claim"), ("f", "h", 3, "failed"), ("f", "h", 4, "claim"), ("f", "h", 5, "done"), ("f", "h", 6, "claim"), ("f", "other", 7, "claim"), ("g", "h", 8, "failed"), ("g", "h", 9, "claim")]
    got = {r.event_id: r.accepted for r in correction.upload_claims(claims(spark, rows)).collect()}
    assert got == {1: True, 2: False, 4: True, 6: False, 7: True, 9: True}
    claims(spark, [("f", "h", 1, "claim"), ("g", "h", 2, "claim"), ("g", "h", 3, "failed")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(correction.CLAIMS).parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, correction.upload_claims(stream, lease_seconds=0.5)) == 0  # a stale claim ends as well
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("accepted")).count() == 2


@pytest.mark.parametrize("rows", [[], [("x", 1, 0, "text", None)]])
def test_nothing_to_correct(spark, rows):
    assert correction.correct(spark.createDataFrame(rows, correction.INPUT), lambda *a: "", glossary=True).count() == len(rows)


def test_rows_in_turn_stay_out_of_the_state():
    """Only rows that have to wait are stored; batches of any cut give the same rows."""
    import random

    import pandas as pd

    class Map(dict):
        puts = 0
        keys = lambda self: iter([(k,) for k in dict.keys(self)])
        exists = lambda self: len(self) > 0
        containsKey = lambda self, k: k[0] in self
        getValue = lambda self, k: self.get(k[0])
        removeKey = lambda self, k: self.pop(k[0])

        def updateValue(self, k, v):
            self.puts += 1
            self[k[0]] = v

    class Value(list):
        exists = lambda self: len(self) > 0
        get = lambda self: self[0]

        def update(self, v):
            self[:] = [v]

    class Handle:
        getValueState = lambda self, *_: Value()
        getMapState = lambda self, *_: Map()

    def run(batches):
        made = correction.OrderedCorrection(lambda text, previous: text.upper(), correction.LABELS)
        made.init(Handle())
        out = [f for b in batches for f in made.handleInputRows(("a",), iter([pd.DataFrame(b, columns=["document_id", "generation", "index", "label", "raw_text"])]), None)]
        assert not made.waiting
        return [tuple(r) for f in out for r in f.itertuples(index=False)], made.waiting.puts

    rows = [("a", 1, i, "text", f"turn number {i}.") for i in range(6)]
    want, puts = run([rows])
    assert [r[2] for r in want] == list(range(6)) and puts == 0
    assert run([rows[3:], rows[:3]]) == (want, 3)
    assert run([rows[2:], rows[2:4], rows]) == (want, 6)  # what comes again counts once
    for seed in range(20):
        mixed = random.Random(seed).sample(rows, 6)
        assert run([[r] for r in mixed])[0] == want
    end = ("a", 1, 6, correction.END, None)
    assert [r[2] for r in run([rows[4:], [rows[1], end]])[0]] == [1, 4, 5]
