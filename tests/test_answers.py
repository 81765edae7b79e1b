"""Answers to a table of questions in one plan, and models that live on executors."""

import json

from docloom.operators import models
from docloom.plans import api
from docloom.plans.api import RetrievalAnswerPipeline
from tests.test_api import large_corpus


def loader(folder):
    """A model that leaves a file each time it is loaded."""

    def load():
        import uuid

        (folder / uuid.uuid4().hex).write_text("")

        def generate(system, user):
            if "M0013" in user.rsplit("CÂU HỎI", 1)[1]:
                raise ValueError("no answer")
            return api.quoting_generator(system, user)

        return generate

    return load


def test_answers_of_many_questions(spark, tmp_path):
    config, _, _ = large_corpus(spark, tmp_path)
    loads = tmp_path / "loads"
    loads.mkdir()
    rag = RetrievalAnswerPipeline(spark, config, generate=models.PerWorker(loader(loads)), frozen=False)
    asked = [(i, f"Doanh thu của mã M{i:04d}") for i in range(300)] + [(300, "Tổng doanh thu là bao nhiêu?"), (301, "zzz qqq"), (302, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {x["query_id"]: x for x in rag.answers(spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert sorted(got) == list(range(303)) and spark.conf.get("spark.sql.shuffle.partitions") == before
    # Workers keep their model: far fewer loads than questions.
    assert 1 <= len(list(loads.iterdir())) <= 16
    failed = got.pop(13)
    assert failed["answer"] == api.REFUSAL and failed["refused"] and failed["reason"] == "generator_failed:ValueError: no answer"
    total = sum(1000 + i for i in range(400))
    assert got[300]["computed"]["value"] == total and got[300]["answer"].startswith("SUM(Doanh thu) = 479.800")
    assert got[300]["unsupported_numbers"] == [] and got[300]["citation_valid"]
    for i in (301, 302):
        assert (got[i]["answer"], got[i]["refused"], got[i]["citations"], got[i]["citation_valid"]) == (api.REFUSAL, True, [], True), got[i]
    for i in range(300):
        if i != 13:
            assert got[i]["citations"] and not got[i]["refused"] and got[i]["reason"] == "ok", got[i]
    # The same in small: a batch through ask() equals its rows, and is traced with personal data masked.
    (one,) = rag.ask(["Doanh thu của mã M0007, gọi 0912345678"])
    assert one["citations"] == got[7]["citations"]
    traces = [json.loads(line) for f in (tmp_path / "traces").glob("*.json") for line in f.read_text().splitlines()]
    assert len(traces) == 1 and "<PHONE>" in traces[0]["record"] and "0912345678" not in traces[0]["record"]


def test_outputs_of_models(spark):
    """Nulls are empty texts; a failed row has an error; an empty table gives no rows."""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (3, "bad")], "k long, t string")

    def model(t):
        if t == "bad":
            raise KeyError(t)
        return f"<{t}>"

    rows = sorted(tuple(r) for r in models.outputs(df, "k", ["t"], model, tasks=3).collect())
    assert rows == [(1, "<a>", None), (2, "<>", None), (3, None, "KeyError: 'bad'"), (3, None, "KeyError: 'bad'")]
    assert models.outputs(df.limit(0), "k", ["t"], model).collect() == []
