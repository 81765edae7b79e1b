"""From files to answers: ingest, skip, freeze, restore, ask, evaluate."""

import json
import shutil
import zipfile

import pytest

from docloom.plans import store
from docloom.plans.api import IngestionPipeline, PipelineModeError, RetrievalAnswerPipeline
from docloom.plans.config import PipelineConfig
from tests.test_store import DOCX


def test_config():
    c = PipelineConfig.from_dict({"retrieval": {"rrf_k": 10}, "work_dir": "x"})
    assert c.retrieval.rrf_k == 10 and c.to_dict()["work_dir"] == "x"
    with pytest.raises(KeyError):
        PipelineConfig.from_dict({"retrieval": {"nope": 1}})


def test_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "bieu_phi.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", DOCX)
    store.write_workbook([["Chi nhánh", "Khu vực", "Doanh thu"], ["CN1", "Bắc", "120"], ["CN2", "Bắc", "80"], ["CN3", "Nam", "300"], ["CN4", "Nam", "10"]], str(folder / "doanh_thu.xlsx"))
    config = PipelineConfig(work_dir=str(tmp_path / "corpus"), buckets=4)
    pipeline = IngestionPipeline(spark, config)
    report = pipeline.ingest([str(folder)])
    assert report["counts"] == {"parse:success": 2, "index:success": 1} and report["stats"]["documents"] == 2
    again = pipeline.ingest([str(folder)])
    assert again["counts"]["parse:skipped"] == 2 and again["stats"] == report["stats"]
    with pytest.raises(PipelineModeError):
        RetrievalAnswerPipeline(spark, config)
    pipeline.freeze()
    with pytest.raises(PipelineModeError):
        pipeline.ingest([str(folder)])
    rag = RetrievalAnswerPipeline(spark, config)
    hits = rag.retrieve(["Phí thẻ Gold là bao nhiêu?"]).orderBy("rank").collect()
    assert "499.000" in hits[0]["content"]
    assert json.loads((tmp_path / "corpus" / "runs" / f"{report['run_id']}.json").read_text())["counts"] == report["counts"]
    assert len(list((tmp_path / "corpus" / "parsed" / report["run_id"]).glob("*.json"))) >= 1
    assert rag.retrieve(["Phí"], {"chunk_type": "table"}).where("chunk_type <> 'table'").count() == 0
    (answer,) = rag.ask(["Tổng doanh thu khu vực Bắc"])
    assert answer["computed"]["value"] == 200.0 and answer["citation_valid"]
    dataset = tmp_path / "eval.jsonl"
    dataset.write_text("// note\n" + json.dumps({"question": "Phí thẻ Gold", "expected_answer": "499.000", "expected_location": {"section": "phí"}}, ensure_ascii=False) + "\n")
    result = rag.evaluate(str(dataset))
    assert result["recall_at_5"] == 1.0 and result["evaluated"] == 1


LARGE = [["Mã", "Chi nhánh", "Doanh thu"], *[[f"M{i:04d}", f"Chi nhánh số {i}", str(1000 + i)] for i in range(400)]]


def large_corpus(spark, tmp_path):
    folder = tmp_path / "large"
    folder.mkdir()
    store.write_workbook(LARGE, str(folder / "chi_tiet.xlsx"))
    config = PipelineConfig(work_dir=str(tmp_path / "one"), buckets=2)
    pipeline = IngestionPipeline(spark, config)
    report = pipeline.ingest([str(folder)])
    return config, pipeline, report


def test_workbooks_bundle_and_plans(spark, tmp_path):
    """What a chunk names exists; a restored bundle answers as before; plans narrow and reword."""
    from docloom.sources import office

    config, pipeline, report = large_corpus(spark, tmp_path)
    chunk = pipeline.store.table("chunks").where("table_file is not null").first()
    file = tmp_path / "one" / chunk["table_file"]
    assert report["workbooks"] == 1 and chunk["table_file"] in chunk["content"]
    ((_, rows),) = office.sheets(file.read_bytes())
    assert rows == LARGE
    pipeline.freeze()
    question = ["Tổng doanh thu là bao nhiêu?"]
    before = RetrievalAnswerPipeline(spark, config).ask(question)
    assert before[0]["computed"]["value"] == sum(1000 + i for i in range(400))
    bundle = pipeline.store.export(str(tmp_path / "bundle.zip"))
    again = store.Store.restore(spark, bundle, str(tmp_path / "two"))
    assert (tmp_path / "two" / chunk["table_file"]).read_bytes() == file.read_bytes()
    assert again.log("status").count() == pipeline.store.log("status").count()
    moved = PipelineConfig(work_dir=str(tmp_path / "two"), buckets=2)
    after = RetrievalAnswerPipeline(spark, moved).ask(question)
    assert after == before

    def planner(text: str) -> str:
        return json.dumps({"semantic_queries": ["doanh thu của chi nhánh", text], "keyword_query": "M0007", "content_type": "table", "source_file": "nope.xlsx"})

    rag = RetrievalAnswerPipeline(spark, moved, planner=planner)
    p = rag.plan(["Bảng doanh thu"]).first()
    assert (p["semantic_queries"], p["keyword_query"], p["chunk_type"], p["source_file"]) == (["doanh thu của chi nhánh"], "M0007", "table", None)
    hits = rag.retrieve(["Bảng doanh thu"], plans=rag.plan(["Bảng doanh thu"])).collect()
    assert hits and {h["chunk_type"] for h in hits} == {"table"}
    assert rag.ask(["Bảng doanh thu"])[0]["answer"]
    dataset = tmp_path / "set.jsonl"
    dataset.write_text(json.dumps({"question": "Tổng doanh thu là bao nhiêu?", "expected_answer": str(sum(1000 + i for i in range(400))), "expected_document": "chi_tiet", "content_type": "table", "category": "sum"}) + "\n")
    got = rag.evaluate(str(dataset), answers=True)
    assert got["evaluated"] == 1 and got["answered"] == 1 and got["parse_success_rate"] == 1.0
    assert json.loads((tmp_path / "evaluation" / "report.json").read_text()) == json.loads(json.dumps(got))
    shutil.rmtree(tmp_path / "two" / again.setting("index.version") / "vectors")
    assert any("missing index" in w for w in again.validate())
