"""Corpus store: replace, delete, freeze, bundle; office files; entry contract."""

import zipfile

import pytest

from docloom.operators import chunking, graph
from docloom.plans import fixtures, store
from docloom.sources import files, office


def doc(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, content string")


def test_store_life(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "c"), buckets=4)
    s.write({"documents": doc(spark, ("a", "1"), ("b", "1")), "chunks": doc(spark, ("a", "x"), ("a", "y"), ("b", "z"))})
    s.write({"documents": doc(spark, ("a", "2")), "chunks": doc(spark, ("a", "w"))})
    assert sorted(map(tuple, s.table("documents").collect())) == [("a", "2"), ("b", "1")]
    assert sorted(r.content for r in s.table("chunks").collect()) == ["w", "z"]
    s.delete(doc(spark, ("b", "")))
    assert s.stats() == {"documents": 1, "blocks": 0, "chunks": 1, "edges": 0}
    s.vacuum()
    s.set_setting("index.model", "hash")
    s.freeze({"model": "hash", "dim": 128})
    assert s.validate({"dim": 128}) == [] and s.validate({"dim": 64}) != []
    with pytest.raises(store.FrozenCorpus):
        s.delete(doc(spark, ("a", "")))
    bundle = s.export(str(tmp_path / "b.zip"))
    r = store.Store.restore(spark, bundle, str(tmp_path / "r"))
    assert r.stats() == s.stats() and r.setting("index.model") == "hash"
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bundle) as z, zipfile.ZipFile(bad, "w") as out:
        for i in z.infolist():
            out.writestr(i, b"broken" if i.filename.endswith(".parquet") else z.read(i))
    with pytest.raises(ValueError):
        store.Store.restore(spark, str(bad), str(tmp_path / "r"))
    assert store.Store(spark, str(tmp_path / "r")).stats() == s.stats()
    s.reset()
    assert s.table("documents") is None


DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Phí</w:t></w:r></w:p><w:p><w:r><w:t>Bảng 1: Biểu phí</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Loại</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Phí</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>Gold</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>499.000</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Xem Bảng 1.</w:t></w:r></w:p></w:body></w:document>"""


def test_office_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", DOCX)
    store.write_workbook([["Báo cáo", ""], ["", ""], ["Chi nhánh", "Doanh thu"], ["CN1", "100"], ["CN2", "=1+1"]], str(folder / "b.xlsx"))
    (folder / "c.docx").write_bytes(b"PK\x03\x04broken")
    with zipfile.ZipFile(folder / "e.zip", "w") as z:
        z.write(folder / "a.docx", "sub/a2.docx")
        z.writestr("~$tmp.docx", "x")
        z.writestr("d.pdf", "")
    found = files.expand_archives(files.discover(spark, [str(folder)]))
    found = found.withColumn("skip", files.skip_reason()).where("skip is null")
    checked = files.validate(found)
    assert {r.name: r.error_code for r in checked.collect()} == {"a.docx": None, "a2.docx": None, "b.xlsx": None, "c.docx": "corrupted_file", "d.pdf": "empty_file"}
    good = checked.where("error_code is null")
    assert files.new_versions(good, good.limit(0)).count() == 3
    blocks = office.parse(good.selectExpr("name as document_id", "name", "content")).cache()
    assert [(r.block_type, r.content) for r in blocks.where("document_id = 'a.docx'").orderBy("reading_order").collect()] == [("heading", "Phí"), ("caption", "Bảng 1: Biểu phí"), ("table", "Loại | Phí\nGold | 499.000"), ("text", "Xem Bảng 1.")]
    b = blocks.where("document_id = 'b.xlsx'").orderBy("reading_order").collect()
    assert [(r.block_type, r.cell_range) for r in b] == [("text", "A1:A1"), ("table", "A3:B5")] and b[1].rows[2] == ["CN2", "=1+1"]
    edges, full = graph.build(blocks)
    assert edges.where("relation_type in ('captioned_by', 'referenced_by') and document_id = 'a.docx'").count() == 2
    assert chunking.chunk(full).where("document_id = 'a.docx'").count() == 2


def test_large_table_is_a_preview(spark):
    rows = [[f"C{c}" for c in range(8)]] + [[f"r{r}c{c}" for c in range(8)] for r in range(60)]
    one = fixtures.block("d", "t", "table", "t", 0, rows=rows)
    _, full = graph.build(spark.createDataFrame([one], fixtures.BLOCK_SCHEMA))
    (c,) = chunking.chunk(full, table_chars=1500).collect()
    assert c.table_file == "tables/d/t.xlsx" and "r4c4" in c.content and "r5c0" not in c.content and "60 hàng × 8 cột" in c.content and "C7" in c.content
    (c,) = chunking.chunk(full, table_chars=100_000).collect()
    assert c.table_file is None and "r59c7" in c.content


def test_entry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0
