"""ZIP archives: read by ranges, by many tasks; limits hold before any entry is read."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.sources import files


def archive(path, entries, mode="w"):
    with zipfile.ZipFile(path, mode, zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    entries = [(f"sub/{i:04d}.txt", f"text {i} " * (i % 50)) for i in range(5000)] + [("sub/", "")]
    archive(tmp_path / "big.zip", entries)
    found = files.expand_archives(files.discover(spark, [str(tmp_path)])).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    assert {r.name: bytes(r.content).decode() for r in rows} == {n[4:]: c for n, c in entries if n[-1] != "/"}
    assert len({r.task for r in rows}) >= 3 and all(r.length == len(r.content) and r.error_code is None for r in rows)
    assert rows[0].path.startswith("file:") and "big.zip!/sub/" in rows[0].path
    groups = next(files._directory(4096, 5000, 64, 1000)(iter([files.pd.DataFrame({"path": [str(tmp_path / "big.zip")], "name": ["big.zip"], "length": [1]})])))
    assert groups["first"].tolist() == [0, *groups["last"].tolist()[:-1]] and groups["last"].iloc[-1] == 5000
    assert (groups["last"] - groups["first"]).max() <= 64


def test_limits_and_damage(spark, tmp_path, monkeypatch):
    archive(tmp_path / "many.zip", [(f"{i}", "x") for i in range(9)])
    archive(tmp_path / "large.zip", [("a", "x" * 3_000_000)])
    archive(tmp_path / "slip.zip", [("../a", "x")])
    archive(tmp_path / "empty.zip", [])
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    archive(tmp_path / "sum.zip", [("good", "g" * 50), ("bad", "b" * 50), ("fine", "f" * 50)])
    raw = bytearray((tmp_path / "sum.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        raw[z.getinfo("bad").header_offset + 30 + 3 + 2] ^= 0xFF
    (tmp_path / "sum.zip").write_bytes(bytes(raw))
    (tmp_path / "plain.docx").write_bytes(b"x")
    found = files.expand_archives(files.discover(spark, [str(tmp_path)]), max_mb=2, max_files=8)
    got = {(r.name, r.error_code, r.content is None) for r in found.collect()}
    assert got == {
        ("many.zip", "archive_too_many_files", True), ("large.zip", "archive_too_large", True), ("slip.zip", "unsafe_path", True), ("broken.zip", "corrupted_archive", True),
        ("good", None, False), ("bad", "corrupted_archive", True), ("fine", None, False), ("plain.docx", None, False),
    }


def test_inventory(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("A.pdf", "~$x.docx", "b/c.txt", "b/Thumbs.db", "b/d.XLSX", "e.zip"):
        (tmp_path / name).write_bytes(b"x")
    given = [str(tmp_path), str(tmp_path / "b"), f"{tmp_path}/b/../A.pdf", str(tmp_path / "gone.pdf"), f"file://{tmp_path}/A.pdf"]
    rows = files.inventory(spark, given).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.reason) for r in rows if r.reason != "not_found"] == [("A.pdf", None), ("c.txt", "unsupported_extension"), ("d.XLSX", None), ("Thumbs.db", "temporary_or_system_file"), ("e.zip", None), ("~$x.docx", "temporary_or_system_file")]
    assert [r.path for r in rows if r.reason == "not_found"] == [str(tmp_path / "gone.pdf")]
    assert files.discover(spark, [str(tmp_path / "gone")]).count() == 0
