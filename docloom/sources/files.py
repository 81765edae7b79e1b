"""Discovery and validation of input files: folders, single files and ZIP archives."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats, marks of their content, names that are never input, limits.
EXTENSIONS = [".pdf", ".docx", ".xlsx", ".xlsm", ".xltx", ".xltm", ".xls"]
OOXML = [".docx", ".xlsx", ".xlsm", ".xltx", ".xltm"]
MAX_FILE_MB, MAX_ARCHIVE_MB, MAX_ARCHIVE_FILES = 200, 4096, 5000

FILES = "path string, name string, length long, content binary"


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI, for range reads in tasks."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def outermost(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(paths that exist, paths that don't): resolved, each once, none that lies below another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, lost = set(), set()
    for given in paths:
        p = jvm.org.apache.hadoop.fs.Path(given)
        fs = p.getFileSystem(conf)
        found = fs.exists(p)
        (there if found else lost).add(fs.resolvePath(p).toString() if found else given)
    return [p for p in sorted(there, key=str.lower) if not any(p.startswith(q.rstrip("/") + "/") for q in there)], sorted(lost, key=str.lower)


def discover(spark: SparkSession, paths: list[str], with_content: bool = True) -> DataFrame:
    """path, name, length, content of all files below the paths that exist; a file that
    two of the paths name comes once. Spark's scan leaves out files of no length, except
    those inside of archives. inventory() tells of the other paths."""
    there, _ = outermost(spark, paths)
    if not there:
        return spark.createDataFrame([], FILES).drop(*([] if with_content else ["content"]))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", *(["content"] if with_content else []))


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and reason (null: to be read; else not_found, temporary_or_system_file,
    unsupported_extension) of all that the paths name, in order of the lower-cased path."""
    _, lost = outermost(spark, paths)
    found = discover(spark, paths, with_content=False).select("path", skip_reason().alias("reason"))
    return found.unionByName(spark.createDataFrame([(p, "not_found") for p in lost], "path string, reason string")).orderBy(F.lower("path"), "path")


def skip_reason() -> Column:
    """Of a file by its name: temporary_or_system_file, unsupported_extension, or null."""
    low = F.lower("name")
    ext = F.regexp_extract(low, r"(\.[^.]+)$", 1)
    return F.when(F.startswith("name", F.lit("~$")) | low.isin(".ds_store", "thumbs.db"), "temporary_or_system_file").when(~ext.isin([*EXTENSIONS, ".zip"]), "unsupported_extension")


#: Entries of an archive that one task reads: so many, or so many bytes.
GROUP_ENTRIES, GROUP_BYTES = 64, 16 << 20


def expand_archives(files: DataFrame, max_mb: int = MAX_ARCHIVE_MB, max_files: int = MAX_ARCHIVE_FILES, group_entries: int = GROUP_ENTRIES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Files (path, name, length, content), with the entries of ZIP archives in place of
    these. Adds error_code: corrupted_archive, archive_too_many_files, archive_too_large,
    unsafe_path.

    Archives are read by ranges: first their directories, which give the limits and
    groups of entries of bounded size; then each group, dealt over tasks, so that one
    large archive is read by many. No entry is read of an archive that breaks a limit."""
    is_zip = F.lower("name").endswith(".zip")
    plain = files.where(~is_zip).select("path", "name", "length", "content", F.lit(None).cast("string").alias("error_code"))
    groups = files.where(is_zip).select("path", "name", "length").mapInPandas(_directory(max_mb, max_files, group_entries, group_bytes), "path string, name string, length long, first int, last int, error_code string")
    bad = groups.where("error_code is not null").select("path", "name", "length", F.lit(None).cast("binary").alias("content"), "error_code")
    # A number of its own, or adaptive execution would merge these few bytes into one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.where("error_code is null").select("path", "first", "last").repartition(tasks, "path", "first")
    return plain.unionByName(bad).unionByName(dealt.mapInPandas(_entries, FILES + ", error_code string"))


class _Ranges(io.RawIOBase):
    """A file of any file system, read where it is asked for."""

    def __init__(self, uri: str):
        fs, at = open_fs(uri)
        self.file = fs.open_input_file(at)
        self.size, self.at = self.file.size(), 0

    def readable(self) -> bool:
        return True

    seekable = readable

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        self.at = at
        return at

    def readinto(self, out) -> int:
        got = self.file.read_at(max(0, min(len(out), self.size - self.at)), self.at)
        out[: len(got)] = got
        self.at += len(got)
        return len(got)

    def close(self) -> None:
        self.file.close()
        super().close()


def _zip(uri: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_Ranges(uri), 1 << 16))


def _listed(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in z.infolist() if not i.is_dir()]


def _directory(max_mb: int, max_files: int, group_entries: int, group_bytes: int):
    """A row for each group of entries of an archive, or one with what is wrong with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, name, length in zip(b.path, b.name, b.length, strict=True):
                try:
                    with _zip(path) as z:
                        entries = _listed(z)
                except (zipfile.BadZipFile, NotImplementedError):
                    rows.append((path, name, length, None, None, "corrupted_archive"))
                    continue
                unsafe = any(i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") or ":" in i.filename for i in entries)
                error = "archive_too_many_files" if len(entries) > max_files else "archive_too_large" if sum(i.file_size for i in entries) > max_mb * 2**20 else "unsafe_path" if unsafe else None
                if error:
                    rows.append((path, name, length, None, None, error))
                    continue
                first = size = 0
                for n, i in enumerate(entries):
                    if n > first and (n - first >= group_entries or size + i.file_size > group_bytes):
                        rows.append((path, name, length, first, n, None))
                        first, size = n, 0
                    size += i.file_size
                if entries:
                    rows.append((path, name, length, first, len(entries), None))
            yield pd.DataFrame(rows, columns=["path", "name", "length", "first", "last", "error_code"]).astype({"first": "Int32", "last": "Int32"})

    return run


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each group, a frame a group. An entry that can't be read gives an error row."""
    columns = ["path", "name", "length", "content", "error_code"]
    for b in batches:
        for path, first, last in zip(b.path, b["first"], b["last"], strict=True):
            rows = []
            with _zip(path) as z:
                for i in _listed(z)[first:last]:
                    name, content, error = i.filename.rsplit("/", 1)[-1], None, None
                    try:
                        content = z.read(i)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):  # a wrong sum, method or password
                        error = "corrupted_archive"
                    rows.append((f"{path}!/{i.filename}", name, i.file_size, content, error))
            yield pd.DataFrame(rows, columns=columns)


def write_archives(files: DataFrame, folder: str, most: int = MAX_ARCHIVE_FILES) -> DataFrame:
    """Write files (name, content) into ZIP archives of at most ``most`` entries below a
    folder that tasks share, some for each task; path and number of entries of each. An
    archive gets its name once it is whole, and a repeated task's has another: only those
    that this table names count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = open_fs(folder)
        fs.create_dir(at)
        out = z = None
        mine, n = "", 0

        def done():
            z.close()
            out.close()
            fs.move(f"{at}/.{mine}", f"{at}/{mine}")
            return pd.DataFrame({"path": [f"{folder}/{mine}"], "entries": [n]})

        for b in batches:
            for name, content in zip(b.name, b.content, strict=True):
                if z is not None and n >= most:
                    yield done()
                    z = None
                if z is None:
                    mine, n = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{at}/.{mine}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(name, content)
                n += 1
        if z is not None:
            yield done()

    return files.select("name", "content").mapInPandas(run, "path string, entries long")


def _package_error(content: Column) -> Column:
    """corrupted_file of content that should be a ZIP package, else null."""

    def one(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                return None if "[Content_Types].xml" in z.namelist() else "corrupted_file"
        except zipfile.BadZipFile:
            return "corrupted_file"

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(one)

    return run(content)


def validate(files: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """Adds extension, has_macros, content_hash and error_code: unsupported_type,
    file_too_large, empty_file, invalid_signature, encrypted_file, corrupted_file; null if sound."""
    ext = F.regexp_extract(F.lower("name"), r"(\.[^.]+)$", 1)
    head = F.hex(F.substring("content", 1, 8))
    is_zip, is_ole, is_pdf = head.startswith("504B0304"), head.startswith("D0CF11E0"), head.startswith("25504446")
    error = (
        F.when(~ext.isin(EXTENSIONS), "unsupported_type")
        .when(F.col("length") > max_mb * 2**20, "file_too_large")
        .when(F.col("length") == 0, "empty_file")
        .when((ext == ".pdf") & ~is_pdf, "invalid_signature")
        .when(ext.isin(OOXML) & is_ole, "encrypted_file")
        .when(ext.isin(OOXML) & ~is_zip, "invalid_signature")
        .when((ext == ".xls") & ~is_ole, "invalid_signature")
        .when(ext.isin(OOXML), _package_error(F.col("content")))
    )
    return files.withColumns({"extension": ext, "has_macros": ext.isin(".xlsm", ".xltm"), "content_hash": F.sha2("content", 256), "error_code": F.coalesce("error_code", error) if "error_code" in files.columns else error})


def new_versions(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (name, content_hash) is not known yet; repeats within the batch count once."""
    return files.dropDuplicates(["name", "content_hash"]).join(known.select("name", "content_hash"), ["name", "content_hash"], "left_anti")
