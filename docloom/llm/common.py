"""Shared pieces of the training-data operators: scratch tables in the shared
folder, side files that map tasks read back, and text batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python code at a time, so that a batch of very long texts stays small.
SLICE_ROWS = 256
#: Rows of an Arrow batch between Spark and Python.
BATCH_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is
    unset, a temporary folder serves a local session; a cluster's executors would
    each write to a disk of their own, so there it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; release() or the end of the process removes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/docloom-{what}-{uuid.uuid4().hex}")
    path = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    _made.append((spark, path))
    return path


def _folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _commit(path: str, names: list[tuple[str, str]]) -> None:
    """Move the files that the successful attempt of each task has named to where
    readers look, as Spark's committer does at a job's end. Files of lost, repeated or
    late attempts keep their hidden names and are never read."""
    fs, base = open_fs(path)
    for folder in {out.rpartition("/")[0] for _, out in names if "/" in out}:
        fs.create_dir(f"{base}/{folder}")
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda x: fs.move(f"{base}/{x[0]}", f"{base}/{x[1]}"), names))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows between Spark and Python, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, what: str, light: bool = False) -> DataFrame:
    """Cut the lineage: Spark writes a table into the shared folder and reads it back.
    A light one (a few numbers a row) is written by fewer tasks, into larger files."""
    if light:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 8))
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_map(df: DataFrame, run, schema, what: str, after=None, path: str | None = None) -> DataFrame:
    """The written table of map_arrow(df, run, schema), at ``path`` or a new one. The
    Python workers write it themselves, so that what Python has made need not go
    through the JVM. A task names its file in its result; only named files are
    committed, so a lost or repeated attempt leaves nothing that is read."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, what)
    _folder(spark, path)

    def write(batches):
        from pyarrow import parquet as pq
        from pyspark import TaskContext

        fs, base = open_fs(path)
        part, writer, mine = TaskContext.get().partitionId(), None, f".{uuid.uuid4().hex}"
        for b in run(batches):
            if not b.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(f"{base}/{mine}")
                writer = pq.ParquetWriter(sink, b.schema)
            writer.write_batch(b)
        if writer is not None:
            writer.close()
            sink.close()
            yield record(_FILE, mine=[mine], out=[f"part-{part:06d}.parquet"])

    with small_batches(spark):
        _commit(path, [tuple(r) for r in map_arrow(df, write, _FILE, after).collect()])  # a row per task
    return spark.read.schema(_spark_schema(schema)).parquet(path)


_FILE = pa.schema([("mine", pa.string()), ("out", pa.string())])


def saved_by(df: DataFrame, key: str, what: str) -> str:
    """Write a small table into a folder for each value of an integer column, named
    key=value, for map tasks to read; returns the path above. df must have all rows
    of a value in one partition, and as many values as there are tasks at most."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    _folder(spark, path)

    def write(batches):
        from pyarrow import parquet as pq

        fs, base = open_fs(path)
        if parts := list(batches):
            whole = pa.Table.from_batches(parts).combine_chunks()
            for value in whole[key].unique().to_pylist():
                mine = f".{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{base}/{mine}") as sink:
                    pq.write_table(whole.filter(pa.compute.equal(whole[key], value)), sink)
                yield record(_FILE, mine=[mine], out=[f"{key}={value}/part-0.parquet"])

    with small_batches(spark):
        _commit(path, [tuple(r) for r in map_arrow(df, write, _FILE).collect()])
    return path


def _spark_schema(schema):
    if isinstance(schema, pa.Schema):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(schema)
    return schema


def release() -> None:
    """Remove all scratch tables made so far (results that read them end with that)."""
    while _made:
        spark, path = _made.pop()
        jvm = spark.sparkContext._jvm
        if jvm is None:
            continue
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        _made.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Remove one scratch table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a shared folder's URI, for code in map tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def read_side(uri: str, columns: list[str] | None = None) -> pa.Table | None:
    """All part files below a folder as one table; None where the folder is absent."""
    from pyarrow import fs as pafs
    from pyarrow import parquet as pq

    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return None
    parts = [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith("part-")]
    if not parts:
        return None
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(x.path)).read(columns) for x in sorted(parts, key=lambda x: x.path)])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices_by_size(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, or of one longer text."""
    import numpy as np

    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b[column]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two needed columns, under fixed names, whatever else the table has."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_key() -> Column:
    """A key of each row: partition (31 bits) and place in it (33 bits). The same
    for every scan of the same files, unlike doc_id never null or repeated."""
    return F.monotonically_increasing_id()


def tidy() -> None:
    """Give memory that a task has freed back to the system; workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema, after=None) -> DataFrame:
    """df.mapInArrow, with memory given back at a task's end. ``after`` is called then, too."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            tidy()

    return df.mapInArrow(tidied, _spark_schema(schema))


def mark(text: str) -> int:
    """A hash of a text, by which a second scan proves that it sees the same row."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


OTHER = "the input gave other partitions than before; write it to a table first"


def drop_rows(docs: DataFrame, dropped: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose row_key() is in dropped (row_key, mark).

    Texts are not shuffled: the dropped places are written by partition into the
    shared folder, and each scan task reads its own few. The scan must give the
    same partitions again, as a scan of files does; a row at a dropped place whose
    text has another mark() raises.
    """
    src = F.shiftright("row_key", 33).cast("int")
    side = saved_by(dropped.select(src.alias("src"), F.col("row_key").bitwiseAND((1 << 33) - 1).alias("pos"), "mark").repartition("src"), "src", "dropped")
    schema, at = docs.schema, docs.columns.index(text_col)

    def keep(batches):
        import numpy as np
        from pyspark import TaskContext

        found = read_side(f"{side}/src={TaskContext.get().partitionId()}", ["pos", "mark"])
        gone, marks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if found is not None:
            order = np.argsort(found["pos"].to_numpy())
            gone, marks = found["pos"].to_numpy()[order], found["mark"].to_numpy()[order]
        seen = 0
        for b in slices(batches, BATCH_ROWS):
            lo, hi = np.searchsorted(gone, [seen, seen + b.num_rows])
            places = gone[lo:hi] - seen
            seen += b.num_rows
            if hi > lo:
                if [mark(t) for t in texts(b.column(at).take(pa.array(places)))] != marks[lo:hi].tolist():
                    raise RuntimeError(OTHER)
                left = np.ones(b.num_rows, bool)
                left[places] = False
                b = b.filter(pa.array(left))
            if b.num_rows:
                yield b
        if len(gone) and gone[-1] >= seen:
            raise RuntimeError(OTHER)

    return map_arrow(docs, keep, schema)
