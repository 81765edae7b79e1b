"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each scan task hashes its texts and sends, to the owner of each range of
   hashes, its sorted distinct fingerprints as Golomb-Rice coded gaps.
2. Owners answer each task with a bitmap: which of its fingerprints other tasks
   sent too. Only codes and bitmaps travel, some seven bytes a document.
3. Each task scans its texts again, and those with a marked fingerprint (or one
   that the task itself saw twice) are shuffled, pre-aggregated, for comparison
   byte by byte.

Defined results: a null text counts as empty; equal means identical after
lower-casing A-Z only. The row with the largest doc_id stays; a null doc_id is
smaller than any; of rows with one doc_id the later in the scan stays. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import common

#: Rows whose fingerprints an owner gets on average, at most.
OWNED = 4_000_000

# ---------------------------------------------------------------- Golomb-Rice


def rice_encode(sorted_values: np.ndarray) -> bytes:
    """Gaps of sorted distinct uint64 values: a byte k, all quotients in unary,
    then all remainders of k bits. k is the power of two next to ln 2 of the mean gap."""
    n = len(sorted_values)
    if not n:
        return b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(sorted_values[-1]) / n
    k = min(63, max(0, int(np.floor(np.log2(max(1.0, mean * 0.6931))))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    bits = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return bytes([k]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def rice_decode(blob: bytes, n: int) -> np.ndarray:
    """The sorted values of rice_encode."""
    if not n:
        return np.zeros(0, np.uint64)
    k, m = blob[0], int.from_bytes(blob[1:9], "little")
    cut = 9 + (m + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[9:cut], np.uint8), count=m)
    q = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


# ------------------------------------------------------------------- operator


def _digest(text: str) -> tuple[bytes, bytes]:
    """(normalised text in UTF-8, its SHA-256). bytes.lower() changes A-Z only."""
    norm = text.encode("utf-8", "surrogatepass").lower()
    return norm, hashlib.sha256(norm).digest()


def _fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


_SENT = pa.schema([("src", pa.int32()), ("owner", pa.int32()), ("rows", pa.int64()), ("n", pa.int32()), ("blob", pa.binary()), ("multi", pa.binary())])


def _send(batches, owners: int):
    from pyspark import TaskContext

    got = []
    for b in common.slices(batches):
        got.append(np.fromiter((_fingerprint(_digest(x)[1]) for x in common.texts(b["text"])), np.uint64, b.num_rows))
    if not got:
        return
    got = np.concatenate(got)
    values, counts = np.unique(got, return_counts=True)
    owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
    base = [np.uint64(-(-(o << 32) // owners) << 32) for o in range(owners)]
    rows = [(o, values[a:z] - base[o], counts[a:z] > 1) for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
    yield common.record(
        _SENT,
        src=[TaskContext.get().partitionId()] * len(rows),
        owner=[o for o, _, _ in rows],
        rows=[len(got)] * len(rows),
        n=[len(v) for _, v, _ in rows],
        blob=[rice_encode(v) for _, v, _ in rows],
        multi=[np.packbits(m).tobytes() for _, _, m in rows],
    )


_MARKS = pa.schema([("src", pa.int32()), ("owner", pa.int32()), ("marks", pa.binary())])


def _own(table: pa.Table) -> pa.Table:
    """Bitmaps for one owner: which of a task's fingerprints another task sent too."""
    sent = [rice_decode(blob, n) for blob, n in zip(table["blob"].to_pylist(), table["n"].to_pylist(), strict=True)]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[counts > 1]
    marks = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in sent]
    return pa.table({"src": table["src"], "owner": table["owner"], "marks": pa.array(marks, pa.binary())}, schema=_MARKS)


def _schema(arrow: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(arrow)


def marked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """A written table of every row as (row_key, doc_id, mark, sha256, suspect, norm): norm is the
    normalised text where another row has the same fingerprint, else null."""
    slim = common.ids_and_texts(docs, id_col, text_col)
    if not owners:
        spark = docs.sparkSession
        owners = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-docs.count() // OWNED))
    sent = common.saved_map(slim, lambda it: _send(it, owners), _SENT, "sent")
    marks = sent.select("src", "owner", "n", "blob").groupBy("owner").applyInArrow(_own, _schema(_MARKS))
    side = common.saved_by(sent.join(marks, ["src", "owner"]).repartition("src"), "src", "marks")
    out = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("sha256", pa.string()), ("suspect", pa.bool_()), ("norm", pa.binary())])

    def again(batches):
        from pyspark import TaskContext

        src, pos = TaskContext.get().partitionId(), 0
        mine = common.read_side(f"{side}/src={src}", ["owner", "rows", "n", "blob", "multi", "marks"])
        every, marked = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for x in mine.to_pylist() if mine is not None else []:
            every.append(rice_decode(x["blob"], x["n"]) + np.uint64(-(-(x["owner"] << 32) // owners) << 32))
            both = np.frombuffer(x["multi"], np.uint8) | np.frombuffer(x["marks"], np.uint8)
            marked.append(np.unpackbits(both, count=x["n"]).astype(bool))
        every, marked = np.concatenate(every), np.concatenate(marked)
        order = np.argsort(every)
        every, marked = every[order], marked[order]
        for b in common.slices(batches):
            texts = common.texts(b["text"])
            done = [_digest(x) for x in texts]
            fp = np.fromiter((_fingerprint(d) for _, d in done), np.uint64, len(done))
            at = np.minimum(np.searchsorted(every, fp), max(0, len(every) - 1))
            if not len(every) or (every[at] != fp).any():
                raise RuntimeError(common.OTHER)
            hit = marked[at]
            yield common.record(
                out,
                row_key=(np.int64(src) << np.int64(33)) + np.arange(pos, pos + len(done)),
                doc_id=b["doc_id"],
                mark=[common.mark(x) for x in texts],
                sha256=[d.hex() for _, d in done],
                suspect=hit,
                norm=[t if h else None for (t, _), h in zip(done, hit, strict=True)],
            )
            pos += len(done)
        if mine is not None and pos != mine["rows"][0].as_py():
            raise RuntimeError(common.OTHER)

    return common.saved_map(slim, again, out, "rows")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: row_key, mark, doc_id, keep_id, group_size, kept, text_sha256.

    ``owners`` is the number of hash ranges; by default as many as there are shuffle
    partitions, or more so that an owner gets OWNED rows at most on average. It
    holds the distinct fingerprints of its range, never the repeats of a hot one.
    """
    rows = marked_rows(docs, id_col, text_col, owners)
    suspects = rows.where("suspect")
    # Grouping by the bytes verifies them; partial aggregation folds a hot text to a row per task first.
    groups = (
        suspects.groupBy("sha256", "norm")
        .agg(F.max(F.struct("doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("n"))
        .groupBy("sha256")
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .select(
            "sha256",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row_key").alias("keep_key"),
            F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.col("n")).cast("long").alias("n"),
        )
    )
    # Written before the join, so that adaptive execution can split the rows of a hot group.
    groups = common.saved(groups, "groups", light=True)
    shared = suspects.drop("norm").join(groups, "sha256").select(
        "row_key", "mark", "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_key") == F.col("keep_key")).alias("kept"), F.col("sha256").alias("text_sha256")
    )
    alone = rows.where("not suspect").select(
        "row_key", "mark", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha256").alias("text_sha256")
    )
    return alone.unionByName(shared)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; all columns and row order within files kept."""
    return common.drop_rows(docs, exact_dedup(docs, id_col, text_col).where("not kept").select("row_key", "mark"), text_col)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents")).drop("row_key", "mark")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
