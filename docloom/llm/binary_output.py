"""Token-id files with a minimal perfect hash index.

Documents are encoded where they are scanned; what is range-partitioned by doc_id
into shards are ids (two bytes each where the vocabulary allows, else four). A
shard is two files: ``.bin`` holds the raw ids one document after the other;
``.idx`` holds the keys in order,
the offset table, and a minimal perfect hash of the keys, whose slots store a
fingerprint and the key's first row. A key is looked up in constant time: hash,
compare the fingerprint, read the offsets.

The hash is a cascade of bit arrays: at each level the keys that fall on a bit of
their own take it, the others go to the next level; a key's slot is the number of
bits set before its own.

Every attempt of a task writes files of its own name, and the manifest, which
Spark commits, names those of the attempt that counts.

Defined results: a null text counts as empty (only the end id). Rows with equal
doc_id lie one after the other, by text hash, and one key finds them all; rows
with a null doc_id come first and have no key. Empty tables give no shard rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common, tokenizers_

MAGIC = b"docloom1"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of keys and a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct uint64 keys to 0..n-1. ``gamma`` is the bits of a level for each key that reaches it."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) // 64)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, words, left = [], [np.zeros(0, np.uint64)], keys.astype(np.uint64)
        while len(left):
            size = -(-max(64, int(gamma * len(left))) // 64) * 64
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no bit is set (a key that is not there may get any slot)."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.first[level] + at // 64, (at % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _index(keys: np.ndarray, nulls: int, counts: np.ndarray, tokens: int, dtype: str) -> list[bytes]:
    """The index file: magic, length of the header, the header (JSON: sections
    and their lengths), then the sections."""
    known = keys[nulls:]
    distinct, first, times = np.unique(known, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.lookup(distinct)
    prints, rows, repeats = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<u4")
    prints[slot], rows[slot], repeats[slot] = fingerprint(distinct), first + nulls, times
    ends = np.cumsum(counts, dtype=np.int64).astype("<i8")
    sections = {"keys": keys.astype("<i8"), "ends": ends, "bits": table.words.astype("<u8"), "prints": prints, "rows": rows, "repeats": repeats}
    header = json.dumps({"documents": len(keys), "nulls": nulls, "tokens": tokens, "dtype": dtype, "levels": table.sizes, "sections": {k: [v.dtype.str, len(v)] for k, v in sections.items()}}).encode()
    return [MAGIC, len(header).to_bytes(8, "little"), header, *(v.tobytes() for v in sections.values())]


class Shard:
    """Reader of one shard; ``file`` is its name in the manifest."""

    def __init__(self, folder: str, file: str):
        self.fs, base = common.open_fs(folder)
        self.path = f"{base}/{file}"
        with self.fs.open_input_file(self.path + ".idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{self.path}.idx is no index file")
        size = int.from_bytes(raw[8:16], "little")
        self.header, at, part = json.loads(raw[16 : 16 + size]), 16 + size, {}
        for name, (kind, n) in self.header["sections"].items():
            part[name] = np.frombuffer(raw, kind, n, at)
            at += part[name].nbytes
        self.keys, self.ends, self.prints, self.rows, self.repeats = (part[k] for k in ("keys", "ends", "prints", "rows", "repeats"))
        self.hash = PerfectHash(self.header["levels"], part["bits"].astype(np.uint64))
        self.dtype = np.dtype(self.header["dtype"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; (-1, 0) where the fingerprint says it is not there."""
        slot = self.hash.lookup(keys)
        at = np.maximum(slot, 0)
        there = (slot >= 0) & (self.prints[at] == fingerprint(keys)) if len(self.prints) else np.zeros(len(keys), bool)
        return (np.where(there, self.rows[at], -1), np.where(there, self.repeats[at], 0)) if len(self.prints) else (np.full(len(keys), -1), np.zeros(len(keys), np.int64))

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all documents with that key."""
        (row,), (times,) = self.find(np.array([key], np.int64))
        return [ids for _, ids in self.read(np.arange(row, row + int(times)))]

    def read(self, rows: np.ndarray, buffer: int = 4 << 20):
        """(row, ids) of the given rows; neighbours share a read of ``buffer`` bytes."""
        width, held, start = self.dtype.itemsize, b"", 0
        with self.fs.open_input_file(self.path + ".bin") as f:
            for row in rows.tolist():
                a, z = (int(self.ends[row - 1]) if row else 0) * width, int(self.ends[row]) * width
                if a < start or z > start + len(held):
                    start, held = a, f.read_at(max(buffer, z - a), a)
                yield row, np.frombuffer(held, self.dtype, (z - a) // width, a - start)


def _schema(arrow: pa.Schema):
    return from_arrow_schema(arrow)


CODED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])
MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])


ORDER = ["doc_id", "tie", "row"]  # a hot key spreads over shards by its texts, and these by their rows
#: Keys from which the borders of shards are taken: so many for each shard, and at most in all. Only sizes of shards depend on them.
BORDER_KEYS, MOST_KEYS = 20, 1_000_000


def _key(doc_id: int | None, tie: int, row: int) -> tuple[bool, int, int, int]:
    """The order of documents: null ids first."""
    return doc_id is not None, doc_id or 0, tie, row


def borders(slim: DataFrame, shards: int) -> list[tuple[bool, int, int, int]]:
    """The first keys of all shards but the first, for payloads of about equal size."""
    n, wanted = slim.count(), min(BORDER_KEYS * shards, MOST_KEYS)
    some = slim if n <= wanted else slim.where(F.pmod(F.xxhash64("tie", "row"), F.lit(n)) < wanted)
    rows = sorted((_key(r["doc_id"], r["tie"], r["row"]), r["size"]) for r in some.select(*ORDER, F.octet_length("text").alias("size")).collect())
    ends = np.cumsum([1 + (size or 0) for _, size in rows], dtype=np.int64)
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards, side="left") if rows else []
    return sorted({rows[c][0] for c in cuts})


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents into shards in ascending doc_id order; returns the
    manifest, one row per shard, which is also written as Parquet beside them.
    ``shards`` defaults to the session's number of shuffle partitions, or more so
    that a shard holds ids of ``shard_bytes`` of text at most on average."""
    spark = docs.sparkSession
    file = tokenizer or tokenizers_.path("word_bpe_49k.json")
    dtype = tokenizers_.word_bpe(file).dtype
    slim = common.ids_and_texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tie"), common.row_key().alias("row"), "text")
    if not shards:
        total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // shard_bytes))
    cuts = borders(slim, shards)

    def encode(batches):
        encoder = tokenizers_.word_bpe(file)
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in common.slices_by_size(batches):
            keys = zip(*(b[c].to_pylist() for c in ORDER), strict=True)
            shard = [bisect_right(cuts, _key(*k)) for k in keys]
            yield common.record(CODED, shard=shard, doc_id=b["doc_id"], tie=b["tie"], row=b["row"], ids=[x + end for x in encoder(common.texts(b["text"]))])

    def write(batches):
        fs, base = common.open_fs(folder)
        fs.create_dir(base)
        open_: _Shard | None = None
        for b in batches:
            for shard in pa.compute.unique(b["shard"]).to_pylist():  # in ascending order
                if open_ and open_.shard != shard:
                    yield open_.close()
                    open_ = None
                open_ = open_ or _Shard(fs, base, shard, dtype)
                open_.add(b.filter(pa.compute.equal(b["shard"], shard)))
        if open_:
            yield open_.close()

    coded = common.map_arrow(slim, encode, CODED).repartitionById(shards, F.col("shard"))
    written = common.map_arrow(coded.sortWithinPartitions("shard", *ORDER).select("shard", "doc_id", "ids"), write, MANIFEST)
    with common.small_batches(spark):
        written.write.parquet(f"{folder}/manifest")
    return spark.read.schema(_schema(MANIFEST)).parquet(f"{folder}/manifest")


class _Shard:
    """Writer of one shard: the payload as it comes, the index at the end."""

    def __init__(self, fs, base: str, shard: int, dtype: str):
        self.fs, self.shard, self.dtype, self.name = fs, shard, dtype, f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        self.path, self.keys, self.counts, self.nulls = f"{base}/{self.name}", [], [], 0
        self.sink = fs.open_output_stream(f"{self.path}.bin")

    def add(self, b: pa.RecordBatch) -> None:
        self.nulls += b["doc_id"].null_count
        self.keys.append(b["doc_id"].fill_null(0).to_numpy())
        self.counts.append(pa.compute.binary_length(b["ids"]).to_numpy().astype(np.int64) // np.dtype(self.dtype).itemsize)
        for x in b["ids"]:
            self.sink.write(x.as_buffer())

    def close(self) -> pa.RecordBatch:
        self.sink.close()
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        tokens = int(counts.sum())
        with self.fs.open_output_stream(f"{self.path}.idx") as f:
            for part in _index(keys, self.nulls, counts, tokens, self.dtype):
                f.write(part)
        first, last = (int(keys[self.nulls]), int(keys[-1])) if len(keys) > self.nulls else (None, None)
        return common.record(MANIFEST, shard=[self.shard], file=[self.name], documents=[len(keys)], tokens=[tokens], first_key=[first], last_key=[last])


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: start (ids before it in all shards),
    number of ids and their CRC-32 as little-endian unsigned 32-bit. Documents with
    a key are read by it: the perfect hash gives its rows, and the offset table
    their place in the payload. A key that is not found raises."""
    manifest = spark.read.schema(_schema(MANIFEST)).parquet(f"{folder}/manifest")
    # One row per shard, so a single task can sum them up.
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = [(r["file"], r["base"]) for r in based.select("file", "base").collect()]  # the number of shards bounds it
    tasks = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "file string, base long")

    def read(batches):
        for b in batches:
            for file, base in zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True):
                s = Shard(folder, file)
                nulls = s.header["nulls"]
                distinct = np.unique(s.keys[nulls:])
                first, times = s.find(distinct)
                if (first < nulls).any() or int(times.sum()) != len(s.keys) - nulls:
                    raise RuntimeError(f"{s.path}: the index does not find its own keys")
                found = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                known, rows = np.repeat(distinct, times), np.concatenate([np.arange(nulls), found]).astype(np.int64)
                starts = np.concatenate([[0], s.ends[:-1]])[rows]
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in s.read(rows)]
                keys = pa.array(np.concatenate([np.zeros(nulls, np.int64), known]), pa.int64(), mask=np.arange(len(rows)) < nulls)
                yield common.record(READ, doc_id=keys, start=starts + base, n_tokens=s.ends[rows] - starts, ids_crc32=crc)

    return common.map_arrow(tasks, read, READ)


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the given keys: each goes to the shards whose key range
    holds it (the manifest has one row per shard) and is found by its index."""
    manifest = spark.read.schema(_schema(MANIFEST)).parquet(f"{folder}/manifest")
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    ranges = F.broadcast(manifest.where("first_key is not null").select("file", "first_key", "last_key"))
    wanted = keys.select(F.col("doc_id").cast("long")).distinct().join(ranges, F.col("doc_id").between(F.col("first_key"), F.col("last_key"))).select("file", "doc_id")

    def get(batches):
        open_: dict[int, Shard] = {}
        for b in batches:
            for file, key in zip(b["file"].to_pylist(), b["doc_id"].to_pylist(), strict=True):
                if file not in open_:
                    open_ = {file: Shard(folder, file)}
                if ids := open_[file].get(key):
                    yield common.record(out, doc_id=[key] * len(ids), ids=[x.astype(np.int32) for x in ids])

    return common.map_arrow(wanted.repartition("file").sortWithinPartitions("file"), get, out)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "ids")
    write_ids(common.table(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder)
