"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token pieces of at most ``size``. Only the histogram of piece
lengths (at most ``size`` counters) reaches the driver, which places lengths
longest first, each into the pack with most room, on counts of packing patterns
rather than on pieces. A piece then finds its place by its rank within its
length: the pattern tables are ranges of ranks.

Ranks need no shuffle of the pieces: each scan task numbers its own pieces of a
length, and the counts by (task, length) give each task's first rank, which the
tasks that place the pieces read from small side files.

Defined results: a null text counts as empty (a document of only the end id);
documents keep null and repeated doc_ids, ``start`` counts within a row. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common, tokenizers_

PIECES = pa.schema(
    [("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then the rest."""
    return [(at, min(size, total - at)) for at in range(0, total, size)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of the token pieces of all documents: part and rank are the scan task and the
    piece's number among that task's pieces of its length; ids are little-endian
    unsigned 32-bit, or null without ``with_ids``."""

    def encode(batches):
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), Counter(), tokenizers_.byte_bpe(tokenizer)
        end = np.array([end_id], np.uint32)
        for b in common.slices(batches):
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), common.texts(b["text"]), strict=True):
                ids = np.concatenate([enc(text), end])
                for start, length in cut(len(ids), size):
                    raw = ids[start : start + length].astype("<u4").tobytes()
                    rows.append((part, seen[length], doc, start, length, zlib.crc32(raw), len(ids), raw if with_ids else None))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return common.saved_map(common.ids_and_texts(docs, id_col, text_col), encode, PIECES, "pieces")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Packing patterns [({length: times}, count)] that use up the histogram.

    Lengths go longest first; each goes into the shortest pack it fits, for as
    many packs of that pattern as there are. A length is placed as often in one
    pack as it fits there, so that no step makes more than two new patterns.
    """
    open_: dict[int, list[tuple[Counter, int]]] = {}  # by room left
    rooms: list[int] = []  # heap of -room
    done: list[tuple[dict[int, int], int]] = []

    def put(pattern: Counter, room: int, count: int) -> None:
        if count:
            if room == 0:
                done.append((dict(pattern), count))
                return
            if room not in open_:
                open_[room] = []
                heapq.heappush(rooms, -room)
            open_[room].append((pattern, count))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                pattern, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    heapq.heappop(rooms)
                used = min(count, left)
                put(pattern, room, count - used)
                put(pattern + Counter({length: 1}), room - length, used)
                left -= used
            else:
                fits = size // length
                if full := left // fits:
                    put(Counter({length: fits}), size - fits * length, full)
                    left -= full * fits
                if left:
                    put(Counter({length: left}), size - left * length, 1)
                    left = 0
    done += [(dict(p), n) for packs in open_.values() for p, n in packs]
    return done


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, end_rank, first_sequence, offset): the pieces of a
    length with these ranks go to consecutive sequences, at that offset."""
    rank, rows, sequence = Counter(), [], 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                rows.append((length, rank[length], rank[length] + count, sequence, offset))
                rank[length] += count
                offset += length
        sequence += count
    return rows


PLACED = pa.schema([*[f for f in PIECES if f.name not in ("part", "rank")], ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Places:
    """The rows of places() as sorted arrays, to look up many pieces at once."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.lo, self.first, self.offset = table[:, 1], table[:, 3], table[:, 4]
        self.key = self._key(table[:, 0], self.lo)

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return length.astype(np.int64) << 48 | rank  # ranks stay below 2 ** 48

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their length and rank within it."""
        at = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        return self.first[at] + rank - self.lo[at], self.offset[at]


def pack(made: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces(). Pieces are not
    shuffled: a task gets the table of places, whose rows ``size`` bounds, and reads the first
    ranks of the scan tasks whose pieces it meets from side files."""
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = common.saved(counts, "lengths", light=True)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = Places(places(shortest_pack_first(histogram, size)))
    # A length's counts are one row per scan task; the window sums them up.
    first = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(first), F.lit(0))).drop("n")
    side = common.saved_by(bases.repartition("part"), "part", "bases")

    def place(batches):
        part, base = -1, np.zeros(size + 1, np.int64)
        for b in batches:
            parts, lengths, ranks = (b[c].to_numpy() for c in ("part", "length", "rank"))
            ranks = ranks.copy()
            for a, z in _runs(parts):
                if parts[a] != part:
                    part, found = parts[a], common.read_side(f"{side}/part={parts[a]}", ["length", "base"])
                    base[found["length"].to_numpy()] = found["base"].to_numpy()
                ranks[a:z] += base[lengths[a:z]]
            sequence, offset = table(lengths, ranks)
            yield common.record(PLACED, **{f.name: b[f.name] for f in PLACED if f.name in b.schema.names}, sequence_id=sequence, offset=offset)

    return common.map_arrow(made, place, PLACED)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (null
    without ``with_ids``), offset and sequence_id. Group by sequence_id and order
    by offset for the packed sequences; see sequences()."""
    made = pieces(docs, tokenizer or tokenizers_.path("byte_bpe_50k.json"), end_id, size, with_ids, id_col, text_col)
    return pack(made, size)


def sequences(packed: DataFrame, size: int, pad_id: int = 0) -> DataFrame:
    """The token rows to train on, from pack_documents(with_ids=True): ids and the
    document number at each place (from 1; 0 at the padding). A fill that is a
    power of two stays unpadded."""
    items = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("segments", pa.list_(pa.int32()))])

    def lay(batches):
        for b in batches:
            rows = [[], []]
            for parts in b["items"].to_pylist():
                ids = [np.frombuffer(x["ids"], "<u4").astype(np.int32) for x in parts]
                seg = [np.full(len(x), k, np.int32) for k, x in enumerate(ids, 1)]
                fill = sum(map(len, ids))
                pad = 0 if fill & (fill - 1) == 0 else size - fill
                rows[0].append(np.concatenate([*ids, np.full(pad, pad_id, np.int32)]))
                rows[1].append(np.concatenate([*seg, np.zeros(pad, np.int32)]))
            yield common.record(out, sequence_id=b["sequence_id"], ids=rows[0], segments=rows[1])

    return common.map_arrow(packed.groupBy("sequence_id").agg(items.alias("items")), lay, out)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack_documents(common.table(spark, sf_dir, "documents")))
