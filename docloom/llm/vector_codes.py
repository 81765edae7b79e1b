"""Vector code compression: product codes from a delta-maintained Lloyd iteration.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts.
Each position has a codebook of its own. A round assigns every part to its nearest
entry and then moves each entry to the mean of its parts, rounded down. Assignments
are kept in a written table, sums and counts of the entries on the driver (parts x
entries rows, whatever the table's size). A round shuffles only what changed: each
task adds up plus contributions to new entries and minus contributions to old ones,
for parts whose assignment is another than before, so that it sends one row at most
for each entry. All arithmetic is on integers and exact.

Defined results: rows take no part whose vector is null, empty, or holds null or
non-finite components; nor do those of another length than the vector of the smallest
id has. A component whose floor lies beyond ``limit`` counts as the limit. Parts of a
length that can't be cut evenly differ by one. Null ids come last, and ids that
repeat come in the order of their vectors; all such rows are encoded. Fewer rows than
``entries`` give as many entries. Of equally near entries the lowest index is taken,
so of equal entries only the first is used. Other columns are ignored, whatever their
names. An empty table has no codebooks and no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import scratch
from docloom.llm import common

KEPT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.list_(pa.int32()))])
ASSIGNED = pa.schema([*KEPT, ("was", pa.binary()), ("code", pa.binary())])
CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
#: Sums of so many rows fit a long, with components up to the limit.
LIMIT = 1 << 24


def integers(vectors: DataFrame, scale: int = 1024, limit: int = LIMIT, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """vec_id, label, x of the rows whose vector is sound; x = floor(scale * component)."""
    v = vectors[vec_col].cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(c * scale))).cast("int"))
    return vectors.where(v.isNotNull() & sound).select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), x.alias("x"))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, exactly. Products of
    matrices in doubles are exact while all sums stay below 2**53; else integers are used."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:
        y, c = x.astype(np.float64), book.astype(np.float64)
        d = (c**2).sum(axis=1) - 2 * (y @ c.T)
        at = d.argmin(axis=1)
        return at, (d[np.arange(len(d)), at] + (y**2).sum(axis=1)).astype(np.int64)
    at, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 64):
        d = ((x[a : a + 64, None, :].astype(np.int64) - book[None]) ** 2).sum(axis=2)
        at[a : a + 64] = d.argmin(axis=1)
        least[a : a + 64] = d.min(axis=1)
    return at, least


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Codes:
    rows: DataFrame  # vec_id, label, code, error: a written table
    books: list[np.ndarray]  # of each part, entries x width

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place, joined with commas."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()

    def decode(self, scale: int = 1024) -> DataFrame:
        """vec_id and the vector (array of doubles) that its code stands for: the middle of the entry's cells."""
        books = self.books

        def run(batches):
            for b in common.slices(batches, 4096):
                code = np.frombuffer(bytes.fromhex("".join(b["code"].to_pylist())), np.uint8).reshape(-1, len(books))
                v = (np.hstack([book[code[:, p]] for p, book in enumerate(books)]) + 0.5) / scale
                yield common.record(_DECODED, vec_id=b["vec_id"], vector=pa.array(list(v), pa.list_(pa.float64())))

        return common.map_arrow(self.rows.select("vec_id", "code"), run, _DECODED)


_DECODED = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64()))])


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> Codes | None:
    """Codes of all sound vectors, of ``parts`` bytes each (entries <= 256); None if there are none."""
    spark = vectors.sparkSession
    kept = scratch.saved(integers(vectors, scale, id_col=id_col, label_col=label_col, vec_col=vec_col), "integers")
    order = [F.asc_nulls_last("vec_id"), "x"]
    first = kept.select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["x"])
    kept = kept.where(F.size("x") == dim)
    start = np.array([r["x"] for r in kept.select("vec_id", "x").orderBy(*order).limit(entries).collect()], np.int64)  # at most ``entries`` rows
    at = cuts(dim, parts)
    books = [start[:, a:z].copy() for a, z in at]
    sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
    table, path = kept.withColumns({"was": F.lit(None).cast("binary"), "code": F.lit(None).cast("binary")}), None
    for _ in range(rounds):
        new = common.scratch_path(spark, "assigned")
        table = common.saved_map(table, _assign(books, at, dim), ASSIGNED, "assigned", path=new)
        if path:
            common.remove(spark, path)
        path = new
        for r in _changes(table, at, dim).collect():  # a row for each changed entry: parts x entries at most
            sums[r["part"]][r["entry"]] += np.array(r["total"][: len(sums[r["part"]][0])], np.int64)
            counts[r["part"]][r["entry"]] += r["n"]
        books = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for b, s, n in zip(books, sums, counts, strict=True)]
    rows = common.saved_map(table, _encode(books, at, dim), CODED, "codes")
    common.remove(spark, path)
    return Codes(rows, books)


def _assign(books: list[np.ndarray], at: list[tuple[int, int]], dim: int):
    """Each row with its new assignment, a byte a part; the one before becomes ``was``."""

    def run(batches):
        for b in common.slices(batches, 4096):
            x = _matrix(b["x"], dim)
            code = np.stack([_nearest(x[:, a:z], book)[0].astype(np.uint8) for book, (a, z) in zip(books, at, strict=True)], axis=1)
            yield common.record(ASSIGNED, vec_id=b["vec_id"], label=b["label"], x=b["x"].cast(pa.list_(pa.int32())), was=b["code"].cast(pa.binary()), code=[c.tobytes() for c in code])

    return run


_CHANGE = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _changes(table: DataFrame, at: list[tuple[int, int]], dim: int) -> DataFrame:
    """part, entry, n, total: what a round adds to the counts and sums of entries. Only
    parts whose assignment changed count; a task sends a row for each entry at most."""
    width = max(z - a for a, z in at)

    def run(batches):
        n = np.zeros((len(at), 256), np.int64)
        total = np.zeros((len(at), 256, width), np.int64)
        for b in common.slices(batches, 4096):
            x = _matrix(b["x"], dim)
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, len(at))
            known = b["was"].is_valid().to_numpy(zero_copy_only=False)
            was = np.frombuffer(b"".join(w or bytes(len(at)) for w in b["was"].to_pylist()), np.uint8).reshape(-1, len(at))
            for p, (a, z) in enumerate(at):
                moved = ~known | (was[:, p] != code[:, p])
                for rows, to, sign in ((moved, code, 1), (moved & known, was, -1)):
                    np.add.at(n[p], to[rows, p], sign)
                    np.add.at(total[p, :, : z - a], to[rows, p], sign * x[rows, a:z].astype(np.int64))
        some = (n != 0) | (total != 0).any(axis=2)
        part, entry = np.nonzero(some)
        yield common.record(_CHANGE, part=part.astype(np.int32), entry=entry.astype(np.int32), n=n[some], total=pa.array(list(total[some]), pa.list_(pa.int64())))

    changed = table.where("was is null or was <> code").select("x", "was", "code")
    sums = F.array(*[F.sum(F.col("total")[i]) for i in range(width)]) if width else F.array().cast("array<long>")
    return common.map_arrow(changed, run, _CHANGE).groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("total"))


def _encode(books: list[np.ndarray], at: list[tuple[int, int]], dim: int):
    def run(batches):
        for b in common.slices(batches, 4096):
            x = _matrix(b["x"], dim)
            near = [_nearest(x[:, a:z], book) for book, (a, z) in zip(books, at, strict=True)]
            code = np.stack([i.astype(np.uint8) for i, _ in near], axis=1)
            yield common.record(CODED, vec_id=b["vec_id"], label=b["label"], code=[c.tobytes().hex() for c in code], error=sum(d for _, d in near))

    return run


def label_errors(rows: DataFrame, common_share: int = 1000) -> DataFrame:
    """rows (vec_id, label, code, error: a written table) with label_error, the sum over
    rows of the same label, nulls together. Labels of more than one row in
    ``common_share`` are at most ``common_share``, so these are broadcast; the others,
    none of them large, meet their sums by a shuffle."""
    sums = scratch.saved(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * common_share > total
    met = rows.join(F.broadcast(sums.where(often).drop("n")), F.col("label").eqNullSafe(F.col("of")), "left").where("label_error is not null").drop("of")
    if sums.where(~often).isEmpty():
        return met
    rest = rows.join(F.broadcast(sums.where(often).select("of")), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    return met.unionByName(rest.join(sums.where(~often).drop("n"), F.col("label").eqNullSafe(F.col("of"))).drop("of"))


COLUMNS = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes = compress(common.table(spark, sf_dir, "embeddings"))
    if codes is None:
        return spark.createDataFrame([], COLUMNS)
    return label_errors(codes.rows).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _oracle(parts: int = 4, rounds: int = 4) -> str:
    """The same by brute force: all parts against all entries in every round."""
    cte = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS y FROM v, range({parts}) AS r(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS c FROM p QUALIFY entry < 256)",
    ]
    for r in range(rounds + 1):
        cte.append(
            f"""n{r} AS MATERIALIZED (SELECT vec_id, label, part, y, min(struct_pack(d := d, entry := entry)) AS best FROM (
  SELECT p.*, entry, CAST(list_inner_product(y, y) + list_inner_product(c, c) - 2 * list_inner_product(y, c) AS BIGINT) AS d FROM p JOIN b{r} USING (part)) GROUP BY ALL)"""
        )
        if r < rounds:
            cte.append(
                f"""s{r} AS (SELECT part, best.entry AS entry, i, floor(sum(y[i]) / count(*)) AS m FROM n{r}, range(1, 1 + (SELECT max(len(y)) FROM p)) AS g(i) WHERE i <= len(y) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(new.c), any_value(old.c)) AS c FROM b{r} old LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS c FROM s{r} GROUP BY ALL) new USING (part, entry) GROUP BY ALL)"""
            )
    last = f"n{rounds}"
    cte.append(f"e AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM {last} GROUP BY ALL)")
    cte.append(f"k AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM b{rounds}, range(1, 1 + (SELECT max(len(y)) FROM p)) AS g(i) WHERE i <= len(c))")
    return "WITH " + ",\n".join(cte) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM k) AS codebooks_sha256 FROM e"


ORACLE = _oracle()
