"""Approximate nearest neighbours by balanced posting lists.

Cluster centres come from a bounded sample of the vectors: median cuts give cells
of equal size, a few rounds of means settle them, and cells that have grown over
twice the mean size are halved again. All vectors are indexed: each
goes to the list of its nearest centre and, near a border, to those of other
centres within a distance ratio. Centres are searched by a graph in memory (a
beam along links between near centres, or all distances where the beam is no small
share of the centres); a query takes the lists whose centres lie within a ratio of
the nearest's distance, up to a number that grows with the number of lists.

A list's vectors and queries are dealt into blocks of bounded size, and each block of
vectors meets each block of queries in a task of its own, so no list is one task's
burden however long it is.

Equal vectors are one entry that carries its k + 1 least ids, which is all that a
search for k can return of them, so a very common vector fills no list. Distances
are exact, in double precision on the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part. Vectors are compared with those of their own length; those of
another length than most make a list of their own, which their queries read whole.
Fewer candidates than k give all. Repeated vec_ids count once where their vectors are equal, and the
nearest of their vectors otherwise. Empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common


def _schema(arrow: pa.Schema):
    return from_arrow_schema(arrow)


# -------------------------------------------------------------- centres, graph


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x below and above the median along the direction of most spread."""
    x = x - x.mean(axis=0)
    axis = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(6):  # power iteration
        axis = x.T @ (x @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    order = np.argsort(x @ axis, kind="stable")
    return order[: len(x) // 2], order[len(x) // 2 :]


def centres(sample: np.ndarray, lists: int, rounds: int = 5) -> np.ndarray:
    """Centres of about ``lists`` cells of nearly equally many sample rows each."""
    cells = [np.arange(len(sample))]
    while len(cells) < lists and max(map(len, cells)) > 1:
        cells = [part for rows in cells for part in ([rows[h] for h in _halves(sample[rows])] if len(rows) > 1 else [rows])]
    c = np.stack([sample[r].mean(axis=0) for r in cells])
    for _ in range(rounds):
        own = _nearest(sample, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return balanced(sample, c)


def balanced(sample: np.ndarray, c: np.ndarray, most: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Halve cells of over ``most`` times the mean size; for each, the emptiest cell
    gives up its centre if it is under half the mean."""
    for _ in range(rounds):
        own = _nearest(sample, c)
        n, mean = np.bincount(own, minlength=len(c)), len(sample) / len(c)
        full = np.flatnonzero(n > max(1.0, most * mean))
        if not len(full):
            break
        empty = np.argsort(n, kind="stable")[: len(full)]
        new = []
        for f in full:
            rows = sample[own == f]
            new += [rows[h].mean(axis=0) for h in _halves(rows)]
        keep = np.setdiff1d(np.arange(len(c)), np.concatenate([full, empty[n[empty] < mean / 2]]))
        c = np.vstack([c[keep], new])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> np.ndarray:
    norm = (c**2).sum(axis=1)
    return np.concatenate([(norm - 2 * x[a : a + rows] @ c.T).argmin(axis=1) for a in range(0, len(x), rows)])


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding; infinite where they overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T
    return np.where(np.isnan(d), np.inf, d)


#: While vectors are assigned, a beam of one in EXACT centres or more costs more than all
#: distances. Queries are few and always go along the graph, unless the beam holds all.
EXACT = 16


@dataclass
class CentreGraph:
    """Links between near centres, and a beam search along them for many vectors at once."""

    c: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray, degree: int = 16, entries: int = 16) -> CentreGraph:
        """Each centre is linked with its nearest and with a few far ones (the same
        for equal input), so that no part of the graph is cut off."""
        degree = min(degree, len(c) - 1)
        norm, near = (c**2).sum(axis=1), []
        for a in range(0, len(c), 1024):
            d = norm - 2 * c[a : a + 1024] @ c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near.append(np.argsort(d, axis=1)[:, :degree])
        far = np.random.default_rng(3).integers(0, len(c), (len(c), 4))
        return cls(c, np.hstack([np.concatenate(near), far]), np.unique(np.linspace(0, len(c) - 1, min(entries, len(c))).astype(int)))

    def search(self, x: np.ndarray, k: int, beam: int = 64, exact: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(centres, distances), nearest first, of about the k nearest for each row of x;
        -1 and inf where fewer. All centres are compared where beam * exact reaches their number."""
        n, beam = len(x), max(k, min(beam, len(self.c)))
        if beam * exact >= len(self.c):
            d = np.sqrt(np.maximum(_squares(x, self.c), 0))
            k = min(k, len(self.c))
            some = np.argpartition(d, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
            return near, np.take_along_axis(d, near, 1)
        seen = np.zeros((n, len(self.c)), bool)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        row = np.arange(n)[:, None]
        while True:
            new = ~seen[row, fresh]
            order = np.argsort(fresh, axis=1, kind="stable")
            twin = np.zeros_like(new)
            s = np.take_along_axis(fresh, order, 1)
            np.put_along_axis(twin, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
            new &= ~twin
            seen[row, fresh] = True
            d = np.where(new, ((self.c[fresh] - x[:, None, :]) ** 2).sum(axis=2), np.inf)
            every_i, every_d = np.hstack([ids, fresh]), np.hstack([dist, d])
            every_done = np.hstack([done, ~new])
            best = np.argsort(every_d, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(v, best, 1) for v in (every_i, every_d, every_done))
            done |= ~np.isfinite(dist)
            if done.all():
                break
            at = np.argmax(~done, axis=1)  # the nearest that is not yet expanded
            some = ~done[np.arange(n), at]
            done[np.arange(n), at] = True
            fresh = np.where(some[:, None], self.links[np.maximum(ids[np.arange(n), at], 0)], self.entries[0])
        ids = np.where(np.isfinite(dist), ids, -1)
        return ids[:, :k], np.sqrt(dist[:, :k])


# ---------------------------------------------------------------------- entries

ENTRY = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _valid(column: pa.Array) -> list[bytes | None]:
    """The doubles of each vector as bytes; None of those that take no part."""
    at = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes nan
    count = lambda x: np.concatenate([[0], np.cumsum(x)])[at]
    odd, filled = np.diff(count(~np.isfinite(values))), np.diff(count(values != 0))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (odd == 0) & (filled > 0)
    return [values[a:z].tobytes() if good else None for a, z, good in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), strict=True)]


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)


def entries(vectors: DataFrame, keep: int, id_col: str, vec_col: str) -> DataFrame:
    """Distinct vectors with their ``keep`` least ids. Each task folds its own
    copies first, so a common vector comes as one row a task."""

    def fold(batches: Iterator[pa.RecordBatch]):
        found: dict[bytes, list[int]] = {}

        def rows():
            return common.record(ENTRY, vec=list(found), ids=[sorted(set(v))[:keep] for v in found.values()])

        for b in batches:
            for i, v in zip(b["id"].to_pylist(), _valid(b["v"]), strict=True):
                if v is not None and i is not None:
                    ids = found.setdefault(v, [])
                    ids.append(i)
                    if len(ids) > 4 * keep:
                        ids[:] = sorted(set(ids))[:keep]
            if len(found) > 20_000:
                yield rows()
                found.clear()
        if found:
            yield rows()

    slim = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return common.map_arrow(slim, fold, ENTRY).groupBy("vec").agg(least.alias("ids"))


@dataclass
class Index:
    graph: CentreGraph
    postings: DataFrame  # list, vec, ids
    dim: int


POSTING = pa.schema([("list", pa.int32()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])


def build(vectors: DataFrame, k: int = 10, list_size: int = 256, max_lists: int = 4096, sample_rows: int = 20_000, copies: int = 6, closure: float = 1.15, id_col: str = "vec_id", vec_col: str = "embedding") -> Index | None:
    """Index all vectors; None if there are none to index.

    The centres come from at most ``sample_rows`` distinct vectors (those with the
    least hash); ``max_lists`` bounds what is sent to the tasks. A vector lies in
    at most ``copies`` lists, those within ``closure`` times its least distance.
    Lists below zero hold the vectors of another length than most, by length."""
    known = common.saved(entries(vectors, k + 1, id_col, vec_col), "entries")
    total = known.count()
    sample = [r["vec"] for r in known.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample_rows).collect()]
    if not sample:
        return None
    dim = int(np.bincount([len(v) // 8 for v in sample]).argmax())
    x = _matrix([v for v in sample if len(v) == 8 * dim])
    graph = CentreGraph.build(centres(x, int(np.clip(total // list_size, 1, max_lists)))) if len(x) > 1 else CentreGraph(x, np.zeros((1, 1), int), np.zeros(1, int))

    def assign(batches: Iterator[pa.RecordBatch]):
        for b in common.slices(batches, 1024):
            vec = b["vec"].to_pylist()
            sizes = np.array([len(v) // 8 for v in vec])
            rows, lists = [np.flatnonzero(sizes != dim)], [-sizes[sizes != dim]]
            if len(main := np.flatnonzero(sizes == dim)):
                near, d = graph.search(_matrix([vec[i] for i in main]), copies, exact=EXACT)
                r, j = np.nonzero((near >= 0) & (d <= closure * d[:, :1] + 1e-12))
                rows.append(main[r])
                lists.append(near[r, j])
            rows = pa.array(np.concatenate(rows))
            yield common.record(POSTING, list=np.concatenate(lists).astype(np.int32), vec=b["vec"].take(rows), ids=b["ids"].take(rows).cast(POSTING.field("ids").type))

    return Index(graph, common.saved_map(known, assign, POSTING, "postings"), dim)


PROBE = pa.schema([("list", pa.int32()), ("q", pa.int64()), ("query", pa.binary())])
HIT = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
#: Vectors of a list, and queries of a list, that meet in one task, on average at most.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 65_536


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """list and number of blocks of the lists of over ``size`` rows: of these there are no more than lists."""
    return F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)).where(F.col(name) > 1))


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 48, share: int = 10, ratio: float = 1.6, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself
    left out. A query takes the lists whose centres lie within ``ratio`` times the
    nearest's distance, at most ``probes`` or one in ``share`` of all lists,
    whichever is more: on vectors spread evenly a fixed number of lists finds ever
    less as lists become more."""
    graph, dim = index.graph, index.dim
    probes = max(probes, -(-len(graph.c) // share))

    def rows(batches: Iterator[pa.RecordBatch]):
        out = pa.schema([("query_id", pa.int64()), ("query", pa.binary())])
        for b in batches:
            found = [(i, v) for i, v in zip(b["id"].to_pylist(), _valid(b["v"]), strict=True) if v is not None and i is not None]
            yield common.record(out, query_id=[i for i, _ in found], query=[v for _, v in found])

    asked = queries.select(queries[id_col].cast("long").alias("id"), queries[vec_col].cast("array<double>").alias("v")).mapInArrow(rows, "query_id long, query binary")
    asked = common.saved(asked.distinct(), "queries")
    numbered = common.saved(asked.select("query").distinct().withColumn("q", F.monotonically_increasing_id()), "numbered")

    def probe(batches: Iterator[pa.RecordBatch]):
        for b in common.slices(batches):
            query = b["query"].to_pylist()
            sizes = np.array([len(v) // 8 for v in query])
            rows, lists = [np.flatnonzero(sizes != dim)], [-sizes[sizes != dim]]
            if len(main := np.flatnonzero(sizes == dim)):
                near, d = graph.search(_matrix([query[i] for i in main]), probes, beam=max(64, probes * 5 // 4))
                r, j = np.nonzero((near >= 0) & (d <= ratio * d[:, :1] + 1e-12))
                rows.append(main[r])
                lists.append(near[r, j])
            rows = pa.array(np.concatenate(rows))
            yield common.record(PROBE, list=np.concatenate(lists).astype(np.int32), q=b["q"].take(rows), query=b["query"].take(rows))

    probed = common.saved_map(numbered, probe, PROBE, "probes")
    postings = index.postings.join(_blocks(index.postings, BLOCK_VECTORS, "nv"), "list", "left").join(_blocks(probed, BLOCK_QUERIES, "nq"), "list", "left")
    postings = postings.withColumn("block", F.pmod(F.xxhash64("vec"), F.coalesce("nv", F.lit(1)))).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.coalesce("nq", F.lit(1)) - 1)))
    probed = probed.join(_blocks(probed, BLOCK_QUERIES, "nq"), "list", "left").join(_blocks(index.postings, BLOCK_VECTORS, "nv"), "list", "left")
    probed = probed.withColumn("qblock", F.pmod("q", F.coalesce("nq", F.lit(1))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("nv", F.lit(1)) - 1)))

    def compare(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        return nearest(postings["vec"].to_pylist(), postings["ids"].combine_chunks(), wanted["q"].to_numpy(), wanted["query"].to_pylist(), k + 1)

    cells = ["list", "block", "qblock"]
    hits = postings.select(*cells, "vec", "ids").groupBy(*cells).cogroup(probed.select(*cells, "q", "query").groupBy(*cells)).applyInArrow(compare, _schema(HIT))
    # A vector lies in several lists, and an id may have several vectors.
    hits = hits.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    ordered = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    hits = hits.withColumn("at", ordered).where(F.col("at") <= k + 1).drop("at")
    found = asked.join(numbered, "query").select("query_id", "q").join(hits, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vec: list[bytes], ids: pa.Array, q: np.ndarray, query: list[bytes], k: int) -> pa.Table:
    """The nearest entries of a block for each of its queries, as many as hold k
    ids: k, times the most vectors that one id has here. Products of matrices pick
    those that can be among them, with room for their rounding; these are compared
    exactly."""
    out_q, out_at, out_d = [], [], []
    if vec and query:
        k *= int(np.unique(ids.flatten().to_numpy(), return_counts=True)[1].max())
        x, first = _matrix(vec), np.array([i[0].as_py() for i in ids])
        room = 1e-9 * (1 + (x**2).sum(axis=1).max())
        for a in range(0, len(query), 256):
            y = _matrix(query[a : a + 256])
            rough = _squares(y, x)
            bound = np.partition(rough, min(k, len(vec)) - 1, axis=1)[:, min(k, len(vec)) - 1]
            for i, (near, most) in enumerate(zip(rough, bound, strict=True)):
                some = np.flatnonzero(near <= most + room + 1e-9 * (y[i] ** 2).sum())
                with np.errstate(over="ignore"):
                    d = np.sqrt(((x[some] - y[i]) ** 2).sum(axis=1))
                best = np.lexsort((first[some], d))[:k]
                out_q.append(np.full(len(best), q[a + i]))
                out_at.append(some[best])
                out_d.append(d[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"q": join(out_q, np.int64), "ids": ids.take(pa.array(join(out_at, np.int64))).cast(HIT.field("ids").type), "score": join(out_d, np.float64)}, schema=HIT)


EMPTY = "query_id long, rank int, vec_id long, score double"


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    index = build(vectors)
    return search(index, vectors.where("vec_id % 100 = 0")) if index else spark.createDataFrame([], EMPTY)
