"""Dense vectors: embedding with a cache, and exact cosine search.

Embedders are plain functions from texts to unit vectors; hashing_embedder() is
the deterministic stand-in where no model is at hand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions import text as T

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 128) -> Embedder:
    """Bag of lower-case words in MD5 buckets, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                row[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def _in_batches(embed: Embedder, texts: list[str], size: int) -> np.ndarray:
    """Embed in batches; on running out of memory in smaller ones, down to one in eight."""
    for _ in range(4):
        try:
            return np.concatenate([embed(texts[a : a + size]) for a in range(0, len(texts), size)]) if texts else np.zeros((0, 0), np.float32)
        except (MemoryError, RuntimeError) as e:
            if size == 1 or (isinstance(e, RuntimeError) and "out of memory" not in str(e).lower()):
                raise
            size = max(1, size // 2)
    raise MemoryError("embedding failed in small batches too")


def encode(df: DataFrame, text_col: str, embed: Embedder, out: str = "vector", instruction: str = "", batch: int = 64) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(_in_batches(embed, [instruction + (t or "") for t in texts], batch)))

    return df.withColumn(out, run(F.col(text_col)))


def cache_key(text: Column, model: str, revision: str = "default") -> Column:
    return T.text_sha1(F.concat(F.lit(f"{model}@{revision}|"), text))


def cache_misses(df: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key the cache lacks."""
    return df.join(cache.select(key), key, "left_anti")


def encode_cached(df: DataFrame, text_col: str, cache: DataFrame, embed: Embedder, model: str) -> tuple[DataFrame, DataFrame]:
    """(df with vector, rows to add to the cache): only texts that the cache lacks are embedded, each once."""
    keyed = df.withColumn("cache_key", cache_key(F.col(text_col), model))
    new = encode(cache_misses(keyed, cache).dropDuplicates(["cache_key"]).select("cache_key", text_col), text_col, embed)
    new = new.select("cache_key", F.lit(model).alias("model"), "vector")
    return keyed.join(cache.select("cache_key", "vector").unionByName(new.select("cache_key", "vector")), "cache_key"), new


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Vectors that are compared with a block of queries at a time.
SLICE_ROWS = 1024
#: Queries of a cell, at least; of these SLICE_ROWS are scored at a time.
CELL_QUERIES = 16_384


def search(vectors: DataFrame, queries: DataFrame, k: int = 30, block: int = 4096, vector_block: int = 65_536) -> DataFrame:
    """query_id, chunk_id, score, rank: exact cosine search of all queries
    (query_id, vector) over all vectors (chunk_id, vector), ties by chunk_id; rows
    without a vector take no part. Up to ``block`` queries go to the tasks that read
    the vectors, which are not shuffled then. More are dealt into blocks of that size or of
    CELL_QUERIES, whichever is more, as each block of queries has a copy of all vectors;
    vectors into blocks of ``vector_block``, and each pair of blocks meets in a cell of
    its own. A task or cell keeps its k best for each query, so what is merged grows
    with queries and blocks, not with pairs. For large corpora use an approximate index."""
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    vectors, queries = (df.select(i, "vector").where("vector is not null") for df, i in ((vectors, "chunk_id"), (queries, "query_id")))
    rows = queries.limit(block + 1).collect()
    if len(rows) <= block:
        found = vectors.mapInPandas(_scan([r["query_id"] for r in rows], _unit(np.array([r["vector"] for r in rows], np.float64)), k), schema) if rows else vectors.limit(0).mapInPandas(lambda batches: iter(()), schema)
    else:
        found = _grid(vectors, queries, k, max(block, CELL_QUERIES), vector_block, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _grid(vectors: DataFrame, queries: DataFrame, k: int, block: int, vector_block: int, schema: str) -> DataFrame:
    """The k best of each pair of a block of queries and a block of vectors. Blocks are
    dealt by a hash of the id, so none holds much more than its share."""
    down, across = (max(1, -(-df.count() // size)) for df, size in ((vectors, vector_block), (queries, block)))
    dealt = lambda df, i, own, n, other, m: df.withColumns({own: F.pmod(F.xxhash64(i), F.lit(n)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})
    # Another name than the vectors', as both sides may come from one table.
    queries = queries.withColumnRenamed("vector", "asked_")
    left, right = dealt(vectors, "chunk_id", "v_", down, "q_", across), dealt(queries, "query_id", "q_", across, "v_", down)

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def cell(some: pa.Table, asked: pa.Table) -> pa.Table:
        if "vector" not in some.column_names or "asked_" not in asked.column_names:  # a block without rows comes without columns
            return kinds.empty_table()
        q, ids, x = _unit(_matrix(asked["asked_"])), some["chunk_id"].to_numpy(), _matrix(some["vector"])
        out = []
        for a in range(0, len(q), SLICE_ROWS):
            best = _Best(q[a : a + SLICE_ROWS], k)
            for at in range(0, len(ids), SLICE_ROWS):
                best.add(ids[at : at + SLICE_ROWS], x[at : at + SLICE_ROWS])
            i, chunk, score = best.result()
            out.append(pa.table({"query_id": asked["query_id"].take(pa.array(a + i)), "chunk_id": pa.array(chunk, some.schema.field("chunk_id").type), "score": pa.array(score, pa.float64())}))
        return pa.concat_tables(out)

    return left.groupBy("v_", "q_").cogroup(right.groupBy("v_", "q_")).applyInArrow(cell, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else x


class _Best:
    """The k best of the vectors seen so far, for each row of a matrix of unit queries."""

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k = matrix, k
        self.least = np.full(len(matrix), -np.inf)  # what a score must reach to be among the k best
        self.best = pd.DataFrame({"i": [], "chunk_id": [], "score": [], "near": []})

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        s, k = self.matrix @ _unit(x).T, self.k
        near = s.round(12)
        if near.shape[1] >= k:
            self.least = np.maximum(self.least, np.partition(near, -k, axis=1)[:, -k])
        i, j = np.nonzero(near >= self.least[:, None])
        new = pd.DataFrame({"i": i, "chunk_id": ids[j], "score": s[i, j], "near": near[i, j]})
        best = pd.concat([self.best, new]) if len(self.best) else new
        self.best = best.sort_values(["near", "chunk_id"], ascending=[False, True]).groupby("i", sort=False).head(k)
        full = self.best.groupby("i")["near"].agg(["size", "min"])
        full = full[full["size"] == k]
        self.least[full.index] = np.maximum(self.least[full.index], full["min"])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.best["i"].to_numpy().astype(np.int64), self.best["chunk_id"].to_numpy(), self.best["score"].to_numpy()


def _scan(names: list, matrix: np.ndarray, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The k best vectors of a task for each of a block of queries."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(matrix, k)
        for b in batches:
            for at in range(0, len(b), SLICE_ROWS):
                part = b.iloc[at : at + SLICE_ROWS]
                best.add(part["chunk_id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64))
        i, chunk, score = best.result()
        if len(i):
            yield pd.DataFrame({"query_id": [names[n] for n in i], "chunk_id": chunk, "score": score})

    return scan
