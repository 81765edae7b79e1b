"""Okapi BM25 as an inverted index of DataFrames.

postings(term, chunk_id, tf), term_stats(term, df, idf) and lengths(chunk_id, dl)
replace a scan of all documents: a search joins only the postings of its query
terms. A batch of queries runs as one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T

#: Fixed values of Okapi BM25: saturation, length normalisation, floor for common terms.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings, each once for every query with its term, that a task scores on average; query terms up to which they are broadcast.
SCORED, BROADCAST = 1_000_000, 1_000_000
#: Characters of texts that a task of a build counts the terms of, on average.
INDEXED = 8_000_000


def index_text(content: Column, *extras: Column, entities: Column | None = None) -> Column:
    """What is indexed of a chunk: its content, other fields, entities also without marks; empty ones left out."""
    parts = [F.array(content, *extras)]
    if entities is not None:
        parts += [entities, F.transform(entities, T.strip_diacritics)]
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


@dataclass
class Bm25Index:
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    corpus: DataFrame  # one row: n, avgdl

    def write(self, path: str) -> None:
        """Postings go out sorted by term within files, so that a term's row groups can be skipped to."""
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("terms", "lengths", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "lengths", "corpus")))


def build(chunks: DataFrame, id_col: str, text: Column) -> Bm25Index:
    """Index of all chunks. Texts are cut once: postings are written, and all
    figures come from them. The floor for terms in over half of the chunks needs the
    mean idf of all terms. Texts are dealt by chunk, INDEXED characters a task, so terms
    are counted where they are cut, and few at a time."""
    texts = chunks.select(F.col(id_col).alias("chunk_id"), text.alias("text"))
    texts = texts.repartition(int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // INDEXED + 1, "chunk_id")
    tokens = texts.select("chunk_id", F.explode_outer(T.tokenize("text")).alias("term"))
    postings = scratch.saved(tokens.groupBy("term", "chunk_id").agg(F.count("term").alias("tf")), "postings")
    lengths = scratch.saved(postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl")), "lengths")
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = postings.where("term is not null")  # the row of a chunk without any term
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(corpus), how="cross").select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    terms = raw.join(F.broadcast(floor), how="cross").select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, scratch.saved(terms, "terms"), lengths, scratch.saved(corpus, "corpus"))


def dealt(q: DataFrame) -> tuple[int, DataFrame]:
    """How many tasks the postings of weighted query terms (written, with df) are dealt to, so
    that one scores SCORED of them on average; and the terms, broadcast while they are few."""
    rows, work = q.agg(F.count(F.lit(1)), F.sum("df")).first()
    return max(1, -(-int(work or 0) // SCORED)), F.broadcast(q) if rows <= BROADCAST else q


def scores(index: Bm25Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks with a query term. Query terms
    count as often as they occur. allowed: (query_id, chunk_id) to keep, joined before scoring."""
    q = queries.select("query_id", F.explode(T.tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = scratch.saved(q.join(index.terms.select("term", "idf", "df"), "term"), "weights")
    n, q = dealt(q)
    # Postings are dealt by chunk before the queries come: nothing of the product is shuffled,
    # and a task holds the scores of few chunks, however many there are in all.
    lengths = index.lengths.repartition(n, "chunk_id")
    if allowed is not None:
        by_chunk = allowed.repartition(n, "chunk_id").groupBy("chunk_id").agg(F.collect_set("query_id").alias("of"))
        lengths = lengths.join(by_chunk, "chunk_id")
    hits = index.postings.join(q.select("term").distinct(), "term", "left_semi").repartition(n, "chunk_id").join(lengths, "chunk_id").join(q, "term")
    if allowed is not None:
        hits = hits.where(F.array_contains("of", F.col("query_id")))
    hits = hits.join(F.broadcast(index.corpus), how="cross")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def search(index: Bm25Index, queries: DataFrame, k: int = 30, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best with a positive score; ties by chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scores(index, queries, allowed).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
