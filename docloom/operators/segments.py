"""A BM25 index (and vectors) that grows by segments.

Each addition writes one immutable segment; a deletion writes tombstones and what they
take from the document frequencies. Nothing else is rewritten, but for merges: where
``FANOUT`` segments are about as large, one without the dead takes their place, so a
corpus of n chunks has O(log n) segments and each chunk is rewritten O(log n) times.

A state names the segments and tombstones in force. It is a small dictionary that the
caller commits with its own tables; folders never change once written, so a reader
with an older state still reads what it names until they are removed.

Of each segment there are
  forward    document_id, chunk_id, dl, term, tf: what deletions and merges read
  postings   term, chunk_id, tf, dl: in order of terms, so that row groups can be skipped
  bounds     term, df, max_tf, min_ratio: the block maxima, least dl / tf among them
  vectors    chunk_id, document_id, vector: if vectors were given
The bound of a block, from its largest tf and least dl / tf, holds for any mean length,
so it stays right while the corpus grows.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T
from docloom.operators.bm25 import EPSILON, INDEXED, K1, B, dealt

#: So many segments of one size class become one; classes are powers of it.
FANOUT = 4
EMPTY = {"segments": [], "deletes": [], "floor": None}
#: Of the threshold, what terms that make no candidates may add up to.
SLACK = 0.35


def saturation(tf: Column, ratio: Column, avgdl: Column) -> Column:
    """A term's share before weighting, from tf and ratio = dl / tf; falls with ratio, grows with tf."""
    return (K1 + 1) / (1 + K1 * (1 - B) / tf + K1 * B * ratio / avgdl)


class SegmentedIndex:
    """The segments below ``root`` that ``state`` names."""

    def __init__(self, spark: SparkSession, root: str, state: dict | None = None):
        self.spark, self.root, self.state = spark, root.rstrip("/"), json.loads(json.dumps(state or EMPTY))

    # ------------------------------------------------------------------ changes

    def add(self, chunks: DataFrame, text: Column, vectors: DataFrame | None = None) -> SegmentedIndex:
        """The index with chunks (document_id, chunk_id; ids that are not live in it)
        as one more segment, and with merges where they are due. vectors: document_id, chunk_id, vector.
        Texts are dealt by chunk, INDEXED characters a task, and their terms counted where they are cut."""
        texts = chunks.select("document_id", "chunk_id", text.alias("text"))
        texts = texts.repartition(int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // INDEXED + 1, "chunk_id")
        tokens = texts.select("document_id", "chunk_id", T.tokenize("text").alias("tokens"))
        tokens = tokens.withColumn("dl", F.size("tokens")).select("document_id", "chunk_id", "dl", F.explode_outer("tokens").alias("term"))
        forward = tokens.groupBy("document_id", "chunk_id", "dl", "term").agg(F.count("term").alias("tf"))
        new = self._write(forward, vectors)
        return self._with([*self.state["segments"], *new], self.state["deletes"])._merged()

    def delete(self, documents: DataFrame) -> SegmentedIndex:
        """The index without the chunks of documents (document_id)."""
        if not self.state["segments"]:
            return self
        gone = self.forward().join(documents.select("document_id").distinct(), "document_id", "left_semi")
        gone = scratch.saved(gone.select("seg", "chunk_id", "dl", "term"), "gone")
        name = f"deletes/{uuid.uuid4().hex[:12]}"
        per = scratch.saved(gone.select("seg", "chunk_id", "dl").distinct(), "dead")
        count = {r["seg"]: [r["n"], r["tokens"]] for r in per.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")).collect()}  # a row a segment
        if not count:
            return self
        per.select("seg", "chunk_id").write.parquet(f"{self.root}/{name}/chunks")
        gone.where("term is not null").groupBy("seg", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{self.root}/{name}/terms")
        segments = [s | {"dead": s["dead"] + count.get(s["id"], [0, 0])[0], "dead_tokens": s["dead_tokens"] + count.get(s["id"], [0, 0])[1]} for s in self.state["segments"]]
        return self._with(segments, [*self.state["deletes"], name])._merged()

    def _write(self, forward: DataFrame, vectors: DataFrame | None) -> list[dict]:
        """A new segment from its forward rows; none if there are none."""
        name = f"segments/{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}"
        forward.sortWithinPartitions("document_id", "chunk_id").write.parquet(f"{path}/forward")
        forward = self.spark.read.schema(forward.schema).parquet(f"{path}/forward")
        size = forward.select("chunk_id", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")).first()
        if not size["n"]:
            return []
        postings = forward.where("term is not null")
        # A common word's postings are cut into ranges of chunks, so no task has them all.
        postings.select("term", "chunk_id", "tf", "dl").repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/postings")
        postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min(F.col("dl") / F.col("tf")).alias("min_ratio")).write.parquet(f"{path}/bounds")
        if vectors is not None:
            vectors.select("document_id", "chunk_id", "vector").write.parquet(f"{path}/vectors")
        return [{"id": name, "chunks": size["n"], "tokens": size["tokens"] or 0, "dead": 0, "dead_tokens": 0, "vectors": vectors is not None}]

    def _with(self, segments: list[dict], deletes: list[str]) -> SegmentedIndex:
        """The index of other segments, with the floor of its weights: a figure of the
        whole vocabulary, so bounds are read (postings are not)."""
        out = SegmentedIndex(self.spark, self.root, {"segments": segments, "deletes": deletes if segments else [], "floor": None})
        if segments:
            out.state["floor"] = out._raw(out._frequencies()).agg(F.avg("raw")).first()[0]
        return out

    def _merged(self) -> SegmentedIndex:
        """Merge while a size class is full, and segments that are half dead."""
        out = self
        while True:
            classes: dict[int, list[dict]] = {}
            for s in out.state["segments"]:
                level, size = 0, max(1, s["chunks"] - s["dead"])
                while size >= FANOUT:
                    level, size = level + 1, size // FANOUT
                classes.setdefault(level, []).append(s)
            due = next((v for v in classes.values() if len(v) >= FANOUT), None) or [s for s in out.state["segments"] if 2 * s["dead"] >= s["chunks"]]
            if not due:
                return out
            out = out._merge([s["id"] for s in due])

    def _merge(self, ids: list[str]) -> SegmentedIndex:
        """One segment, without the dead, in place of those."""
        part = SegmentedIndex(self.spark, self.root, self.state | {"segments": [s for s in self.state["segments"] if s["id"] in ids]})
        vectors = part.vectors() if all(s["vectors"] for s in part.state["segments"]) else None
        new = self._write(part.alive(part.forward()).drop("seg"), vectors)
        return self._with([*(s for s in self.state["segments"] if s["id"] not in ids), *new], self.state["deletes"])

    # -------------------------------------------------------------------- tables

    def paths(self) -> list[str]:
        """The folders in force, below the root."""
        return [*(s["id"] for s in self.state["segments"]), *self.state["deletes"]]

    def _tables(self, what: str) -> DataFrame:
        """One kind of table of all segments, with the segment's name as seg."""
        each = [self.spark.read.parquet(f"{self.root}/{s['id']}/{what}").withColumn("seg", F.lit(s["id"])) for s in self.state["segments"]]
        return functools.reduce(DataFrame.unionByName, each)

    def _deletes(self, what: str) -> DataFrame | None:
        """One kind of table of all tombstones, of live segments."""
        if not self.state["deletes"]:
            return None
        live = [s["id"] for s in self.state["segments"]]
        return self.spark.read.parquet(*[f"{self.root}/{d}/{what}" for d in self.state["deletes"]]).where(F.col("seg").isin(live))

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (seg, chunk_id, ...) without those of dead chunks."""
        dead = self._deletes("chunks")
        return rows if dead is None else rows.join(dead, ["seg", "chunk_id"], "left_anti")

    def forward(self) -> DataFrame:
        return self.alive(self._tables("forward"))

    def vectors(self) -> DataFrame:
        return self.alive(self._tables("vectors")).drop("seg")

    @property
    def chunks(self) -> int:
        return sum(s["chunks"] - s["dead"] for s in self.state["segments"])

    @property
    def tokens(self) -> int:
        return sum(s["tokens"] - s["dead_tokens"] for s in self.state["segments"])

    # ------------------------------------------------------------------- weights

    def _frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df over live chunks; of some terms (term) only."""
        df, less = self._tables("bounds").select("term", "df"), self._deletes("terms")
        if less is not None:
            df = df.unionByName(less.select("term", (-F.col("df")).alias("df")))
        if terms is not None:
            df = df.join(terms, "term", "left_semi")
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _raw(self, df: DataFrame) -> DataFrame:
        return df.select("term", "df", (F.log(F.lit(self.chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))

    def weights(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df, idf: what a build of the live chunks at once would give."""
        floor = EPSILON * (self.state["floor"] or 0.0)
        return self._raw(self._frequencies(terms)).select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))

    # -------------------------------------------------------------------- search

    def search(self, queries: DataFrame, k: int = 30, allowed: DataFrame | None = None, chunks: DataFrame | None = None, worth: int = 200_000_000) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best of each query (query_id, query)
        with a positive score; ties by chunk_id. allowed: (query_id, chunk_id) to keep;
        chunks: chunk_id to keep for all queries.

        Where a batch has ``worth`` postings to score or more, queries for which it pays
        skip those of common words: a first round of the rarest words gives each a
        threshold that its k-th best reaches; words whose bounds together stay below
        make no candidates, and are looked up only for candidates that could still
        reach it. Results are the same; below that, its rounds cost more than they save."""
        q = queries.select("query_id", F.explode(T.tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        if not self.state["segments"]:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double, rank int")
        q = scratch.saved(q, "terms")
        weights = self.weights(q.select("term").distinct())
        q = scratch.saved(q.join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df"), "weighted")
        if allowed is not None or chunks is not None or (q.agg(F.sum("df")).first()[0] or 0) < worth:
            return self._best(self._scores(q, allowed, chunks), k)
        plan = scratch.saved(self.plan(q, k), "plan")
        whole = plan.where("not pruned").select("query_id", "term", "w", "df")
        some = plan.where("pruned")
        if some.isEmpty():
            return self._best(self._scores(whole), k)
        likely = self._scores(some.where("essential").select("query_id", "term", "w", "df"))
        rest = some.where("not essential").groupBy("query_id").agg(F.sum("bound").alias("rest"))
        limit = some.select("query_id", "least").distinct().join(rest, "query_id", "left")
        likely = likely.join(limit, "query_id").where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("least") - 1e-9).select("seg", "query_id", "chunk_id", "score")
        return self._best(self._scores(whole).unionByName(self._completed(likely, some.where("not essential").select("query_id", "term", "w"))), k)

    def plan(self, q: DataFrame, k: int, first: int = 64) -> DataFrame:
        """query_id, term, w, df, bound, least, essential, pruned of each query's terms (query_id,
        term, w, df: a written table). least: what its k-th best reaches. A query is pruned if
        its essential terms have at most half of its postings."""
        avgdl = F.lit(self.tokens / max(1, self.chunks))
        terms = q.select("term").distinct()
        top = self._tables("bounds").join(terms, "term", "left_semi").groupBy("term").agg(F.max(saturation(F.col("max_tf"), F.col("min_ratio"), avgdl)).alias("top"))
        q = scratch.saved(q.join(top, "term").withColumn("bound", F.col("w") * F.col("top")), "bounds")
        rare = Window.partitionBy("query_id").orderBy("df", "term")
        # The rarest terms, of so many postings at most, and the rarest at any rate.
        seeds = q.withColumns({"seen": F.sum("df").over(rare), "at": F.row_number().over(rare)}).where((F.col("seen") <= first * k) | (F.col("at") == 1))
        near = self._best(self._scores(seeds.select("query_id", "term", "w", "df")), 2 * k, "seg")
        others = q.join(seeds.select("query_id", "term"), ["query_id", "term"], "left_anti").select("query_id", "term", "w")
        full = self._best(self._completed(near.select("seg", "query_id", "chunk_id", "score"), others), k)
        least = full.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        cheap = Window.partitionBy("query_id").orderBy(F.col("bound") / F.col("df"), "term")
        every = Window.partitionBy("query_id")
        plan = q.join(least, "query_id", "left").withColumn("essential", F.coalesce(F.sum("bound").over(cheap) >= SLACK * F.col("least"), F.lit(True)))
        few = 2 * F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).over(every) <= F.sum("df").over(every)
        return plan.withColumn("pruned", few & (F.min("w").over(every) > 0)).select("query_id", "term", "w", "df", "bound", "least", "essential", "pruned")

    def _part(self) -> Column:
        return F.col("w") * saturation(F.col("tf"), F.col("dl") / F.col("tf"), F.lit(self.tokens / max(1, self.chunks)))

    def _scores(self, q: DataFrame, allowed: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
        """seg, query_id, chunk_id, score of all live chunks with a term of q (query_id,
        term, w, df). Postings are dealt by chunk, and lose the dead, before they meet the
        queries: nothing of the product of both is shuffled, and a task scores few chunks."""
        n, q = dealt(q)
        hits = self._tables("postings").join(q.select("term").distinct(), "term", "left_semi")
        if chunks is not None:
            hits = hits.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        hits, dead = hits.repartition(n, "chunk_id"), self._deletes("chunks")
        if dead is not None:
            by_chunk = dead.repartition(n, "chunk_id").groupBy("chunk_id").agg(F.collect_set("seg").alias("dead"))
            hits = hits.join(by_chunk, "chunk_id", "left").where("dead is null or not array_contains(dead, seg)").drop("dead")
        hits = hits.join(q.drop("df"), "term")
        if allowed is not None:
            hits = hits.join(allowed, ["query_id", "chunk_id"], "left_semi")
        return hits.groupBy("seg", "query_id", "chunk_id").agg(F.sum(self._part()).alias("score")).where("score > 0")

    def _completed(self, found: DataFrame, others: DataFrame) -> DataFrame:
        """found (seg, query_id, chunk_id, score) with the shares of others (query_id, term, w) added."""
        found = scratch.saved(found, "found")
        wanted = found.select("seg", "query_id", "chunk_id").join(others, "query_id")
        more = self._tables("postings").join(others.select("term").distinct(), "term", "left_semi").join(wanted, ["seg", "term", "chunk_id"])
        more = more.select("seg", "query_id", "chunk_id", self._part().alias("score"))
        return found.unionByName(more).groupBy("seg", "query_id", "chunk_id").agg(F.sum("score").alias("score"))

    @staticmethod
    def _best(scores: DataFrame, k: int, *more: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
        return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", *more)
