"""The two pipelines around one corpus: ingestion writes it, retrieval reads it.

Models are functions: an embedder (texts to unit vectors), a reranker (question and
text to a score), a generator (system and user prompt to text). All have
deterministic stand-ins. Questions come as tables, so that a batch is one plan.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schema, scratch
from docloom.functions import prompts
from docloom.functions import text as T
from docloom.operators import bm25, chunking, compute, context, dense, evaluation, graph, models, profile, retrieval, segments
from docloom.plans.config import PipelineConfig
from docloom.plans.store import Store
from docloom.sources import files, jsonl, office

#: Fixed value: the answer where the documents say too little.
REFUSAL = "Tôi không tìm thấy đủ thông tin trong tài liệu được cung cấp."

Generator = Callable[[str, str], str]
Planner = Callable[[str], str]
#: The columns of an answer, and the fields of a value that was computed for it.
ANSWER = ["query_id", "query", "answer", "source_ids", "invalid_source_ids", "citations", "citation_valid", "refused", "reason", "unsupported_numbers", "injection", "computed"]
COMPUTED_FIELDS = ["operation", "block_id", "column", "value", "filters", "label_of_extreme", "rows_used"]
COMPUTED = "struct<operation:string,block_id:string,column:string,value:double,filters:array<struct<name:string,value:string>>,label_of_extreme:string,rows_used:bigint>"
PLAN_FILTERS = ["source_file", "sheet_name", "chunk_type"]


class PipelineModeError(RuntimeError):
    """A frozen corpus can't be written, an unfrozen one can't be queried."""


def quoting_generator(system: str, user: str) -> str:
    """Stand-in for a language model: the first source's first line, with its id."""
    import re

    m = re.search(r"\[(SOURCE_\d+)\]\n(?:.*\n)*?content:\n(.*)", user)
    return json.dumps({"answer": f"{m.group(2)} [{m.group(1)}]", "source_ids": [m.group(1)]} if m else {"answer": REFUSAL, "source_ids": []}, ensure_ascii=False)


class _Pipeline:
    def __init__(self, spark: SparkSession, config: PipelineConfig | None = None, embed: dense.Embedder | None = None):
        self.spark, self.config = spark, config or PipelineConfig()
        self.embed = embed or dense.hashing_embedder()
        self.store = Store(spark, self.config.work_dir, self.config.buckets)

    @property
    def index(self) -> segments.SegmentedIndex:
        """The index in force: postings and vectors, in segments."""
        return segments.SegmentedIndex(self.spark, f"{self.store.folder.uri}/index", self.store.setting("index.state"))


class IngestionPipeline(_Pipeline):
    def ingest(self, paths: list[str], reset: bool = False) -> dict:
        """Read files, folders and archives into the corpus and index them. Bad
        files are reported and don't stop the others. Returns the report."""
        if self.store.manifest["frozen"]:
            raise PipelineModeError("the corpus is frozen")
        lock = Path(self.config.work_dir) / ".lock"
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise PipelineModeError("another ingestion is running") from None
        try:
            return self._ingest(paths, reset)
        finally:
            lock.unlink()

    def _ingest(self, paths: list[str], reset: bool) -> dict:
        c, run_id, began = self.config, uuid.uuid4().hex, time.time()
        if reset:
            self.store.reset()
        found = files.expand_archives(files.discover(self.spark, paths), c.ingestion.max_archive_mb, c.ingestion.max_archive_files)
        found = found.withColumn("skip", files.skip_reason())
        # Names and hashes are kept; contents are read again where they are parsed.
        checked = scratch.saved(files.validate(found.where("skip is null").drop("skip"), c.ingestion.max_file_mb).drop("content"), "checked")
        good = checked.where("error_code is null")
        known = self.store.table("documents")
        new = files.new_versions(good, known.select(F.col("original_name").alias("name"), "content_hash")) if known is not None else good.dropDuplicates(["name", "content_hash"])
        new = new.withColumn("stored", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("__"), F.substring("content_hash", 1, 12), F.col("extension")))
        new = scratch.saved(new.withColumn("document_id", T.stable_id(F.col("stored"), F.col("content_hash"))), "new")
        contents = found.where("skip is null and content is not null").select("path", "content").join(new.select("path", "document_id", F.col("stored").alias("name")), "path")
        blocks = scratch.saved(office.parse(contents.select("document_id", "name", "content")), "parsed")
        bad = blocks.where("block_type = 'error'")
        sound = blocks.join(bad.select("document_id"), "document_id", "left_anti")
        edges, full = graph.build(sound)
        full = scratch.saved(full, "blocks")
        profiles, entities = profile.build(sound)
        k = c.chunking
        chunks = chunking.chunk(full, k.text_chunk_chars, k.table_inline_max_chars, k.table_preview_rows, k.table_preview_columns, k.visual_max_chars)
        chunks = scratch.saved(profile.attach(chunks, profiles, entities), "chunks")
        own = F.when(F.col("inherited_header").isNotNull(), F.concat(F.array("inherited_header"), "rows")).otherwise(F.col("rows"))
        large = chunks.where("table_file is not null").select("table_file", F.col("block_ids")[0].alias("block_id")).distinct()
        workbooks = self.store.write_workbooks(large.join(full.select("block_id", own.alias("rows")), "block_id"))
        meta = new.join(bad.select("document_id"), "document_id", "left_anti").select("document_id", F.col("stored").alias("source_file"), F.col("name").alias("original_name"), F.col("extension").alias("file_type"), "content_hash")
        documents = meta.join(profiles, "document_id", "left")
        self.store.write({"documents": documents, "blocks": full, "chunks": chunks, "entities": entities, "edges": edges})
        stored = self.store.stats()
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        line = lambda df, stage, status, code, message: df.select(
            F.lit(run_id).alias("run_id"), "document_id", "source_file", F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.expr(code).alias("error_code"), F.expr(message).alias("message"), F.lit(False).alias("retryable"), F.lit(None).cast("double").alias("duration_ms"), F.lit(now).alias("created_at"),
        )
        none = "cast(null as string)"
        wrong = checked.where("error_code is not null").select(F.lit(None).cast("string").alias("document_id"), F.col("name").alias("source_file"), "error_code")
        skipped = good.join(new.select("name", "content_hash"), ["name", "content_hash"], "left_anti").select(F.lit(None).cast("string").alias("document_id"), F.col("name").alias("source_file"))
        statuses = line(documents, "parse", "success", none, none).unionByName(line(bad, "parse", "failed", "'parse_error'", "content")).unionByName(line(wrong, "parse", "failed", "error_code", none)).unionByName(line(skipped, "parse", "skipped", none, none))
        self.store.append("status", statuses)
        if stored["chunks"]:
            self.update_index(scratch.saved(documents.select("document_id"), "changed"))
        seconds = time.time() - began
        self.store.append("status", self.spark.createDataFrame([(run_id, None, None, "index", "success", None, None, False, seconds * 1000, now)], schema.STATUS))
        counts = {r["stage_status"]: r["count"] for r in evaluation.status_counts(self.store.log("status").where(F.col("run_id") == run_id)).collect()}
        self.store.save_parsed(full, run_id)
        report = {"run_id": run_id, "counts": counts, "stats": stored, "workbooks": workbooks, "seconds": round(seconds, 2)}
        self.store.write_run(run_id, report | {"inputs": paths, "config": c.to_dict(), "created_at": now})
        return report

    def build_index(self) -> None:
        """Index all chunks anew, as one segment."""
        self._switch(self._added(segments.SegmentedIndex(self.spark, self.index.root), self.store.table("chunks")))

    def update_index(self, changed: DataFrame) -> None:
        """Take the documents of changed (document_id) out of the index and add what the
        corpus holds of them now, as one segment. Segments of other documents are left
        alone but for merges. A corpus indexed with another model is indexed anew."""
        if self.store.setting("index.model") not in (None, self.config.retrieval.dense_model):
            return self.build_index()
        self._switch(self._added(self.index.delete(changed), self.store.table("chunks").join(changed, "document_id", "left_semi")))

    def _added(self, index: segments.SegmentedIndex, chunks: DataFrame) -> segments.SegmentedIndex:
        """index with the chunks; only texts whose vector is not cached are embedded."""
        r = self.config.retrieval
        cache = self.store.log("embedding_cache").where(F.col("model") == r.dense_model) if self.store.folder.exists("embedding_cache") else self.spark.createDataFrame([], "cache_key string, model string, vector array<float>")
        vectors, fresh = dense.encode_cached(chunks.select("chunk_id", "document_id", "content"), "content", cache, self.embed, r.dense_model)
        vectors = scratch.saved(vectors.select("chunk_id", "document_id", "vector"), "vectors")
        self.store.append("embedding_cache", fresh)
        text = chunks.join(self.store.table("documents").select("document_id", "title"), "document_id", "left")
        return index.add(text, bm25.index_text(F.col("content"), F.col("source_file"), F.col("title"), F.array_join("keywords", "\n"), entities=F.col("entities")), vectors)

    def _switch(self, index: segments.SegmentedIndex) -> None:
        newest = index.state["segments"][-1]["id"] if index.state["segments"] else "none"
        self.store.set_settings({"index.state": index.state, "index.version": f"index/{newest}", "index.model": self.config.retrieval.dense_model})

    def delete(self, document_ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        self.store.delete(gone)
        self._switch(self.index.delete(gone))

    def freeze(self) -> dict:
        r = self.config.retrieval
        return self.store.freeze({"embedding_model": r.dense_model, "instruction": r.dense_query_instruction, "chunking": self.config.to_dict()["chunking"]})


class RetrievalAnswerPipeline(_Pipeline):
    """Reads a frozen corpus; with ``frozen=False`` one that still grows."""

    def __init__(self, spark, config=None, embed=None, score=retrieval.token_overlap, generate: Generator = quoting_generator, planner: Planner | None = None, frozen: bool = True, profile: ResourceProfile | None = None):
        """``generate`` may be a models.PerWorker; ``profile`` is what its stage asks of executors."""
        super().__init__(spark, config, embed)
        self.score, self.generate, self.planner, self.profile = score, generate, planner, profile
        if frozen and (wrong := self.store.validate({"embedding_model": self.config.retrieval.dense_model})):
            raise PipelineModeError("; ".join(wrong))
        if self.store.setting("index.model") != self.config.retrieval.dense_model:
            raise PipelineModeError("the corpus was indexed with another embedding model")

    def _questions(self, questions: list[str] | DataFrame) -> DataFrame:
        if isinstance(questions, DataFrame):
            return questions
        return self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")

    def plan(self, questions: list[str] | DataFrame) -> DataFrame:
        """query_id, query, semantic_queries, keyword_query and filters (source_file,
        sheet_name, chunk_type) of each question, from the planner's JSON; what the
        question does not support is dropped. Without a planner all are empty."""
        q, planner = self._questions(questions).select("query_id", "query"), self.planner
        kind = "semantic_queries array<string>, keyword_query string, source_file string, sheet_name string, content_type string"

        def ask(batches):
            for b in batches:
                yield b.assign(plan=[planner(x) for x in b["query"]])

        raw = q.mapInPandas(ask, "query_id long, query string, plan string") if planner else q.withColumn("plan", F.lit("{}"))
        p = raw.select("query_id", "query", F.from_json(F.to_json(T.parse_json_object("plan")), kind).alias("p")).select("query_id", "query", "p.*")
        # What is known of the corpus is looked up by the names that were asked for, not sent along.
        chunks = self.store.table("chunks")
        p = p.join(chunks.select("source_file", F.col("source_file").alias("file_")).distinct(), "source_file", "left").join(chunks.where("sheet_name <> ''").select("sheet_name", F.col("sheet_name").alias("sheet_")).distinct(), "sheet_name", "left")
        return retrieval.sanitize_plan(p.withColumns({"known_files": F.array("file_"), "known_sheets": F.array("sheet_")}), self.config.retrieval.max_variants)

    def retrieve(self, questions: list[str] | DataFrame, filters: dict | None = None, boost: bool = False, top_k: int | None = None, plans: DataFrame | None = None) -> DataFrame:
        """query_id, query, rank, rerank_score, rrf_score, dense_rank, sparse_rank and the chunk's columns.

        ``plans`` (of plan()) add rankings by other wordings and by keywords, and
        filters for single questions; ``boost`` adds rankings within the documents
        whose names a question holds."""
        r, q = self.config.retrieval, self._questions(questions)
        chunks = self.store.table("chunks")
        allowed = retrieval.filter_chunks(chunks, filters) if filters else None
        index = self.index
        vectors = index.vectors()
        if allowed is not None:
            vectors = vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        within = None  # (query_id, chunk_id) of questions with filters of their own
        worded = q.select("query_id", F.lit(0).alias("v"), "query")
        keywords = worded.limit(0)
        if plans is not None:
            plans = scratch.saved(plans, "plans")
            worded = plans.select("query_id", F.posexplode(retrieval.variants(F.col("query"), F.col("semantic_queries"))).alias("v", "query"))
            keywords = plans.where("keyword_query is not null").select("query_id", F.lit(-1).alias("v"), F.col("keyword_query").alias("query"))
            narrow = plans.where(F.coalesce("source_file", "sheet_name", "chunk_type").isNotNull()).select("query_id", *[F.col(c).alias(f"want_{c}") for c in PLAN_FILTERS])
            within = scratch.saved(_within(narrow, chunks), "within")
            worded = worded.join(narrow.select("query_id", F.lit(True).alias("narrow")), "query_id", "left")
        else:
            worded = worded.withColumn("narrow", F.lit(None).cast("boolean"))
        # Each wording is a search of its own; its key leads back to the question.
        key = F.concat_ws("|", "query_id", "v")
        asked = scratch.saved(dense.encode(worded.withColumn("key", key), "query", self.embed, instruction=r.dense_query_instruction), "asked")
        back = asked.select("query_id", "key", "narrow").unionByName(keywords.select("query_id", key.alias("key"), F.lit(None).cast("boolean").alias("narrow")))
        kinds = lambda df, kind: df.withColumnRenamed("query_id", "key").join(back, "key").select("query_id", F.lit(kind).alias("kind"), "chunk_id", "rank")
        texts = asked.select(F.col("key").alias("query_id"), "query", "narrow").unionByName(keywords.select(key.alias("query_id"), "query", F.lit(None).cast("boolean").alias("narrow")))
        free = asked.where("narrow is null").select(F.col("key").alias("query_id"), "vector")
        rankings = kinds(dense.search(vectors, free, r.dense_top_k), "dense").unionByName(kinds(index.search(texts.where("narrow is null"), r.sparse_top_k, chunks=allowed), "sparse"))

        def inside(pairs: DataFrame, some: DataFrame) -> DataFrame:
            """Both rankings of some (query_id, key, query, vector) within pairs (query_id, chunk_id)."""
            keyed = pairs.join(some.select("query_id", "key"), "query_id").select(F.col("key").alias("query_id"), "chunk_id")
            sparse = index.search(some.select(F.col("key").alias("query_id"), "query"), r.sparse_top_k, keyed, allowed)
            near = keyed.join(vectors, "chunk_id").join(some.select(F.col("key").alias("query_id"), F.col("vector").alias("v")), "query_id")
            order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id"))
            near = near.withColumn("s", F.round(dense.cosine(F.col("vector"), F.col("v")), 12)).withColumn("rank", order).where(F.col("rank") <= r.dense_top_k)
            return kinds(sparse, "sparse").unionByName(kinds(near, "dense"))

        if within is not None:
            rankings = rankings.unionByName(inside(within, asked.where("narrow")))
        if boost and r.entity_boost and "document_id" not in (filters or {}):
            named = retrieval.match_entities(q, self.store.table("entities").select("document_id", "canonical", F.col("key").alias("norm_key"))).select("query_id", "document_id").distinct()
            about = named.join(chunks.select("document_id", "chunk_id"), "document_id").select("query_id", "chunk_id")
            rankings = rankings.unionByName(inside(about, asked.where("v = 0 and narrow is null")))
        hits = retrieval.look_up(retrieval.fuse(rankings, r.fused_top_k, r.rrf_k), chunks).join(q.select("query_id", "query"), "query_id")
        return retrieval.rerank(hits, self.score if r.reranker_enabled else None, top_k or r.rerank_top_k)

    def answers(self, questions: list[str] | DataFrame, filters: dict | None = None) -> DataFrame:
        """A row for each question (their query_ids differ): query_id, query, answer,
        source_ids, invalid_source_ids, citations, citation_valid, refused, reason,
        unsupported_numbers, injection and computed. One plan for any number of
        questions: sources, prompts, the generator and all checks run on executors.
        A question without sound hits and without a computed value is refused unasked;
        where the generator fails, the answer is a refusal that gives the error as reason."""
        g, r, q = self.config.guardrails, self.config.retrieval, scratch.saved(self._questions(questions).select("query_id", "query"), "questions")
        hits = scratch.saved(self.retrieve(q, filters, boost=True, plans=self.plan(q) if self.planner else None), "hits")
        gate = retrieval.confidence(q.join(hits.drop("query"), "query_id", "left"), g.min_rerank_score, g.min_rrf_score, r.reranker_enabled, g.enabled)
        blocks, most = self.store.table("blocks"), self.config.generation.max_context_chars
        found = scratch.saved(context.expand(hits, self.store.table("chunks"), self.store.table("edges"), blocks, r.neighbor_chunks, r.max_table_chars_in_context, most), "contexts")
        place = F.substring_index("source_id", "_", -1).cast("int")
        sources = found.select("query_id", place.alias("position"), "source_id", F.col("content").alias("body"), F.col("citation").alias("cite"))
        asked = q.join(gate, "query_id").withColumn("computed", F.lit(None).cast(COMPUTED))
        if self.config.generation.compute:
            tables = scratch.saved(hits.where("chunk_type in ('table', 'kpi')").select("query_id", F.explode("block_ids").alias("block_id")).distinct(), "tables")
            value = scratch.saved(compute.compute(q, blocks.join(tables, "block_id", "left_semi"), tables), "computed")
            counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
            shown = F.concat(F.upper("operation"), F.lit("("), "column", F.lit(") = "), T.format_number("value"))
            name = F.concat(F.lit("SOURCE_"), (F.coalesce("n", F.lit(0)) + 1).cast("string"))
            sources = sources.unionByName(value.join(counts, "query_id", "left").select("query_id", F.lit(0).alias("position"), name.alias("source_id"), shown.alias("body"), F.concat(F.lit("["), "block_id", F.lit("]")).alias("cite")))
            asked = q.join(gate, "query_id").join(value.select("query_id", F.struct(*[F.col(c) for c in COMPUTED_FIELDS]).cast(COMPUTED).alias("computed")), "query_id", "left")
        parts = sources.withColumn("content", F.concat(F.lit("["), "source_id", F.lit("]\ncontent:\n"), "body"))
        prompt = context.prompt_budget(parts, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "content", "source_id", "cite"))).alias("parts"))
        prompt = prompt.select("query_id", F.col("parts.content").alias("parts"), F.map_from_arrays("parts.source_id", "parts.cite").alias("known"))
        asked = asked.join(prompt, "query_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
        asked = scratch.saved(asked.withColumn("known", F.coalesce("known", F.from_json(F.lit("{}"), "map<string,string>"))), "asked")
        said = models.outputs(
            asked.where("ok or computed is not null").select("query_id", F.lit(prompts.ANSWER_SYSTEM).alias("system"), prompts.answer_column(F.col("parts"), F.col("query")).alias("user")),
            "query_id", ["system", "user"], self.generate, profile=self.profile,
        )
        fields = T.parse_json_object("output")
        text = F.when(fields.isNotNull(), F.coalesce(F.try_variant_get(fields, "$.answer", "string"), F.lit(""))).otherwise(T.strip("output"))
        ids = F.coalesce(F.transform(F.try_variant_get(fields, "$.source_ids", "array<string>"), lambda i: F.btrim(i, F.lit("[] "))), F.array().cast("array<string>"))
        out = _checked(asked.join(said, "query_id", "left"), text, ids)
        return scratch.saved(context.answer_sources(out).select(*ANSWER), "answers")

    def ask(self, questions: list[str] | DataFrame, filters: dict | None = None) -> list[dict]:
        """answers() of a bounded batch as dicts, by query_id; they are traced."""
        answers = self.answers(questions, filters)
        self._trace(answers)
        return [x.asDict(recursive=True) for x in answers.orderBy("query_id").collect()]

    def _trace(self, answers: DataFrame) -> None:
        record = F.to_json(F.struct(*answers.columns))
        masked = T.mask_pii(record) if self.config.guardrails.mask_pii else record
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        answers.select(F.expr("uuid()").alias("trace_id"), F.lit(now).alias("timestamp"), masked.alias("record")).write.mode("append").json(str(Path(self.config.work_dir).parent / "traces"))

    def evaluate(self, dataset: str, ks: tuple[int, ...] = (5, 10), answers: bool = False, report_file: str | None = None) -> dict:
        """Figures over a dataset of JSON lines, without boosts; with ``answers`` each
        question is asked as well. The report is also written as JSON."""
        items = scratch.saved(jsonl.load_dataset(self.spark, dataset).withColumn("query_id", F.monotonically_increasing_id()), "items")
        wanted = items.where(~evaluation.expects_no_answer()).drop("sheet_name")
        hits = self.retrieve(wanted.select("query_id", F.col("question").alias("query")), top_k=max(ks)).select("query_id", "rank", "block_ids", "source_file", "page_start", "page_end", "sheet_name", "cell_range", "section_path")
        results = scratch.saved(wanted.join(hits, "query_id", "left").withColumn("matched", evaluation.hit_matches()), "results")
        report = evaluation.retrieval_metrics(results, ks).first().asDict()
        report |= {"hit_rate_by_content_type": {r["content_type"]: r["hit_rate"] for r in evaluation.hit_rate_by_type(results, max(ks)).collect()}, "block_coverage": evaluation.block_coverage(results, max(ks)).first()[0]}
        report |= evaluation.operational(self.store.log("status"), self.store.stats()["chunks"]).first().asDict()
        if answers:
            report |= self._evaluate_answers(items)
        out = Path(report_file or Path(self.config.work_dir).parent / "evaluation" / "report.json")
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(json.dumps(report, ensure_ascii=False, indent=1))
        return report

    def _evaluate_answers(self, items: DataFrame) -> dict:
        given = self.answers(items.select("query_id", F.col("question").alias("query")))
        self._trace(given)
        given = given.select("query_id", "answer", "citations", "citation_valid", F.size("unsupported_numbers").alias("unsupported"), "refused")
        place = F.col("expected_location")
        judged = items.join(given, "query_id").withColumns(
            {
                "expects_no_answer": evaluation.expects_no_answer(),
                "correct": evaluation.answer_correct("answer", "expected_answer"),
                "citation_correct": evaluation.citation_correct(F.col("citations"), F.col("expected_document"), place["page"], place["sheet_name"]),
            }
        )
        judged = scratch.saved(judged.select("category", "expected_answer", "expects_no_answer", "correct", "citation_correct", "citation_valid", "unsupported", "refused"), "judged")
        return evaluation.answer_metrics(judged).first().asDict() | {"by_category": {r["category"]: [r["count"], r["correct"]] for r in evaluation.by_category(judged).collect()}}


def _within(narrow: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks that meet a question's filters (want_...):
    an equi-join on the first filter that a question has, the others checked after."""
    out, left = None, narrow
    for c in PLAN_FILTERS:
        met = left.where(F.col(f"want_{c}").isNotNull()).join(chunks.select("chunk_id", *PLAN_FILTERS), F.col(f"want_{c}") == F.col(c))
        for other in PLAN_FILTERS:
            met = met.where(F.col(f"want_{other}").isNull() | (F.col(f"want_{other}") == F.col(other)))
        met, left = met.select("query_id", "chunk_id"), left.where(F.col(f"want_{c}").isNull())
        out = met if out is None else out.unionByName(met)
    return out


def _checked(said: DataFrame, text: Column, ids: Column) -> DataFrame:
    """said (query, parts, known, reason, output, error) with answer, declared, reason,
    injection and unsupported_numbers; text and ids read the generator's output."""
    none, given = F.array().cast("array<string>"), F.col("output").isNotNull()
    d = said.withColumns({"answer": F.when(given, text).otherwise(REFUSAL), "declared": F.when(given, ids).otherwise(none)})
    return d.withColumns(
        {
            "reason": F.when(F.col("error").isNotNull(), F.concat(F.lit("generator_failed:"), "error")).otherwise(F.col("reason")),
            "injection": T.detect_injection("query"),
            "unsupported_numbers": F.when(given, T.unsupported_numbers("answer", F.array_join("parts", "\n\n"))).otherwise(none),
        }
    )
