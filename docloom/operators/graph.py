"""The relationship graph of a document's blocks.

Relations are windows over the blocks, partitioned by document, so that documents
spread over the cluster and are dealt out once. Only the greedy one-to-one choice of captions is sequential; it runs on the array of a
document's blocks, in Arrow batches of documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.schema import VISUAL_TYPES

#: Words of captions and mentions; the first two name tables, the others figures.
CAPTION_WORDS = ["bảng", "table", "hình", "biểu đồ", "sơ đồ", "lưu đồ", "đồ thị", "figure", r"fig\.", "chart"]
_KIND = "(" + "|".join(CAPTION_WORDS) + ")"
_NUMBER = r"([0-9]+(?:[.\-][0-9]+)*)"
CAPTION = rf"(?iu)^{_KIND}\s*{_NUMBER}"
MENTION = rf"(?iu)(?<!{T.WORD}){_KIND}\s*{_NUMBER}"


def _edges(df: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    return df.where(F.col(source) != F.col(target)).select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(relation).alias("relation_type"), "document_id").distinct()


def _in_order(*keys: str) -> Window:
    return Window.partitionBy("document_id", *keys).orderBy("reading_order", "block_id")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Each block to the next one of its document."""
    b = blocks.select("document_id", "block_id", "reading_order").withColumn("next", F.lead("block_id").over(_in_order()))
    return _edges(b.where("next is not null"), "block_id", "next", "next_in_reading_order")


def _is_heading() -> Column:
    return (F.col("block_type") == "heading") & (F.size("section_path") > 0)


def _heading() -> Column:
    """Of blocks that are no heading, the latest earlier heading with the same section path (an as-of join by window)."""
    before = _in_order("section_path").rowsBetween(Window.unboundedPreceding, -1)
    return F.when(~_is_heading(), F.last(F.when(_is_heading(), F.col("block_id")), ignorenulls=True).over(before))


def sections(blocks: DataFrame) -> DataFrame:
    """Each block to its heading."""
    b = blocks.select("document_id", "block_id", "block_type", "section_path", "reading_order").withColumn("heading", _heading())
    return _edges(b.where("heading is not null"), "block_id", "heading", "belongs_to_section")


def caption_kind(word: Column) -> Column:
    return F.when(F.lower(word).isin("bảng", "table"), "table").otherwise("figure")


def captioned(blocks: DataFrame) -> DataFrame:
    """Adds caption_id, caption and label to each visual or table block, attached_to to
    its caption: blocks in order take the nearest fitting caption that is still free,
    looking one back, one on, two back, two on. label is like "table 2", or null.

    Choices are one array of distances for each document, read by place, so blocks that
    are dealt by document are not dealt again; texts come from the rows beside."""
    word, number = F.regexp_extract("content", CAPTION, 1), F.regexp_extract("content", CAPTION, 2)
    is_caption, w = F.col("block_type") == "caption", _in_order()
    target = F.when(~is_caption, 0).when(word == "", 1).otherwise(F.when(caption_kind(word) == "table", 2).otherwise(3))
    wants = F.when(F.col("block_type").isin([*VISUAL_TYPES, "table"]) & (F.coalesce("derived_from", F.lit("")) == ""), F.when(F.col("block_type") == "table", 4).otherwise(5)).otherwise(0)
    where = F.struct("page", "sheet_name")
    beside = [F.when(F.lag(where, k).over(w).eqNullSafe(where), 8 * k).otherwise(0) for k in (1, 2)]
    placed = blocks.withColumns({"place": F.row_number().over(w), "code": F.when(target > 0, target).otherwise(wants) + beside[0] + beside[1]})
    # A document without captions is not looked at.
    codes = placed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("items")).select("document_id", F.transform("items", lambda x: x["code"]).alias("codes"))
    choices = codes.where(F.exists("codes", lambda c: (c % 8).between(1, 3))).select("document_id", _choose_captions("codes").alias("choices"))
    chosen = placed.join(choices, "document_id", "left").withColumn("to", F.get("choices", F.col("place") - 1)).drop("choices", "place", "code")
    other = F.struct("block_id", F.when(is_caption, F.col("content")).alias("caption"), F.when(is_caption & (word != ""), F.concat_ws(" ", caption_kind(word), number)).alias("label"))
    at = F.coalesce(*[F.when(F.col("to") == k, F.lead(other, k).over(w)) for k in (-1, 1, -2, 2)])
    takes = F.coalesce(F.col("block_type").isin([*VISUAL_TYPES, "table"]), F.lit(False))
    found = chosen.withColumn("other", at)
    pick = lambda c: F.when(takes, F.col(f"other.{c}"))
    return found.select(*blocks.columns, pick("block_id").alias("caption_id"), pick("caption").alias("caption"), pick("label").alias("label"), F.when(~takes, F.col("other.block_id")).alias("attached_to"))


def captions(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, caption_id, caption, label) of the blocks that take a caption."""
    return captioned(blocks).where("caption_id is not null").select("document_id", "block_id", "caption_id", "caption", "label")


def _choose_captions(codes: str) -> Column:
    """Distances between a block and its caption, both ways, or 0. A code, modulo 8: 1 to 3
    for a caption of anything, a table, a figure; 4 and 5 for a table and a figure; plus
    8 or 16 where the page and sheet are those of the first or second block before."""

    def one(codes) -> list[int]:
        codes = [int(c) for c in codes]
        kinds, out = [c % 8 for c in codes], [0] * len(codes)
        for i, kind in enumerate(kinds):
            if kind < 4:
                continue
            for d in (-1, 1, -2, 2):
                j = i + d
                if 0 <= j < len(codes) and kinds[j] in (1, kind - 2) and not out[j] and codes[max(i, j)] & 8 * abs(d):
                    out[i], out[j] = d, -d
                    break
        return out

    @F.pandas_udf("array<int>")
    def choose(documents: pd.Series) -> pd.Series:
        return documents.map(one)

    return choose(codes)


def _mentioned(rows: DataFrame) -> DataFrame:
    """The rows of captioned(), with mention, at and sentence null, own true, and one more
    for each figure or table that a text block names; label: of the block, or named."""
    found = F.regexp_extract_all("content", F.lit(MENTION.replace("(?iu)", "(?iu)(", 1) + ")"), F.lit(1))
    placed = F.expr(
        """aggregate(found, named_struct('p', 1, 'out', cast(array() as array<struct<mention:string,at:int>>)),
             (a, m) -> named_struct('p', locate(m, content, a.p) + length(m), 'out', array_append(a.out, named_struct('mention', m, 'at', locate(m, content, a.p) - 1))), a -> a.out)"""
    )
    block = F.array(F.struct(F.lit(None).cast("string").alias("mention"), F.lit(None).cast("int").alias("at")))
    seen = rows.withColumn("found", F.when(F.col("block_type").isin("text", "ocr_page"), found)).select(*rows.columns, F.inline(F.when(F.size("found") > 0, F.concat(block, placed)).otherwise(block)))
    named = F.concat_ws(" ", caption_kind(F.regexp_extract("mention", CAPTION, 1)), F.regexp_extract("mention", CAPTION, 2))
    own = F.col("mention").isNull()
    return seen.withColumns({"own": own, "label": F.when(own, F.col("label")).otherwise(named), "sentence": F.when(~own, T.sentence_around(F.col("content"), F.col("at")))})


def referenced(rows: DataFrame) -> DataFrame:
    """_mentioned(), with the block that a mention names as named (of captions with one
    label the last counts). Windows over a document's rows, which are not dealt again."""
    last = F.max(F.when(F.col("own") & F.col("label").isNotNull(), F.struct("reading_order", "block_id"))).over(Window.partitionBy("document_id", "label"))
    return _mentioned(rows).withColumn("named", F.when(~F.col("own"), last["block_id"])).where("own or named is not null")


def with_sentences(rows: DataFrame) -> DataFrame:
    """captioned() with references: the first three different sentences that name a block."""
    keep = [c for c in rows.columns if c not in ("document_id", "block_id", "label")]
    found = referenced(rows).withColumn("of", F.when(F.col("own"), F.col("block_id")).otherwise(F.col("named")))
    found = found.select("document_id", "of", "own", "sentence", "at", F.col("reading_order").alias("seen"), "label", *[F.when(F.col("own"), F.col(c)).alias(c) for c in keep])
    again = F.row_number().over(Window.partitionBy("document_id", "of", "sentence").orderBy("seen", "at")) > 1
    found = found.withColumn("again", again).where("own or not again")
    w = Window.partitionBy("document_id", "of").orderBy("own", "seen", "at")
    found = found.withColumn("few", F.when(F.row_number().over(w) <= 3, F.col("sentence"))).withColumn("references", F.collect_list("few").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("own").select(*[F.col("of").alias(c) if c == "block_id" else F.col(c) for c in rows.columns], F.when(F.size("references") > 0, F.col("references")).alias("references"))


def chart_sources(blocks: DataFrame) -> DataFrame:
    """Charts to the tables whose cell ranges their source ranges overlap, on the same sheet."""
    charts = blocks.where("block_type = 'chart'").select("document_id", F.col("block_id").alias("chart_id"), F.col("sheet_name").alias("own"), F.explode("source_ranges").alias("ref")).withColumn("r", T.parse_cell_range("ref"))
    charts = charts.where("r is not null").withColumn("sheet", T.normalize_for_match(F.coalesce("r.sheet", "own", F.lit(""))))
    tables = blocks.where("block_type in ('table', 'kpi') and sheet_name <> '' and cell_range <> ''")
    tables = tables.select("document_id", "block_id", T.normalize_for_match("sheet_name").alias("sheet"), T.parse_cell_range("cell_range").alias("t")).where("t is not null")
    return _edges(charts.join(tables, ["document_id", "sheet"]).where(T.ranges_overlap(F.col("r"), F.col("t"))), "chart_id", "block_id", "visualizes")


def continued(blocks: DataFrame, chained_header: bool = False) -> DataFrame:
    """Adds previous_id, repeated_header and inherited_header to tables that go on from
    the page before: neighbours with nothing but short texts between, equally many
    columns. The header comes from the table before; with ``chained_header`` from the
    first of the chain."""
    on_page = Window.partitionBy("document_id", "page").orderBy("reading_order", "block_id")
    n = F.length("content")
    loud_after = F.coalesce(F.max(F.when(F.col("block_type").isin("caption", "text") & (n < 40), 0).otherwise(1)).over(on_page.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    loud_before = F.coalesce(F.max(F.when(F.col("block_type").isin("caption", "text", "heading") & (n < 80), 0).otherwise(1)).over(on_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    is_table = (F.col("block_type") == "table") & F.col("page").isNotNull()
    b = blocks.withColumns({"after": loud_after, "before": loud_before}).withColumn("head", F.when(is_table, F.col("rows")[0]))
    b = b.withColumn("p", F.last(F.when(is_table, F.struct("block_id", "page", "after", "head")), ignorenulls=True).over(before))
    fits = is_table & (F.col("page") == F.col("p.page") + 1) & (F.col("p.after") == 0) & (F.col("before") == 0) & (F.size("head") == F.size("p.head")) & (F.size("head") >= 0)
    b = b.withColumn("goes_on", F.coalesce(fits, F.lit(False)))
    same = F.transform("head", T.normalize_for_match) == F.transform("p.head", T.normalize_for_match)
    header = F.col("p.head")
    if chained_header:
        header = F.last(F.when(is_table & ~F.col("goes_on"), F.col("head")), ignorenulls=True).over(before)
    on = lambda c: F.when(F.col("goes_on"), c)
    return b.withColumn("header", header).select(*blocks.columns, on(F.col("p.block_id")).alias("previous_id"), on(same).alias("repeated_header"), on(F.when(~same, F.col("header"))).alias("inherited_header"))


def table_continuations(blocks: DataFrame, chained_header: bool = False) -> DataFrame:
    """(document_id, block_id, previous_id, repeated_header, inherited_header) of continued() tables."""
    return continued(blocks, chained_header).where("previous_id is not null").select("document_id", "block_id", "previous_id", "repeated_header", "inherited_header")


def derived(blocks: DataFrame) -> DataFrame:
    """Blocks to the block of their document that they were made from. A block stands
    beside those made from it, by a window, so that blocks dealt by document stay where they are."""
    made = F.struct(F.col("derived_from").alias("origin"), F.col("block_id").alias("block_id"))
    own = F.struct(F.col("block_id").alias("origin"), F.lit(None).cast("string").alias("block_id"))
    both = blocks.where("document_id is not null").select("document_id", F.inline(F.when(F.col("derived_from").isNotNull(), F.array(own, made)).otherwise(F.array(own))))
    known = F.max(F.col("block_id").isNull()).over(Window.partitionBy("document_id", "origin"))
    return _edges(both.withColumn("known", known).where("known and block_id is not null"), "block_id", "origin", "derived_from")


def build(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, blocks with caption, attached_to, references, inherited_header and
    continues_from). All but charts is windows, aggregates and one join by document, so blocks
    that are dealt by document_id already are not dealt again."""
    rows = captioned(continued(blocks).withColumnRenamed("previous_id", "continues_from").drop("repeated_header"))
    heading, n = _heading(), "next_in_reading_order"
    linked = referenced(rows.withColumns({"next": F.lead("block_id").over(_in_order()), "heading": heading}))
    one = lambda source, target, relation: F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(relation).alias("relation_type"))
    own = F.array(one("block_id", "next", n), one("block_id", "heading", "belongs_to_section"), one("block_id", "caption_id", "captioned_by"), one("block_id", "continues_from", "continues"))
    each = F.filter(F.when(F.col("own"), own).otherwise(F.array(one("named", "block_id", "referenced_by"))), lambda e: e["source_id"] != e["target_id"])
    edges = linked.select("document_id", F.inline(each)).select("source_id", "target_id", "relation_type", "document_id").distinct()
    edges = edges.unionByName(chart_sources(blocks)).unionByName(derived(blocks))
    full = with_sentences(rows).select(*blocks.columns, "caption", "attached_to", "references", "inherited_header", "continues_from")
    return edges, full


def related(edges: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    """Edges of these types with either end in ids.block_id. Two semi-joins, since
    an OR of both would make every pair meet in a nested loop."""
    e, i = edges.where(F.col("relation_type").isin(types)), ids.select(F.col("block_id").alias("of")).distinct()
    at_source, at_target = e.join(i, e["source_id"] == i["of"], "left_semi"), e.join(i, e["target_id"] == i["of"], "left_semi")
    return at_source.unionByName(at_target).dropDuplicates(["source_id", "target_id", "relation_type"])


def neighbours(chunks: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """(hit_id, chunk_id) of text chunks within ``window`` ordinals of a hit in its
    document and section. An equi-join on the exact ordinals instead of a range join."""
    keyed = chunks.withColumn("section_key", F.concat_ws(" > ", "section_path"))
    near = hits.select("chunk_id").join(keyed.select("chunk_id", "document_id", "section_key", "ordinal"), "chunk_id")
    near = near.select(F.col("chunk_id").alias("hit_id"), "document_id", "section_key", F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal"))
    return near.join(keyed.where("chunk_type = 'text'").select("chunk_id", "document_id", "section_key", "ordinal"), ["document_id", "section_key", "ordinal"]).where("chunk_id <> hit_id").select("hit_id", "chunk_id", "ordinal")
