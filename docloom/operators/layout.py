"""Page layout: text inside tables, fonts and heading levels, reading order, ranges
of a sheet, images, derived blocks, and the projection that goes into an index."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Least size of an image that counts, and hints in captions and texts.
MIN_IMAGE = (220, 120)
CHART_HINTS = ["biểu đồ", "chart", "đồ thị", "dashboard"]
FLOWCHART_HINTS = ["sơ đồ", "lưu đồ", "flowchart", "quy trình"]


def outside_tables(texts: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """texts (document_id, page, x0, y0, x1, y1) whose centre lies in no table's box
    of their page: a spatial anti-join, with document and page as its hash key."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    boxes = tables.select(F.col("document_id").alias("d"), F.col("page").alias("p"), *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = cx.between(F.col("tx0") - tolerance, F.col("tx1") + tolerance) & cy.between(F.col("ty0") - tolerance, F.col("ty1") + tolerance)
    return texts.join(boxes, (F.col("document_id") == F.col("d")) & (F.col("page") == F.col("p")) & inside, "left_anti")


def font_profile(spans: DataFrame, ratio: float = 1.15, most: int = 4) -> DataFrame:
    """(document_id, body, headings): the size with most characters, and up to four
    sizes from ratio times it on, largest first. spans: document_id, size, text."""
    sizes = spans.groupBy("document_id", F.round("size", 1).alias("size")).agg(F.sum(F.length(T.strip("text"))).alias("n"))
    body = sizes.groupBy("document_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body"))
    large = sizes.join(body, "document_id").where(F.col("size") >= F.col("body") * ratio).groupBy("document_id").agg(F.slice(F.sort_array(F.collect_set("size"), asc=False), 1, most).alias("headings"))
    return body.join(large, "document_id", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<double>")))


def heading_level(text: Column, size: Column, bold: Column, body: Column, headings: Column, max_chars: int = 160) -> Column:
    """Level of a line by its size, or by number and weight; null if it is no heading."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    none = (F.length(text) > max_chars) | (lines > 2) | text.rlike(r"[.;,]$") | text.rlike(r"^[0-9\s.,/-]+$")
    by_size = F.array_position(F.transform(headings, lambda h: size >= h - 0.05), True)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)[.)]?\s", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    by_weight = F.when(number != "", F.least(dots + 1 + F.size(headings), F.lit(6))).otherwise(F.size(headings) + 1)
    return F.when(none, None).when(by_size > 0, by_size.cast("int")).when((bold > 0.8) & (size >= body - 0.05) & (F.length(text) <= 120), by_weight)


def page_order(items: DataFrame) -> DataFrame:
    """Adds reading_order within (document_id, page): texts keep their order n; any
    other item goes before the first text that begins at its top or below. items: kind, n, y0."""
    later = Window.partitionBy("document_id", "page")
    texts = F.filter(F.collect_list(F.struct("kind", "n", "y0")).over(later), lambda t: t["kind"] == "text")
    behind = F.array_min(F.transform(F.filter(texts, lambda t: t["y0"] >= F.col("y0")), lambda t: t["n"]))
    place = F.when(F.col("kind") == "text", F.col("n")).otherwise(F.coalesce(behind, F.lit(2**31 - 1)))
    i = items.withColumn("before", place)
    w = Window.partitionBy("document_id").orderBy("page", "before", F.when(F.col("kind") == "text", 1).otherwise(0), "y0", "n")
    return i.withColumn("reading_order", F.row_number().over(w) - 1).drop("before")


def range_values(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ref, values) of A1 ranges with a sheet, row by row. cells: sheet, row, col, value; ranges: ref."""
    r = ranges.select("ref", T.parse_cell_range("ref").alias("r")).where("r is not null")
    c = r.join(cells, T.normalize_for_match("r.sheet") == T.normalize_for_match("sheet")).where("row between r.min_row and r.max_row and col between r.min_col and r.max_col")
    return c.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"]).alias("values"))


def large_images(images: DataFrame, least: tuple[int, int] = MIN_IMAGE) -> DataFrame:
    """Images (width, height) that are more than decoration."""
    return images.where((F.col("width") >= least[0]) & (F.col("height") >= least[1]))


def classify_image(caption: Column, text: Column, labels: Column) -> Column:
    """chart, flowchart or image, by caption, recognised text and layout labels."""
    caption, text = F.lower(F.coalesce(caption, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    arrows = F.size(F.regexp_extract_all(text, F.lit("→|->|=>|⟶|➔"), F.lit(0)))
    chart = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit("chart"))) | caption.rlike("|".join(CHART_HINTS))
    flow = caption.rlike("|".join(FLOWCHART_HINTS)) | (arrows >= 2) | (text.rlike("bắt đầu|kết thúc|start|end") & F.contains(text, F.lit("\n")))
    return F.when(chart, "chart").when(flow, "flowchart").otherwise("image")


#: Names that recognisers give to labels, contents and boxes.
LABEL_KEYS = ["block_label", "label", "type"]
CONTENT_KEYS = ["block_content", "content", "text", "markdown", "html"]
BOX_KEYS = ["block_bbox", "bbox", "coordinate", "box"]


def layout_blocks_py(raw: str | None) -> list[dict]:
    """Blocks (label, content, bbox, confidence) of a recogniser's JSON, at any depth, in order."""
    out: list[dict] = []
    pick = lambda node, keys, kind: next((node[k] for k in keys if isinstance(node.get(k), kind)), None)
    stack = [json.loads(raw)] if raw else []
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += reversed(node)
        elif isinstance(node, dict):
            label, content, box = pick(node, LABEL_KEYS, str), pick(node, CONTENT_KEYS, str), pick(node, BOX_KEYS, list)
            if label and content and content.strip():
                score = node.get("score", node.get("confidence"))
                sound = box and all(isinstance(v, (int, float)) for v in box)
                out.append({"label": label.lower(), "content": content.strip(), "bbox": [float(v) for v in box] if sound else None, "confidence": float(score) if isinstance(score, (int, float)) else None})
            else:
                stack += reversed(list(node.values()))
    return out


def layout_blocks(raw: Column | str) -> Column:
    @F.pandas_udf("array<struct<label:string,content:string,bbox:array<double>,confidence:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(layout_blocks_py)

    return run(raw)


def apply_model(df: DataFrame, inputs: list[str], model: Callable[..., str], out: str = "output", tries: int = 3, valid: Callable[[str], bool] = bool) -> DataFrame:
    """Adds out, struct(text, status, error, tries) of a model on the input columns:
    a failure or an invalid text is tried again; the last one is needs_review or failed, and never raises."""

    @F.pandas_udf("text string, status string, error string, tries int")
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for args in zip(*columns, strict=True):
            text, error = None, None
            for n in range(1, tries + 1):
                try:
                    text, error = model(*args), None
                    if valid(text):
                        break
                except Exception as e:  # the row keeps the reason
                    text, error = None, f"{type(e).__name__}: {e}"
            status = "failed" if error else "success" if valid(text) else "needs_review"
            rows.append((text, status, error, n))
        return pd.DataFrame(rows, columns=["text", "status", "error", "tries"])

    return df.withColumn(out, run(*inputs))


def insert_derived(blocks: DataFrame, derived: DataFrame) -> DataFrame:
    """Blocks with derived ones (derived_from) right behind their origin, renumbered."""
    at = blocks.select("document_id", F.col("block_id").alias("derived_from"), "reading_order")
    new = derived.drop("reading_order").join(at, ["document_id", "derived_from"]).withColumn("behind", F.lit(1))
    both = blocks.withColumn("behind", F.lit(0)).unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("document_id").orderBy("reading_order", "behind", "block_id")
    return both.withColumn("reading_order", F.row_number().over(w) - 1).drop("behind")


def index_payload(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What an index keeps of a chunk: content, place and filter fields, and its document's profile; no table rows."""
    own = ["chunk_id", "document_id", "ordinal", "chunk_type", "content", "source_file", "section_path", "page_start", "page_end", "sheet_name", "cell_range", "table_file", "entities", "keywords"]
    d = documents.select("document_id", F.col("title").alias("doc_title"), "doc_number", "issue_date", "signers", F.col("original_name").alias("original_file_name"), "content_hash")
    return chunks.select(*[c for c in own if c in chunks.columns]).join(d, "document_id", "left")


def span_of_pages(df: DataFrame, key: str, page: str = "page") -> DataFrame:
    return df.groupBy(key).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_sort(F.collect_set(page)).alias("pages"))


def previous_page_text(blocks: DataFrame, limit: int = 1500) -> DataFrame:
    """(document_id, page, previous): the end of the page before each page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "content"))), lambda x: x["content"]), "\n")
    pages = blocks.where("page is not null").groupBy("document_id", "page").agg(text.alias("text"))
    before = pages.select("document_id", (F.col("page") + 1).alias("page"), T.tail_context("text", limit).alias("previous"))
    return pages.select("document_id", "page").join(before, ["document_id", "page"], "left").withColumn("previous", F.coalesce("previous", F.lit("")))


def correction_stats(corrected: DataFrame) -> DataFrame:
    """Counts by document of corrected components and characters."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return corrected.groupBy("document_id").agg(F.count(F.lit(1)).alias("components"), *map(is_, ("success", "partial", "failed", "skipped")), F.sum(F.length("content_raw")).alias("chars_in"), F.sum(F.length("content")).alias("chars_out"))
