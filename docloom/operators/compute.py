"""Structured computation: a question's sum, average, maximum, minimum or count
over the best-fitting table.

Cells are rows, and all tables and questions of a batch go through the same joins:
a question meets a table only where a word of a numeric header or a value of a text
column stands in it, found by equality. Of the tables that meet no word, all fit
equally, so the first of them stands for all. Time is linear in the cells and in
these meetings; no table is one task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions import text as T

#: Words that open a row of totals.
TOTAL_ROW = r"(?iu)^(?:tổng|tổng cộng|cộng|total|grand total|sum)(?![\p{L}\p{N}_])"


def cells(blocks: DataFrame) -> DataFrame:
    """block_id, row, total (whether the row is one of totals), col, header, value
    (trimmed), norm (as matched), number of each cell of a table's body."""
    own = F.col("inherited_header").isNotNull()
    b = blocks.where(F.size("rows") > 0).select(
        "block_id", F.coalesce("numeric_repr", F.lit("")).alias("numeric_repr"), F.when(own, F.col("inherited_header")).otherwise(F.col("rows")[0]).alias("head"),
        F.when(own, F.col("rows")).otherwise(F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows") - 1))).alias("body"),
    ).where((F.size("head") > 0) & (F.size("body") > 0))
    rows = b.select("block_id", "numeric_repr", "head", F.posexplode("body").alias("row", "values"))
    total = T.strip(F.coalesce(F.get("values", F.lit(0)), F.lit(""))).rlike(TOTAL_ROW)
    c = rows.select("block_id", "numeric_repr", "row", "values", total.alias("total"), F.posexplode("head").alias("col", "header"))
    value = T.strip(F.coalesce(F.get("values", F.col("col")), F.lit("")))
    c = c.select("block_id", "numeric_repr", "row", "total", "col", "header", value.alias("value"))
    number = F.when(F.col("numeric_repr") == "python", T.parse_number(F.col("value"), True)).otherwise(T.parse_number(F.col("value")))
    return c.select("block_id", "row", "total", "col", "header", "value", T.normalize_for_match("value").alias("norm"), number.alias("number"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({T.WORD}+)"), F.lit(1)))


def word_runs(c: Column, longest: int) -> Column:
    """All substrings of 2 to ``longest`` characters that begin and end at word borders."""
    n, inside = F.length(c), lambda at: c.substr(at, F.lit(1)).rlike(T.WORD)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~inside(i - 1))
    ends = lambda i: F.filter(F.sequence(i, F.least(n, i + (longest - 1))), lambda j: (j > i) & ((j == n) | ~inside(j + 1)))
    return F.when(n >= 2, F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: c.substr(i, j - i + 1))))))


PAIR = ["query_id", "block_id"]


def compute(queries: DataFrame, blocks: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """queries: query_id, query; blocks: block_id, rows, inherited_header,
    numeric_repr. One row per query that asks for an operation some table can
    answer: operation, block_id, column, value, filters, label_of_extreme, rows_used.

    Numeric columns have numbers in at least 0.7 of their filled cells. Text
    columns filter from left to right: where some but not all of a column's values
    (among the rows still left) stand in the question, the longest counts, then the
    first in order. Of tables the best overlap of header and question wins, half a
    point for each filter; then the least block_id. ``allowed`` (query_id,
    block_id) names the tables that each question may use; by default all."""
    q = queries.withColumn("operation", T.detect_operation("query")).where("operation is not null").withColumn("said", T.normalize_for_match("query"))
    q = scratch.saved(q.select("query_id", "operation", "said", _words(F.col("said")).alias("asked")), "questions")
    c = scratch.saved(cells(blocks), "cells")
    filled = F.count(F.when(F.col("value") != "", 1))
    numeric = (filled > 0) & (F.count(F.when(F.col("value") != "", F.col("number"))) >= 0.7 * filled)
    body = lambda x: F.when(~F.col("total"), x)
    # Per column: whether it is numeric, and its figures over the rows that are no totals.
    columns = c.groupBy("block_id", "col").agg(
        F.first("header").alias("header"), numeric.alias("is_number"), F.count(body(F.lit(1))).alias("n_rows"), F.count(body(F.col("number"))).alias("n"),
        F.sum(body(F.col("number"))).alias("sum"), F.max(body(F.col("number"))).alias("max"), F.min(body(F.col("number"))).alias("min"),
    )
    columns = scratch.saved(columns.where("n_rows > 0").withColumn("names", _words(T.normalize_for_match("header"))), "columns")
    data = c.where("not total").drop("total")

    may = (lambda pairs: pairs) if allowed is None else (lambda pairs: pairs.join(allowed, PAIR, "left_semi"))
    mentions = scratch.saved(may(_mentions(q, data, columns)), "mentions")
    filters, left = _narrow(mentions, data)
    # The pairs that meet, and the first table of all that meet no word.
    of_words = columns.where("is_number").select("block_id", F.explode("names").alias("word")).join(q.select("query_id", F.explode("asked").alias("word")), "word").select(*PAIR)
    lead = columns.where("is_number").groupBy("block_id").agg(F.min_by("n", "col").alias("n")).where("n > 0").select("block_id", F.lit(False).alias("counts"))
    lead = lead.unionByName(columns.select("block_id", F.lit(True).alias("counts")).distinct())
    of_kind = q.select("query_id", (F.col("operation") == "count").alias("counts"))
    if allowed is None:
        every = of_kind.join(F.broadcast(lead.groupBy("counts").agg(F.min("block_id").alias("block_id"))), "counts").select(*PAIR)  # two rows
    else:
        every = allowed.join(of_kind, "query_id").join(lead, ["block_id", "counts"]).groupBy("query_id").agg(F.min("block_id").alias("block_id"))
    pairs = may(of_words).unionByName(mentions.select(*PAIR)).unionByName(every).where("block_id is not null").distinct()

    # The numeric column of the best overlap, or the first column for counts without one.
    overlap = F.size(F.array_intersect("names", "asked")) / F.greatest(F.lit(1), F.size("names"))
    figures = F.struct("col", "header", "n_rows", "n", "sum", "max", "min")
    best = pairs.join(q.drop("said"), "query_id").join(columns.where("is_number or col = 0"), "block_id").withColumn("less", F.when(F.col("is_number"), -overlap).otherwise(F.lit(1.0)))
    best = best.where("operation = 'count' or is_number").groupBy(*PAIR, "operation").agg(F.min(F.struct("less", "col", figures.alias("of"))).alias("best"), F.first(F.when(F.col("col") == 0, F.col("header")), True).alias("header0"))
    best = best.select(*PAIR, "operation", "best.less", "best.col", "best.of", "header0")

    # Filtered pairs have figures of their own, over the rows that are left.
    own = left.join(best.select(*PAIR, "col"), PAIR).join(data.select("block_id", "row", "col", "number"), ["block_id", "row", "col"])
    own = own.groupBy(*PAIR).agg(F.struct(F.count(F.lit(1)).alias("n_rows"), F.count("number").alias("n"), F.sum("number").alias("sum"), F.max("number").alias("max"), F.min("number").alias("min")).alias("own"))
    done = best.join(filters, PAIR, "left").join(own, PAIR, "left")
    of = lambda name: F.when(F.col("filters").isNotNull(), F.col(f"own.{name}")).otherwise(F.col(f"of.{name}"))
    op, extra = F.col("operation"), F.coalesce(F.size("filters"), F.lit(0))
    done = done.withColumn("rows_used", F.when(op == "count", of("n_rows")).otherwise(of("n"))).where("rows_used > 0")
    n = F.col("rows_used").cast("double")
    value = F.when(op == "count", n).when(op == "sum", of("sum")).when(op == "avg", of("sum") / n).when(op == "max", of("max")).otherwise(of("min"))
    column = F.when(op == "count", F.coalesce(F.nullif(F.col("header0"), F.lit("")), F.lit("dòng"))).otherwise(F.col("of.header"))
    score = F.when(op == "count", 1.0 + extra).otherwise(-F.col("less") + 0.5 * extra)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "block_id")
    done = done.withColumns({"value": value, "column": column, "score": score}).withColumn("at", F.row_number().over(w)).where("at = 1")
    done = scratch.saved(done.select(*PAIR, "operation", "col", "column", "value", "filters", "rows_used"), "answers")
    none = F.array().cast("array<struct<name:string,value:string>>")
    done = done.join(_labels(done, data, left), "query_id", "left").withColumn("filters", F.coalesce("filters", none))
    return done.select("query_id", "operation", "block_id", "column", "value", "filters", "label_of_extreme", "rows_used")


def _mentions(q: DataFrame, data: DataFrame, columns: DataFrame) -> DataFrame:
    """query_id, block_id, col, norm, k: values of text columns that stand in a
    question as whole words; k numbers a pair's columns from the left."""
    values = data.where(F.length("norm") >= 2).join(columns.where("not is_number").select("block_id", "col"), ["block_id", "col"]).select("block_id", "col", "norm").distinct()
    longest = values.agg(F.max(F.length("norm"))).first()[0] or 2
    runs = q.select("query_id", F.explode(word_runs(F.col("said"), longest)).alias("norm"))
    w = Window.partitionBy(*PAIR).orderBy("col")
    return values.join(runs, "norm").select(*PAIR, "col", "norm").withColumn("k", F.dense_rank().over(w))


def _narrow(mentions: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, block_id, filters) of the pairs that filter at all, and (query_id,
    block_id, row) of the rows they leave. One round for each column that a question
    names in one table, however many tables and rows there are."""
    left = mentions.select(*PAIR).distinct().join(data.select("block_id", "row").distinct(), "block_id").select(*PAIR, "row")
    found = mentions.select(*PAIR, "k", "col", F.col("norm").alias("target"), F.lit(None).cast("string").alias("header")).limit(0)
    for k in range(1, (mentions.agg(F.max("k")).first()[0] or 0) + 1):
        named = mentions.where(F.col("k") == k).select(*PAIR, "col", "norm")
        here = left.join(named.select(*PAIR, "col").distinct(), PAIR).join(data.select("block_id", "row", "col", "header", "norm"), ["block_id", "row", "col"])
        here = scratch.saved(here, "column")
        values = here.where("norm <> ''").groupBy(*PAIR, "col", "norm").agg(F.first("header").alias("header")).join(named.withColumn("named", F.lit(True)), [*PAIR, "col", "norm"], "left")
        longest = F.min(F.when(F.col("named"), F.struct((-F.length("norm")).alias("less"), F.col("norm").alias("target"))))
        use = values.groupBy(*PAIR, "col").agg(F.count("named").alias("some"), F.count(F.lit(1)).alias("all"), longest.alias("by"), F.first("header").alias("header")).where("some > 0 and some < all")
        use = scratch.saved(use.select(*PAIR, F.lit(k).alias("k"), "col", "by.target", "header"), "filter")
        gone = here.join(use.select(*PAIR, "target"), PAIR).where("norm <> target").select(*PAIR, "row")
        left = scratch.saved(left.join(gone, [*PAIR, "row"], "left_anti"), "left")
        found = found.unionByName(use)
    label = F.when(F.col("header") == "", F.concat(F.lit("cột "), (F.col("col") + 1).cast("string"))).otherwise(F.col("header"))
    each = F.struct("k", label.alias("name"), F.col("target").alias("value"))
    filters = found.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias("filters"))
    return filters, left


def _labels(done: DataFrame, data: DataFrame, left: DataFrame) -> DataFrame:
    """query_id, label_of_extreme: the first row that holds the maximum or minimum, its cells joined."""
    wanted = done.where("operation in ('max', 'min')")
    hits = wanted.join(data.select("block_id", "col", "row", "number"), ["block_id", "col"]).where("number = value").select("query_id", "block_id", "row", F.col("filters").isNotNull().alias("filtered"))
    kept = hits.where("filtered").join(left, [*PAIR, "row"], "left_semi").unionByName(hits.where("not filtered"))
    first = kept.groupBy(*PAIR).agg(F.min("row").alias("row"))
    row = first.join(data.select("block_id", "row", "col", "value"), ["block_id", "row"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return row.select("query_id", F.array_join(F.transform("cells", lambda x: x["value"]), " | ").alias("label_of_extreme"))


def formula(operation: Column, value: Column, rows_used: Column) -> Column:
    return F.concat(F.upper(operation), F.lit("("), rows_used.cast("string"), F.lit(") = "), T.format_number(value))
