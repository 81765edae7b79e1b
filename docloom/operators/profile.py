"""Document profiles: names and their spellings, keywords, title, number, date,
issuer, signers; and what chunks and queries mention of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.names import name_candidates

#: Fixed values.
TEXTUAL_TYPES = ["text", "ocr_page", "caption", "heading", "image", "kpi", "chart", "flowchart"]
SIGNER_ROLES = [
    "chủ tịch", "phó chủ tịch", "giám đốc", "phó giám đốc", "tổng giám đốc", "trưởng phòng",
    "thủ trưởng", "người ký", "ký tên", "bộ trưởng", "thứ trưởng", "cục trưởng", "hiệu trưởng",
]
SIGN_MARKERS = ["tm.", "kt.", "tl.", "q.", "nơi nhận"]
ISSUER_HINTS = ["ủy ban", "uỷ ban", "ubnd", "hđnd", "bộ ", "sở ", "công ty", "ngân hàng", "tổng cục", "cục ", "trường ", "ban "]
STOPWORDS = (
    "và của các những một là có cho được trong với này đó khi để đã sẽ theo từ tại về như không "
    "hoặc nếu thì mà bị ra vào lên đến trên dưới sau trước cũng rất nhiều người ngày tháng năm"
).split()
DOC_NUMBER = r"(?iu)(?<![\p{L}\p{N}_])S[ốo]\s*[:.]?\s*([0-9]+(?:[/\-][0-9A-Za-zĐđ]+(?:[-/][0-9A-Za-zĐđ.]+)*)+)"
DATE_TEXT = r"(?iu)ng[àa]y\s+([0-9]{1,2})\s+th[áa]ng\s+([0-9]{1,2})\s+n[ăa]m\s+([0-9]{4})"
DATE_NUMERIC = r"(?<![\p{L}\p{N}_])([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?![\p{L}\p{N}_])"
LOCATION = r"(?iu)(?<![\p{L}\p{N}_])((?:x[ãa]|ph[ưu][ờo]ng|qu[ậa]n|huy[ệe]n|t[ỉi]nh|th[àa]nh ph[ốo]|th[ịi] x[ãa]|th[ịi] tr[ấa]n)\s+(?:\p{L}[\p{L}\p{N}_]*\s?){1,4})"
PERSON_PREFIX = r"(?iu)(?<![\p{L}\p{N}_])(?:ông|bà|đồng chí|anh|chị)\s+((?:\p{L}[\p{L}\p{N}_]*\s?){2,5})"


# ---------------------------------------------------------------------- names


def spellings(texts: DataFrame) -> DataFrame:
    """(document_id, key, variant, n, first): spellings of names with their counts.
    texts: document_id, content, and reading_order if order matters."""
    order = F.col("reading_order") if "reading_order" in texts.columns else F.lit(0)
    names = texts.select("document_id", order.alias("at"), F.posexplode(name_candidates("content")).alias("pos", "variant"))
    return names.groupBy("document_id", F.lower(T.strip_diacritics("variant")).alias("key"), "variant").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "pos")).alias("first"))


def ledger(texts: DataFrame) -> DataFrame:
    """(document_id, key, canonical, aliases, count): of a name's spellings the most
    frequent is canonical, then the one with most marked letters, then the first."""
    s = spellings(texts).withColumn("marked", F.length("variant") - F.length(F.regexp_replace("variant", r"[^\x00-\x7f]", "")))
    w = Window.partitionBy("document_id", "key").orderBy(F.desc("n"), F.desc("marked"), "first")
    s = s.withColumn("canonical", F.first("variant").over(w))
    return s.groupBy("document_id", "key", "canonical").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when(F.col("variant") != F.col("canonical"), F.col("variant")))).alias("aliases"))


def terms(entries: DataFrame, min_count: int = 2, limit: int = 20, max_chars: int = 400) -> DataFrame:
    """(document_id, rank, canonical): names seen often enough, most frequent first,
    up to the first that breaks the limit of terms or characters."""
    w = Window.partitionBy("document_id").orderBy(F.desc("count"), "key")
    t = entries.where(F.col("count") >= min_count).withColumns({"rank": F.row_number().over(w), "used": F.sum(F.length("canonical") + 2).over(w)})
    return t.where((F.col("rank") <= limit) & (F.col("used") <= max_chars)).select("document_id", "rank", "canonical", "count")


def conflicts(entries: DataFrame) -> DataFrame:
    """Names with several spellings."""
    return entries.where(F.size("aliases") > 0).select("document_id", "canonical", "aliases")


def bigrams(blocks: DataFrame, limit: int = 12, least: int = 3) -> DataFrame:
    """(document_id, rank, term, n): most frequent pairs of neighbouring words of a
    block, stop-words and single letters aside; ties by first appearance in order of the term.
    Blocks are dealt by document before they are cut, so texts are shuffled, not their pairs."""
    parts = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.select("document_id", "content").repartition(parts, "document_id")
    words = F.transform(F.regexp_extract_all("content", F.lit(r"(\p{L}+)"), F.lit(1)), F.lower)
    b = blocks.select("document_id", words.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    b = b.select("document_id", F.inline(pairs)).where(~F.col("x").isin(STOPWORDS) & ~F.col("y").isin(STOPWORDS) & (F.length("x") > 1) & (F.length("y") > 1))
    counted = b.groupBy("document_id", F.concat_ws(" ", "x", "y").alias("term")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# -------------------------------------------------------------------- profile


def issue_date(head: Column) -> Column:
    """The first date of a text as YYYY-MM-DD, in words before digits; ranges are checked, calendars are not."""
    def read(pattern: str) -> Column:
        d, m, y = (F.regexp_extract(head, pattern, i).try_cast("int") for i in (1, 2, 3))
        ok = d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100)
        return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))

    return F.when(head.rlike(DATE_TEXT), read(DATE_TEXT)).otherwise(read(DATE_NUMERIC))


def issuer(head: Column) -> Column:
    """The first of the first twelve lines that is mostly upper case and names an office."""
    lines = F.transform(F.slice(F.split(head, "\n"), 1, 12), T.strip)
    letters = lambda x: F.length(F.regexp_replace(x, r"\P{L}", ""))
    upper = lambda x: F.length(F.regexp_replace(x, r"\P{Lu}", ""))
    hint = lambda x: F.lower(x).rlike("|".join(ISSUER_HINTS))
    return F.substring(F.get(F.filter(lines, lambda x: (F.length(x) >= 4) & (letters(x) >= 4) & (upper(x) > 0.8 * letters(x)) & hint(x)), F.lit(0)), 1, 160)


def signers(blocks: DataFrame, limit: int = 5) -> DataFrame:
    """(document_id, signers): names on the lines of a signing role, or up to three
    lines on, in the last ten text blocks."""
    back = Window.partitionBy("document_id").orderBy(F.desc("reading_order"))
    tail = blocks.where(F.col("block_type").isin("text", "ocr_page")).withColumn("back", F.row_number().over(back)).where("back <= 10")
    lines = tail.select("document_id", "reading_order", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line", T.strip("line")).where("line <> ''")
    order = Window.partitionBy("document_id").orderBy("reading_order", "at")
    lines = lines.withColumn("n", F.row_number().over(order)).withColumn("role", F.lower("line").rlike("|".join([*SIGNER_ROLES, *[m.replace(".", r"\.") for m in SIGN_MARKERS]])))
    lines = lines.withColumn("by", F.min(F.when(F.col("role"), F.col("n"))).over(order.rowsBetween(-3, 0))).where("by is not null")
    is_upper = (F.col("line") == F.upper("line")) & (F.col("line") != F.lower("line"))
    names = lines.select("document_id", "by", "n", F.posexplode(name_candidates(F.when(is_upper, F.initcap(F.lower("line"))).otherwise(F.col("line")))).alias("pos", "name"))
    names = names.where(F.size(F.split("name", " ")).between(2, 5)).groupBy("document_id", "name").agg(F.min(F.struct("by", "n", "pos")).alias("first"))
    return names.groupBy("document_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), 1, limit).alias("signers"))


def heads(blocks: DataFrame, limit: int = 3000) -> DataFrame:
    """(document_id, head): text of the first page, or of blocks without one."""
    b = blocks.where(F.col("block_type").isin(TEXTUAL_TYPES)).withColumn("first", F.min("page").over(Window.partitionBy("document_id"))).where("page is null or first is null or page = first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "content"))), lambda x: x["content"]), "\n")
    return b.groupBy("document_id").agg(F.substring(text, 1, limit).alias("head"))


def titles(blocks: DataFrame) -> DataFrame:
    """(document_id, title): the first heading, else the first opening line of eight characters or more, else the file."""
    text = T.strip("content")
    b = blocks.where(F.col("block_type").isin(TEXTUAL_TYPES))
    heading = F.when((F.col("block_type") == "heading") & (text != ""), F.struct("reading_order", F.substring(F.regexp_replace(text, r"^#+\s*", ""), 1, 200).alias("t")))
    line = F.when(F.length(F.substring_index(text, "\n", 1)) >= 8, F.struct("reading_order", F.substring(F.substring_index(text, "\n", 1), 1, 200).alias("t")))
    return b.groupBy("document_id").agg(F.min(heading).alias("h"), F.min(line).alias("l"), F.min("source_file").alias("f")).select("document_id", F.coalesce("h.t", "l.t", "f").alias("title"))


def classify(entries: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Adds kind (person, location or other) by signers, by names after a personal
    title or a kind of place. Both sides meet within a document only."""
    said = texts.select("document_id", "content")
    persons = said.select("document_id", F.explode(F.regexp_extract_all("content", F.lit(PERSON_PREFIX), F.lit(1))).alias("p")).select("document_id", T.normalize_key("p").alias("p"))
    places = said.select("document_id", F.explode(F.regexp_extract_all("content", F.lit(LOCATION), F.lit(1))).alias("p")).select("document_id", T.normalize_key("p").alias("p"))
    gather = lambda df, name: df.groupBy("document_id").agg(F.collect_set("p").alias(name))
    e = entries.join(gather(persons, "persons"), "document_id", "left").join(gather(places, "places"), "document_id", "left").join(signed, "document_id", "left")
    key = T.normalize_key("canonical")
    any_of = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    person = any_of("signers", lambda s: T.normalize_key(s) == key) | any_of("persons", lambda p: F.endswith(key, p))
    kind = F.when(person, "person").when(any_of("places", lambda p: F.contains(p, key)), "location").otherwise("other")
    return e.select("document_id", key.alias("key"), "canonical", "aliases", "count", kind.alias("kind"))


def build(blocks: DataFrame, max_entities: int = 150) -> tuple[DataFrame, DataFrame]:
    """(profiles, entities): one row per document with title, doc_number,
    issue_date, issuer, signers and keywords; and its names, those seen once and of
    no kind left out."""
    texts = blocks.where(F.col("block_type").isin(TEXTUAL_TYPES)).select("document_id", "reading_order", "content")
    signed = signers(blocks)
    entries = ledger(texts)
    kinds = classify(entries, texts, signed)
    w = Window.partitionBy("document_id").orderBy(F.desc("count"), "canonical")
    entities = kinds.where("count >= 2 or kind <> 'other'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_entities)
    collect = lambda df, of, name: df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", of))), lambda x: x[of]).alias(name))
    heading = F.regexp_replace(T.strip("content"), r"^#+\s*", "")
    headings = blocks.where("block_type = 'heading'").select("document_id", F.col("reading_order").alias("rank"), heading.alias("heading")).where(F.length("heading").between(3, 80))
    words = bigrams(blocks.where(F.col("block_type").isin("text", "ocr_page", "caption")))
    head = heads(blocks)
    profiles = (
        titles(blocks)
        .join(head, "document_id", "left")
        .join(signed, "document_id", "left")
        .join(collect(headings, "heading", "k1"), "document_id", "left")
        .join(collect(words, "term", "k2"), "document_id", "left")
        .join(collect(terms(entries, 1, 12), "canonical", "k3"), "document_id", "left")
    )
    none = F.array().cast("array<string>")
    keywords = F.slice(F.array_distinct(F.concat(*[F.coalesce(k, none) for k in ("k1", "k2", "k3")])), 1, 24)
    number = F.regexp_extract("head", DOC_NUMBER, 1)
    return profiles.select(
        "document_id", "title", F.nullif(number, F.lit("")).alias("doc_number"), issue_date(F.col("head")).alias("issue_date"), issuer(F.col("head")).alias("issuer"),
        F.coalesce("signers", none).alias("signers"), keywords.alias("keywords"),
    ), entities


def attach(chunks: DataFrame, profiles: DataFrame, entities: DataFrame, most: int = 12) -> DataFrame:
    """chunks with keywords, and the names that each mentions by key, then those by
    an alias. Names meet the chunks of their own document only."""
    hay = chunks.select("document_id", "chunk_id", F.concat(F.lit(" "), T.normalize_key("content"), F.lit(" ")).alias("hay"))
    named = lambda key: F.contains("hay", F.concat(F.lit(" "), key, F.lit(" ")))
    near = hay.join(entities.select("document_id", "key", "canonical", "aliases", "rank"), "document_id")
    how = F.when(named(F.col("key")), 1).when(F.exists("aliases", lambda a: named(T.normalize_key(a))), 2)
    found = near.withColumn("how", how).where("how is not null").groupBy("chunk_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("how", "rank", "canonical"))), lambda x: x["canonical"]), 1, most).alias("entities"))
    out = chunks.join(found, "chunk_id", "left").join(profiles.select("document_id", "keywords"), "document_id", "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
