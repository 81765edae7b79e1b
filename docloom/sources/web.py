"""Web pages: links, visible text, and tables of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T


def links(html: Column | str) -> Column:
    """All href values in double quotes, in order."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('<a [^>]*?href="([^"]*)"'), F.lit(1))


def visible_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags, in single spaces. Tags of
    regular HTML only; entities stay."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


class _Events(HTMLParser):
    """The stream of (kind, tag or text, attributes) of a document."""

    def __init__(self, html: str):
        super().__init__()
        self.seen: list[tuple[str, str, dict]] = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag, {}))

    def handle_data(self, data):
        self.seen.append(("text", data, {}))


def _one_line_each(text: str) -> str:
    return "\n".join(filter(None, (" ".join(x.split()) for x in text.split("\n"))))


def table_rows_py(html: str | None) -> list[list[str]]:
    """Rows between <tr> and </tr>; cells between <td> or <th> and its end, repeated by colspan."""
    out: list[list[str]] = []
    cells: list[str] | None = None  # of the open row
    start: int | None = None  # where the open cell begins
    seen = _Events(html or "").seen
    for at, (kind, name, _) in enumerate(seen):
        if (kind, name) == ("open", "tr"):
            cells = []
        elif (kind, name) == ("close", "tr"):
            out += [cells] if cells and any(cells) else []
            cells = None
        elif kind != "text" and name in ("td", "th") and cells is not None:
            if kind == "open":
                start = at
            elif start is not None:
                span = seen[start][2].get("colspan") or "1"
                text = _one_line_each("".join(x for k, x, _ in seen[start:at] if k == "text"))
                cells += [text] * (max(1, int(span)) if span.isdigit() else 1)
                start = None
    return out


def table_rows(html: Column | str) -> Column:
    """The rows of all tables; a colspan repeats its text, empty rows are left out."""

    @F.pandas_udf("array<array<string>>")
    def run(html: pd.Series) -> pd.Series:
        return html.map(table_rows_py)

    return run(F.col(html) if isinstance(html, str) else html)


def blocks(pages, id_col: str = "page_id"):
    """Headings, paragraphs and list items of regular HTML as blocks in order."""
    parts = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)(<(h[1-6]|p|li)\b[^>]*>.*?</\2>)"), F.lit(1))
    p = pages.select(F.col(id_col).cast("string").alias("document_id"), F.col("url").alias("source_file"), F.posexplode(parts).alias("reading_order", "part"))
    tag = F.lower(F.regexp_extract("part", r"^<([A-Za-z0-9]+)", 1))
    level = F.regexp_extract(tag, "h([1-6])", 1).try_cast("int")
    return p.select(
        "document_id", T.stable_id(F.col("document_id"), F.col("reading_order")).alias("block_id"), F.when(level.isNotNull(), "heading").otherwise("text").alias("block_type"),
        visible_text("part").alias("content"), "source_file", level.alias("level"), "reading_order",
    )
