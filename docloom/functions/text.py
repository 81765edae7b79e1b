"""Scalar text functions as Column expressions: they stay in the JVM and in
whole-stage code generation. Only Unicode normalisation (nfc) needs Python, since
Spark has no such function; callers ask for it where their text may need it."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and underscore as in Python's \w, spelled out for Java.
WORD = r"[\p{L}\p{N}_]"
#: What Python's str.strip() and \s take as white space.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same, as characters.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfc(c: Column | str) -> Column:
    """Unicode NFC, in Arrow batches."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(_c(c))


def strip(c: Column | str) -> Column:
    return F.btrim(_c(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """White space of all kinds to single spaces, none at the ends. Characters are
    mapped first, so that one short pattern does the rest."""
    return F.btrim(F.regexp_replace(F.translate(_c(c), SPACES, " " * len(SPACES)), " {2,}", " "), F.lit(" "))


def clean_text(c: Column | str) -> Column:
    """NUL and no-break spaces to spaces, blanks collapsed, line ends trimmed, at
    most one blank line, stripped. Null gives the empty text. Expects NFC."""
    t = F.translate(F.coalesce(_c(c), F.lit("")), "\x00\xa0", "  ")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, " *\\n *", "\n")
    return strip(F.regexp_replace(t, "\\n{3,}", "\n\n"))


def normalize_for_match(c: Column | str) -> Column:
    """Lower case, white space collapsed, stripped. Expects NFC."""
    return collapse(F.lower(_c(c)))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks below U+1F00, and their base letters."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in range(0xC0, 0x1F00):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            pairs[ch] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def strip_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(c), *_folding()), "\\p{Mn}", "")


def normalize_key(c: Column | str) -> Column:
    return collapse(F.lower(strip_diacritics(c)))


# -------------------------------------------------------------------- numbers

#: Units and currencies that are dropped before a number is read.
NUMBER_UNITS = ["vnđ", "vnd", "đồng", "usd", "đ", r"\$", "€", "triệu", "tỷ", "nghìn"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _digits_to_double(digits: Column) -> Column:
    """Which of "." and "," groups and which is decimal: with both, the last is
    decimal; a single kind groups if it repeats or leaves three digits (not after "0")."""
    dot, comma = F.contains(digits, F.lit(".")), F.contains(digits, F.lit(","))
    last_dot = F.length(F.substring_index(digits, ".", -1)) < F.length(F.substring_index(digits, ",", -1))
    both = F.when(last_dot, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.translate(digits, ",.", "."))
    grouped = digits.rlike(r"[.,][^.,]*[.,]|^(?!0[.,])[^.,]*[.,][^.,]{3}$")
    one = F.when(grouped, F.translate(digits, ".,", "")).otherwise(F.translate(digits, ",", "."))
    return F.when(dot & comma, both).otherwise(one).try_cast("double")


def parse_number(c: Column | str, python_repr: bool = False) -> Column:
    """A number in Vietnamese or English notation; null if it is none. With
    ``python_repr`` a plain float literal is read as such first."""
    text = strip(_c(c).cast("string"))
    raw = F.translate(F.regexp_replace(text, "(?iu)(" + "|".join(NUMBER_UNITS) + ")", ""), " ", "")

    def read(raw: Column) -> Column:
        sign, unit = F.when(raw.rlike(r"^\(.*\)$|^-"), -1.0).otherwise(1.0), F.when(raw.endswith("%"), 100.0).otherwise(1.0)
        value = let(F.regexp_replace(raw, "^[()%-]+|[()%-]+$", ""), _digits_to_double)
        return F.when(raw.rlike(r"^\(?-?[0-9][0-9.,]*\)?%?$"), sign * value / unit)

    number = let(raw, read)
    if python_repr:
        number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")).otherwise(number)
    return number


def number_tokens(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit("([0-9][0-9.,]*%?)"), F.lit(1)), lambda t: F.regexp_replace(t, "[.,]+$", ""))


def extract_numbers(c: Column | str) -> Column:
    """All numbers of a text, unsigned, in order."""
    return F.filter(F.transform(number_tokens(c), lambda t: parse_number(t)), lambda x: x.isNotNull())


def format_number(c: Column | str) -> Column:
    """Whole within 1e-9, else four decimals without trailing zeros; "." groups, "," decimals."""
    v = _c(c).cast("double")
    whole = F.translate(F.format_number(F.bround(v, 0), 0), ",", ".")
    part = F.translate(F.regexp_replace(F.regexp_replace(F.format_number(v, 4), "0+$", ""), "\\.$", ""), ".,", ",.")
    return F.when(F.abs(v - F.bround(v, 0)) < 1e-9, whole).otherwise(part)


def estimate_tokens(c: Column | str, chars_per_token: float = 3.6) -> Column:
    n = F.length(_c(c))
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n / F.lit(chars_per_token), 0).cast("int"))).otherwise(0)


# --------------------------------------------------------------------- tables


def escape_cell(c: Column) -> Column:
    """A cell of printable ASCII without blanks and bars stays as it is, which is cheap to see."""
    return F.when(c.rlike(r"^[!-{}~]*\z"), c).otherwise(_escaped(c))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(clean_text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def _pad(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))


def width_of(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def rows_to_markdown(rows: Column | str) -> Column:
    """array<array<string>> as a Markdown table; rows are padded to the widest, the first is the header."""
    rows = _c(rows)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(_pad(r, width_of(rows)), escape_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width_of(rows)), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), line)), "\n")
    return F.when(F.size(rows) > 0, text).otherwise("")


def markdown_table_rows(c: Column | str) -> Column:
    """The cells of all lines |...| of a text; rules (---) are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\r\n|[\n\r]"), strip), lambda x: x.startswith("|") & x.endswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, "^\\|+|\\|+$", ""), "(?<!\\\\)\\|"), clean_text))
    is_rule = lambda r: F.forall(F.filter(r, lambda x: x != ""), lambda x: x.rlike("^:?-{2,}:?$"))
    return F.filter(cells, lambda r: ~is_rule(r))


def table_to_text(rows: Column | str) -> Column:
    """Rows as lines with " | " between cells; bars and line ends in cells become ¦ and ⏎."""
    cell = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("¦")), F.lit("\n"), F.lit("⏎"))
    return F.array_join(F.transform(_c(rows), lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


def text_to_rows(text: Column | str, widths: Column) -> Column:
    """The rows of table_to_text; null unless the numbers of lines and cells are as given."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: strip(x) != "")
    cell = lambda x: F.replace(F.replace(strip(x), F.lit("¦"), F.lit("|")), F.lit("⏎"), F.lit("\n"))
    rows = F.transform(lines, lambda x: F.transform(F.split(x, "\\|"), cell))
    return F.when(F.transform(rows, F.size) == widths, rows)


def column_index(name: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(name), ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(a * 26 + F.ascii(ch) - 64))


def column_name(index: Column) -> Column:
    """1 -> A, 27 -> AA (up to three letters)."""
    i = index.cast("int")
    letter = lambda n: F.char(65 + n)
    a, b = (i - 1) % 26, F.floor((i - 1) / 26).cast("int")
    c, d = (b - 1) % 26, F.floor((b - 1) / 26).cast("int")
    return F.when(i <= 0, "A").otherwise(F.concat(F.when(d > 0, letter((d - 1) % 26)).otherwise(""), F.when(b > 0, letter(c)).otherwise(""), letter(a)))


def parse_cell_range(c: Column | str) -> Column:
    """'Sheet 1'!$B$2:$C$9 as struct(sheet, min_row, max_row, min_col, max_col); null if it is no range."""
    ref = strip(_c(c))
    has_sheet = F.contains(ref, F.lit("!"))
    cells = F.upper(F.replace(F.when(has_sheet, F.substring_index(ref, "!", -1)).otherwise(ref), F.lit("$"), F.lit("")))
    name = F.when(has_sheet, F.replace(F.regexp_replace(F.regexp_replace(ref, "![^!]*$", ""), "^'+|'+$", ""), F.lit("''"), F.lit("'")))
    shape = r"^([A-Z]{1,3})([0-9]+)(?::([A-Z]{1,3})([0-9]+))?$"
    g = lambda k: F.regexp_extract(cells, shape, k)
    r1, c1 = g(2).try_cast("int"), column_index(g(1))
    r2, c2 = F.coalesce(g(4).try_cast("int"), r1), F.when(g(3) != "", column_index(g(3))).otherwise(c1)
    return F.when(
        cells.rlike(shape),
        F.struct(
            name.alias("sheet"), F.least(r1, r2).alias("min_row"), F.greatest(r1, r2).alias("max_row"), F.least(c1, c2).alias("min_col"), F.greatest(c1, c2).alias("max_col")
        ),
    )


def ranges_overlap(a: Column, b: Column) -> Column:
    """Of two structs of parse_cell_range, sheets aside."""
    return (a["min_row"] <= b["max_row"]) & (b["min_row"] <= a["max_row"]) & (a["min_col"] <= b["max_col"]) & (b["min_col"] <= a["max_col"])


def unique_headers(header: Column | str) -> Column:
    """Blank names become column_N, repeats get _1, _2 and so on, as counted by name."""
    h = F.transform(_c(header), lambda x, i: F.when(strip(x) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(strip(x)))
    before = lambda i, x: F.size(F.filter(F.slice(h, 1, i), lambda y: y == x))
    return F.transform(h, lambda x, i: F.when((i > 0) & (before(i, x) > 0), F.concat(x, F.lit("_"), before(i, x).cast("string"))).otherwise(x))


# ----------------------------------------------------------------- identities


def text_sha1(c: Column | str) -> Column:
    return F.sha1(_c(c).cast("binary"))


def stable_id(*parts: Column, length: int = 20) -> Column:
    """First hex digits of the SHA-1 over the parts with "|" between; null counts as "None"."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, length)


#: Fixed value: the name space of URLs for UUIDs of version 5.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(c: Column | str) -> Column:
    """UUID version 5 of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), _c(c).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


# ------------------------------------------------------------------- contexts


def tail_context(c: Column | str, limit: int) -> Column:
    """The last ``limit`` characters, from a sentence start in their first half, else from a word start."""
    text = _c(c)
    if limit <= 0:
        return F.lit("")
    tail = F.right(text, F.lit(limit))
    cut = F.length(F.regexp_extract(F.substring(tail, 1, limit // 2), rf"(?s)^(.*?[.!?…]{SPACE}+)", 1))
    space = F.instr(tail, " ")
    rest = F.when(cut > 0, F.substring(tail, cut + 1, F.lit(limit))).when(space > 0, F.substring(tail, space + 1, F.lit(limit))).otherwise(tail)
    return F.when(F.length(text) <= limit, text).otherwise(rest)


def sentence_around(text: Column, position: Column, limit: int = 300) -> Column:
    """The sentence or line of ``text`` that holds the character at ``position`` (from 0), cut to ``limit``."""
    before, after = F.substring(text, F.lit(1), position), F.substring(text, position + 1, F.length(text))
    start = F.regexp_extract(before, r"([^.\n]*)$", 1)
    end = F.regexp_extract(after, r"^([^.\n]*[.\n]?)", 1)
    return F.substring(strip(F.concat(start, end)), 1, limit)


# ----------------------------------------------------------------- guardrails

#: Phrases that try to steer a model, for Java's regular expressions.
INJECTION_PATTERNS = [
    r"ignore (all |any |the )?(previous|prior|above) (instructions|prompts?)",
    r"disregard (all |the )?(previous|prior|above)",
    r"you are now",
    r"\bact as (an?|the) ",
    r"(reveal|show|print) (the |your )?(system prompt|instructions)",
    r"jailbreak",
    r"bỏ qua (tất cả |mọi |các )?(hướng dẫn|chỉ dẫn|quy tắc|yêu cầu)( trước| ở trên)?",
    r"quên (hết |tất cả )?(các )?(hướng dẫn|quy tắc)",
    r"(tiết lộ|hiển thị|in ra) (system prompt|lời nhắc hệ thống|hướng dẫn hệ thống)",
    r"từ bây giờ bạn là",
    r"<\|im_(start|end)\|>",
    r"\[/?(system|inst)\]",
]

#: Kinds of personal data, masked in this order.
PII_PATTERNS = [
    ("EMAIL", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"),
    ("CARD", r"(?U)\b(?:[0-9][ -]?){13,19}\b"),
    ("ID", r"(?U)\b[0-9]{12}\b|\b[0-9]{9}\b"),
    ("PHONE", r"(?<![0-9])(?:\+?84|0)(?:[ .-]?[0-9]){9,10}(?![0-9])"),
]


def detect_injection(c: Column | str) -> Column:
    """The patterns that a text matches."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.filter(F.array(*[F.when(text.rlike("(?iu)" + p), F.lit(p)) for p in INJECTION_PATTERNS]), lambda x: x.isNotNull())


def mask_pii(c: Column | str) -> Column:
    """The patterns run one after the other, each only where a text can match it."""
    out = _c(c)
    for label, pattern in PII_PATTERNS:
        can = F.contains(out, F.lit("@")) if label == "EMAIL" else out.rlike("[0-9](?:[^0-9]{0,3}[0-9]){8}")
        out = F.when(can, F.regexp_replace(out, pattern, f"<{label}>")).otherwise(out)
    return out


def sanitize_context(c: Column | str) -> Column:
    """Chat markers and source markers of a document lose their meaning."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"<\|im_(start|end)\|>", "<im>"), r"\[(SOURCE_[0-9]+)\]", "($1)")


def is_refusal(c: Column | str) -> Column:
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.contains(low, F.lit("không tìm thấy đủ thông tin")) | F.contains(low, F.lit("không có thông tin"))


def unsupported_numbers(answer: Column | str, context: Column | str) -> Column:
    """Number tokens of an answer whose value the context lacks; list marks up to 31 aside."""
    known = F.transform(extract_numbers(context), lambda x: F.round(x, 6))
    tokens = number_tokens(F.regexp_replace(F.coalesce(_c(answer), F.lit("")), "SOURCE_[0-9]+", ""))
    said = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.round(parse_number(t), 6).alias("v")))
    missing = lambda x, known: x["v"].isNotNull() & ~F.array_contains(known, F.coalesce(x["v"], F.lit(-1.0))) & ~((F.length(x["t"]) <= 2) & (x["v"] <= 31))
    return let(known, lambda k: F.array_distinct(F.transform(F.filter(said, lambda x: missing(x, k)), lambda x: x["t"])))


# --------------------------------------------------------------------- tokens


def tokenize(c: Column | str) -> Column:
    """Lower-case tokens; one with -, / or . inside also gives its joined form and its parts. Expects NFC."""
    word = r"[\p{L}\p{N}_À-ỹ]+"
    tokens = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(f"({word}(?:[-/.]{word})*)"), F.lit(1))
    more = lambda t: F.concat(F.array(t, F.regexp_replace(t, "[-/.]", "")), F.filter(F.split(t, "[-/.]"), lambda x: x != ""))
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("[-/.]"), more(t)).otherwise(F.array(t))))


# --------------------------------------------------------------- computations

#: Words that ask for an operation, in the order of precedence.
OPERATIONS = {
    "avg": ("trung bình", "bình quân", "average", "mean"),
    "max": ("lớn nhất", "cao nhất", "nhiều nhất", "tối đa", "max", "highest", "largest"),
    "min": ("nhỏ nhất", "thấp nhất", "ít nhất", "tối thiểu", "min", "lowest", "smallest"),
    "sum": ("tổng", "cộng lại", "tổng cộng", "sum", "total"),
    "count": ("đếm", "số lượng", "bao nhiêu dòng", "bao nhiêu mục", "có bao nhiêu", "count", "how many"),
}


def whole_word(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return text.rlike(f"(?<!{WORD})(?:" + "|".join(words) + f")(?!{WORD})")


def detect_operation(query: Column | str) -> Column:
    low = normalize_for_match(query)
    out = F.when(F.lit(False), "")
    for name, words in OPERATIONS.items():
        out = out.when(whole_word(low, words), name)
    return out.otherwise(F.lit(None).cast("string"))


# ----------------------------------------------------------------- correction

#: Tokens that a correction must not change.
PROTECTED_PATTERNS = [
    r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    r"(?iU)\b(?:https?://|www\.)\S+",
    r"(?<![\p{L}\p{N}_])[0-9][0-9.,/%:-]*(?![\p{L}\p{N}_])",
    r"(?U)\b[A-Z]{2,}[A-Z0-9-]*[0-9][A-Z0-9-]*\b",
]


def protected_tokens(c: Column | str) -> Column:
    found = [F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(p), F.lit(0)) for p in PROTECTED_PATTERNS]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), F.lower)))


def validate_correction(raw: Column | str, corrected: Column | str) -> Column:
    """Null if a correction is sound, else the reason against it."""
    raw, new = _c(raw), strip(F.coalesce(_c(corrected), F.lit("")))
    ratio = F.length(new) / F.greatest(F.lit(1), F.length(raw))
    lost = F.array_except(protected_tokens(raw), protected_tokens(new))
    return (
        F.when(new == "", "empty_output")
        .when(strip(raw) == "", F.when(new != raw, "unexpected_nonempty_output"))
        .when((ratio < 0.35) | (ratio > 3.0), "length_ratio")
        .when(F.size(lost) > 0, "protected_token_changed")
    )


def parse_json_object(c: Column | str) -> Column:
    """The outermost {...} of a model's output, fences aside, as variant; null if it is no object."""
    bare = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?m)^```(?:json)?|```$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.try_parse_json(body))


def parse_correction_output(c: Column | str) -> Column:
    """The text of an output that is a JSON object with the one string field corrected_text."""
    obj = strip(_c(c))
    fields = F.json_object_keys(obj)
    return F.when(F.try_parse_json(obj).isNotNull() & (fields == F.array(F.lit("corrected_text"))) & obj.rlike(r'(?s)^\{\s*"corrected_text"\s*:\s*"'), F.get_json_object(obj, "$.corrected_text"))
