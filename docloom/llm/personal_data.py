"""Personal data: overlapping candidates, judged by gradient-boosted trees.

Generators of high recall propose spans: the base kinds (email, ip, card, phone) with
their checks, and loose forms (spelled-out addresses, numbers without a country code,
identity numbers, bank accounts, IPv6). A candidate's format and the text around it
give its features. Trees, fitted on all labelled candidates by aggregations of their counts, score
the loose candidates; a threshold for each generator, set on candidates held out from fitting,
selects those to redact. Base spans that pass their check always stay.

No one has labelled candidates, so labels come from a distance: a loose candidate
inside a sound base span is one (its country code is hidden from the features), one
glued to other letters or inside a longer number is none; checks (IBAN remainders,
blocks of identity numbers that are never given out, Luhn sums) decide others; emails
spelled out give examples of that form; and a short list of worked examples covers
kinds that a corpus may lack. Candidates without any of these are not fitted on.

All of it is DataFrame functions: a text is cut at a generator's matches, so the gaps
give each match its place and its context, in one scan of the texts. What follows are
narrow rows of candidates. Patterns are written so that long texts take linear time.

Defined results: a null text counts as empty. Null and repeated doc_ids keep their
rows. Other columns are ignored, whatever their names. A loose span inside a sound
base span is left out; other overlapping spans stay beside each other. A table
without any labelled candidate is judged by the worked examples alone. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import scratch
from docloom.functions.text import let
from docloom.llm import boosting, common, quality

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
#: Where a run of local characters begins: its inner places can't match where its start
#: didn't, but for what the match before has left over.
_RUN = rf"(?:\G|(?<!{_LOCAL}))"

#: Kinds and their patterns for Java's regular expressions, base kinds first.
GENERATORS = [
    ("email", rf"{_RUN}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[ -]?[0-9]){12,}+"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email_text", rf"{_RUN}{_LOCAL}++(?: ?[\[({{](?i:at)[\])}}] ?| (?i:at) ){_LABEL}++(?:(?: ?[\[({{](?i:dot)[\])}}] ?| (?i:dot) |\.){_LABEL}++)++"),
    ("phone_text", r"(?<![0-9.-])(?:\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|0[0-9](?:[ .-]?[0-9]{2}){4})(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"),
]
KINDS = [k for k, _ in GENERATORS]
BASE = 4
#: A text without this has no match of the kind; of the others none without a digit.
GATES = {"email": "@", "phone": r"\+", "email_text": "[aA][tT]", "ipv6": ":"}

#: What is said before personal data of a kind, and before other numbers.
CUES = [
    r"phone|\bcall|\btel\b|mobile|\bcell|\bfax|telefon|téléphone|teléfono|móvil|\bhandy|whatsapp|\bsms\b|\bdial",
    r"mail|contact|write to|reach|correo|courriel|schreib",
    r"\bssn\b|social sec|passport|tax id|national id|\bdni\b|\bnif\b|ausweis|identi",
    r"iban|account|\bbank|konto|compte|cuenta",
    r"order|invoice|\bref\b|isbn|issn|version|token|\bkey|hash|serial|\bpart\b|model|\bsku\b|build|commit|price|total|\bpage|\bitem|\bno\.|#|\$|€|£|=|factur|bestell|pedido|precio|preis|prix",
]

#: Worked examples: kind, text before, candidate, text after, whether it is personal data.
EXAMPLES = [
    ("phone_text", "call me at ", "(212) 555-0182", " today", 1), ("phone_text", "Phone: ", "212-555-0182", "", 1), ("phone_text", "tel ", "06 12 34 56 78", ", merci", 1),
    ("phone_text", "mobile ", "415.555.0134", ".", 1), ("phone_text", "fax: ", "030 5550 1234", "", 1), ("phone_text", "her number is ", "(415) 555 0101", ".", 1),
    ("phone_text", "order ", "2120 555 0182", "", 0), ("phone_text", "invoice #", "4155550134", "", 0), ("phone_text", "total of ", "1234567890", " units", 0),
    ("phone_text", "on ", "2024-1130-0930", "", 0), ("phone_text", "ISBN ", "0306 406 1523", "", 0), ("phone_text", "id=", "20240115123", "&", 0), ("phone_text", "of the ", "1234567890", " and", 0),
    ("id", "SSN: ", "219-09-9821", "", 1), ("id", "social security number ", "457-55-5462", ".", 1), ("id", "my ssn is ", "078 05 1120", "", 1),
    ("id", "order ", "219-09-9821", "", 0), ("id", "part no. ", "900-12-0000", "", 0), ("id", "model ", "457-55-5462", "", 0), ("id", "of ", "666-00-1234", "", 0), ("id", "the ", "123-45-6789", " th", 0),
    ("iban", "IBAN ", "DE89370400440532013000", "", 1), ("iban", "account: ", "GB82 WEST 1234 5698 7654 32", ".", 1), ("iban", "compte ", "FR1420041010050500013M02606", "", 1),
    ("iban", "key ", "AB12CDEF3456GHIJ7890", "", 0), ("iban", "token=", "XX00AAAABBBBCCCC", "", 0), ("iban", "", "DE89370400440532013001", "", 0), ("iban", "to ", "ES9121000418450200051332", "", 1),
    ("email_text", "write to ", "anna.may [at] example [dot] com", "", 1), ("email_text", "contact ", "joe99 at mail dot example dot org", " or", 1), ("email_text", "", "info(at)example.org", "", 1),
    ("email_text", "they were ", "home at last.and", "", 0), ("email_text", "we ", "look at things.then", " go", 0), ("email_text", "the ", "sale at shop.com", "", 0),
    ("ipv6", "from ", "2001:db8:0:0:8:800:200c:417a", "", 1), ("ipv6", "host ", "fe80::1ff:fe23:4567:890a", "", 1), ("ipv6", "at ", "2001:db8::1", " and", 1), ("ipv6", "time ", "12::30", "", 0), ("ipv6", "", "1::2", "", 0), ("ipv6", "std", "a::b", "", 0),
]

CONTEXT = 40
#: Scores from 0 to 1 are told apart by so many steps where thresholds are set.
STEPS = 10_000


def _matches(text: Column, g: int, pattern: str, gate: str) -> Column:
    """The matches of one generator: its number, their order, the length of the gap
    before, the match, and what stands right before and after it."""
    parts = let(
        F.split(text, pattern, -1),
        lambda gaps: F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m, i: F.struct(F.lit(g).alias("g"), i.alias("i"), F.length(gaps[i]).alias("gap"), m.alias("m"), F.substring(gaps[i], -CONTEXT, CONTEXT).alias("before"), F.substring(gaps[i + 1], 1, 4).alias("after")),
        ),
    )
    return F.when(text.rlike(gate), parts).otherwise(F.array().cast("array<struct<g:int,i:int,gap:int,m:string,before:string,after:string>>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(g: Column, m: Column) -> Column:
    """Whether a candidate of a base kind is sound, as the base kinds define it."""
    digits, part = F.length(_digits(m)), "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
    card = digits.between(13, 19) & F.call_function("luhn_check", _digits(m))
    return F.when(g == 0, F.lit(True)).when(g == 1, m.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(g == 2, card).when(g == 3, digits.between(9, 15)).otherwise(F.lit(False))


def _count(c: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{chars}]", ""))


def _remainder(m: Column) -> Column:
    """The IBAN remainder modulo 97: its first four characters behind the rest, letters as numbers."""
    bare = F.substring(F.replace(m, F.lit(" "), F.lit("")), 1, 40)
    moved = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(moved, F.lit(0), lambda s, x: F.when(x == "", s).otherwise((s * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))


#: What the trees see of a candidate.
NAMES = [
    "kind", "length", "digits", "letters", "capitals", "spaces", "hyphens", "dots", "brackets", "colons", "groups", "first", "second", "last", "different", "luhn", "remainder", "never", "year", "spelled", "glued_before", "glued_after", "named",
    *(f"cue_{i}" for i in range(len(CUES))),
]


def _features(g: Column, m: Column, before: Column, after: Column) -> dict[str, Column]:
    short = F.substring(m, 1, 64)
    groups = F.regexp_extract_all(short, F.lit("[0-9]+"), F.lit(0))
    said = F.lower(F.regexp_replace(before, r"\+[0-9]{0,3} ?$", ""))
    size = lambda i: F.coalesce(F.length(F.try_element_at(groups, F.lit(i))), F.lit(0))
    return {
        "kind": g, "length": F.length(m), "digits": _count(m, "0-9"), "letters": _count(m, "A-Za-z"), "capitals": _count(m, "A-Z"), "spaces": _count(m, " "), "hyphens": _count(m, "-"), "dots": _count(m, "."),
        "brackets": _count(m, r"()\[\]{}"), "colons": _count(m, ":"), "groups": F.size(groups), "first": size(1), "second": size(2), "last": size(-1),
        "different": F.size(F.array_distinct(F.split(_digits(short), ""))), "luhn": F.call_function("luhn_check", _digits(short)), "remainder": F.when(g == 7, _remainder(m) == 1).otherwise(F.lit(False)),
        "never": (g == 6) & short.rlike("^(?:000|666|9)|[ -]00[ -]|0000$"), "year": short.rlike("^(?:19|20)[0-9]{2}(?![0-9])"), "spelled": short.rlike(r"(?i)[\[({](?:at|dot)[\])}]| dot "),
        "glued_before": said.rlike(r"[\p{L}\p{N}_/:.=-]$"), "glued_after": after.rlike(r"^[\p{L}\p{N}_/=-]"), "named": short.rlike(r"^[A-Za-z]*[0-9._][A-Za-z0-9._]* "),
        **{f"cue_{i}": said.rlike(cue) for i, cue in enumerate(CUES)},
    }


def _vector(features: dict[str, Column]) -> Column:
    return F.array(*[F.coalesce(features[name].cast("double"), F.lit(0.0)) for name in NAMES])


def _f(name: str) -> Column:
    return F.col("f")[NAMES.index(name)]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row for each candidate, and one with a null g for texts
    without any: row, doc_id, g, start, end (code points), sound (a base span),
    covered (inside a sound base span), f (features) and label (1, 0 or null)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    slim = docs.select(common.row_key().alias("row"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    every = F.concat(*[_matches(F.col("text"), g, pattern, GATES.get(kind, "[0-9]")) for g, (kind, pattern) in enumerate(GENERATORS)])
    found = slim.select("row", "doc_id", F.explode_outer(every).alias("c")).select("row", "doc_id", "c.*")
    found = found.withColumns({"size": F.length("m"), "sound": F.coalesce(_passes(F.col("g"), F.col("m")), F.lit(False)), "f": F.when(F.col("g").isNotNull(), _vector(_features(*map(F.col, ("g", "m", "before", "after")))))})
    found = found.drop("m", "before", "after").repartition("row")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "g").orderBy("i"))).withColumn("start", F.col("end") - F.col("size"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "g").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda which: (F.col("g") >= BASE) & (F.coalesce(F.max(F.when(which, F.col("end"))).over(before), F.lit(0)) >= F.col("end"))
    placed = placed.withColumns({"covered": inside(F.col("sound")), "in_phone": inside(F.col("sound") & (F.col("g") == 3)), "in_other": inside(F.col("g") < 3)})
    return scratch.saved(placed.withColumn("label", _label()).select("row", "doc_id", "g", "start", "end", "sound", "covered", "f", "label"), "candidates")


def _label() -> Column:
    """1, 0 or null: what checks and neighbours say of a loose candidate."""
    glued, g = (_f("glued_before") == 1) | (_f("glued_after") == 1), F.col("g")
    return (
        F.when(g < BASE, None)
        .when(F.col("in_phone"), F.when(g == 5, 1))
        .when(F.col("in_other") | (glued & g.isin(5, 6)), 0)
        .when(g == 7, F.when((_f("remainder") == 1) & ~glued, 1).otherwise(0))
        .when((g == 6) & (_f("never") == 1), 0)
        .when((g == 5) & (_f("year") == 1), 0)
        .when((g == 4) & (_f("spelled") == 0) & (_f("named") == 0), 0)
    )


# ------------------------------------------------------------------------ model


@dataclass
class Model:
    forest: quality.Forest
    thresholds: list[float]  # of each generator; base kinds have none

    def score(self) -> Column:
        """The probability that a candidate with features f is personal data."""
        return boosting.score(self.forest, "f")

    def picked(self) -> Column:
        """Whether a candidate is to be redacted."""
        limit = F.get(F.array(*[F.lit(float(t)) for t in self.thresholds]), F.col("g"))
        loose = (F.col("g") >= BASE) & ~F.col("covered") & (self.score() >= limit)
        return F.coalesce(F.col("sound") | loose, F.lit(False))


def _examples(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(KINDS.index(kind)).alias("g"), F.lit(m).alias("m"), F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(y).alias("label")) for kind, before, m, after, y in EXAMPLES])
    found = spark.range(1).select(F.inline(rows))
    return found.select("g", _vector(_features(*map(F.col, ("g", "m", "before", "after")))).alias("f"), "label")


def fit(found: DataFrame, repeat: int = 10, share: int = 20_000, precision: float = 0.9, doubtful: float = 0.8, trees: int = 40, leaves: int = 6) -> Model:
    """Fit on all labelled candidates but a third, and on each worked example ``repeat``
    times (with more than ``share`` candidates more often, so that it keeps its share).
    The third, by a hash of the features, is held out: a generator's threshold is the
    least score, of a half at least and in steps of 1 / STEPS, from which on a share of
    ``precision`` of those held out is personal data; with fewer than twenty held out,
    or none so good, it is ``doubtful``."""
    labelled = found.where("label is not null").select("f", F.col("label").cast("int").alias("label"), F.lit(1).alias("weight"))
    rows = labelled.withColumn("held", F.pmod(F.xxhash64("f", F.lit(7)), F.lit(3)) == 0)
    times = repeat * max(1.0, labelled.count() / share)
    given = _examples(found.sparkSession).select("f", "label", F.lit(round(times)).alias("weight"), F.lit(False).alias("held"))
    counted = boosting.counted(rows.unionByName(given), "held")
    forest, by_bins = boosting.fit(counted.where("not held"), len(NAMES), trees=trees, leaves=leaves, rate=0.2, least=5)

    step = F.floor(boosting.score(by_bins) * STEPS).cast("int")
    held = np.zeros((2, len(KINDS), STEPS + 1))
    for r in counted.where("held").groupBy(F.col("x")[NAMES.index("kind")].alias("g"), step.alias("step")).agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect():
        held[:, r["g"], r["step"]] = r["ones"], r["n"]
    thresholds = []
    for g, (ones, n) in enumerate(held.transpose(1, 0, 2)):
        limit = doubtful
        if g >= BASE and n.sum() >= 20:
            right, every = (np.cumsum(v[::-1])[::-1] for v in (ones, n))
            good = (n > 0) & ((right + 1) / (every + 2) >= precision)
            if len(at := np.flatnonzero(good[STEPS // 2 :])):
                limit = (STEPS // 2 + int(at[0])) / STEPS
        thresholds.append(limit)
    return Model(forest, thresholds)


# ---------------------------------------------------------------------- results


def spans(found: DataFrame, model: Model) -> DataFrame:
    """row, doc_id and spans (an array of g, start, end, sound, in this order) of every text."""
    span = F.struct("g", "start", "end", "sound")
    return found.withColumn("picked", model.picked()).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("picked"), span))).alias("spans"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["g"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, found: DataFrame, model: Model, mask: str = "#", text_col: str = "text", size: int = 1000) -> DataFrame:
    """docs with each character of a span as ``mask``. found: candidates(docs), of the
    same files. Texts are masked by pieces of ``size`` characters."""
    marked = docs.withColumn("row_", common.row_key()).join(spans(found, model).select(F.col("row").alias("row_"), F.col("spans").alias("spans_")), "row_")

    def piece(c: Column, i: Column) -> Column:
        at = i * size
        here = F.filter("spans_", lambda s: (s["end"] > at) & (s["start"] < at + size))
        start = lambda s: F.greatest(s["start"] - at, F.lit(0))
        length = lambda s: F.least(s["end"] - at, F.length(c)) - start(s)
        return F.aggregate(here, c, lambda t, s: F.overlay(t, F.repeat(F.lit(mask), length(s).cast("int")), (start(s) + 1).cast("int"), length(s).cast("int")))

    pieces = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    masked = F.when(F.size("spans_") > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(F.col(text_col))
    return marked.withColumn(text_col, masked).select(*docs.columns)


def digest(found: DataFrame, model: Model) -> DataFrame:
    base = F.filter("spans", lambda s: s["sound"])
    count = lambda g: F.size(F.filter("spans", lambda s: s["sound"] & (s["g"] == g))).cast("long").alias(f"n_{KINDS[g]}")
    return spans(found, model).select("doc_id", *[count(g) for g in range(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    found = candidates(common.table(spark, sf_dir, "documents"))
    return digest(found, fit(found))
