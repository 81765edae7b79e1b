"""URL filter: host rules, and an empirical-Bayes reputation of hosts.

Rules come first: the longest that fits decides. All other pages get the verdict
of their host's reputation: outcomes of labelled pages (bad or not) are counted by
host and shrunk through beta-binomial priors, from host to registered domain to
suffix to all pages. Each level's prior has the mean of the level above and a
strength that is estimated by moments from the spread of rates at that level. A
host is blocked where the lower posterior bound of its bad share passes a limit.

Outcomes are an input (``bad``, null where a page has none). outcomes() gives those
of the query: a page is bad if the quality classifier, fitted on labelled documents,
finds the text of its article (else all visible text) worse than even; a page without
text has no outcome of its own.

Pages are read once, in Python batches. All the rest is DataFrame work: counts by
host are pre-aggregated, so that a hot host is a row per task, and only blocked hosts
are joined back to pages.

Defined results: a null url, or one without "://", has an empty host and path, fits
no rule, takes no part in reputations and is allowed. A null html has no text. Of
rules of one length the later in the order of their text wins. Null and repeated
page_ids keep their rows; other columns are ignored, whatever their names. An empty
table gives no rows; without any outcome no host is blocked.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import common, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: Suffixes of two names under which domains are registered; a parameter.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.mx", "com.ar", "co.in", "co.kr", "co.za", "com.cn", "com.tr", "com.tw"]


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(long_suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct (size, rule, verdict); null if none
    does. Rules are a literal, so their number should stay in the thousands."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


#: A name is taken whole, so that what follows it can't be tried at each of its letters.
_TAG = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9]*+)[^<>]*+>")
_RAW = {x: re.compile(rf"</{x}[^<>]*>", re.IGNORECASE) for x in ("script", "style")}
#: Elements whose text is not the page's, those that hold its main text, and those that stand in a line.
_ASIDE, _MAIN = {"head", "nav", "aside", "footer", "form"}, {"article", "main"}
_INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}


def main_text(html: str | None) -> str:
    """The text of a page's articles; of all that is visible if it has none. One
    pass: what is not closed is hidden or shown to the end."""
    html, at, aside, main = html or "", 0, 0, 0
    every: list[str] = []
    inside: list[str] = []

    def add(part: str) -> None:
        if not aside:
            every.append(part)
            if main:
                inside.append(part)

    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
            continue
        name, closes = m[2].lower(), bool(m[1])
        if name in _RAW and not closes:
            end = _RAW[name].search(html, at)
            at = end.end() if end else len(html)
        elif name in _ASIDE:
            aside = max(0, aside - 1) if closes else aside + 1
        elif name in _MAIN:
            main = max(0, main - 1) if closes else main + 1
        if name not in _INLINE:
            add("\n")
    add(html[at:])
    text = entities.unescape("".join(inside if any(map(str.strip, inside)) else every))
    return "\n".join(x for line in text.split("\n") if (x := " ".join(line.split())))


SEEN = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("bad", pa.int32())])


def outcomes(pages: DataFrame, forest: quality.Forest, good: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A written table of page_id, host, path and bad (1 or 0; null without text)."""
    url = pages[url_col].cast("string")
    slim = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), pages[html_col].cast("string").alias("html"))

    def judge(batches):
        for b in common.slices(batches):
            texts = list(map(main_text, b["html"].to_pylist()))
            low = forest.score(np.array([quality.statistics(t) for t in texts], float)) < good
            bad = [int(x) if t else None for x, t in zip(low, texts, strict=True)]
            yield common.record(SEEN, page_id=b["page_id"], host=b["host"], path=b["path"], bad=bad)

    return common.saved_map(slim, judge, SEEN, "seen")


def _strength(groups: DataFrame, mean: Column, n: str, bad: str) -> float:
    """Prior strength by moments over groups with counts n and bad around their
    mean: the spread beyond binomial noise. Between 1 and 1000; one number to the driver."""
    size = F.col(n)
    noise = F.sum(mean * (1 - mean))  # n times the binomial variance of a rate
    spread = F.sum(size * (F.col(bad) / size - mean) ** 2)
    beyond = F.greatest((spread - noise) / F.sum(size), F.lit(1e-9))
    strength = groups.agg((F.sum(size * mean * (1 - mean)) / F.sum(size) / beyond - 1).alias("k")).first()["k"]
    return min(1000.0, max(1.0, strength or 1.0))


def reputations(hosts: DataFrame, z: float = 1.96) -> DataFrame:
    """hosts: host, n, bad (a written table; each level reads it). Adds domain, suffix,
    the posterior mean and the lower bound of the bad share."""
    h = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = common.saved(h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")), "domains", light=True)
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    every = F.lit(hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m")).first()["m"] or 0.5)
    k0 = _strength(suffixes, every, "sn", "sbad")
    s = suffixes.withColumn("ms", (F.col("sbad") + k0 * every) / (F.col("sn") + k0))
    d = domains.join(s.select("suffix", "ms"), "suffix")
    k1 = _strength(d, F.col("ms"), "dn", "dbad")
    d = d.withColumn("md", (F.col("dbad") + k1 * F.col("ms")) / (F.col("dn") + k1))
    g = h.join(d.select("domain", "md"), "domain")
    k2 = _strength(g, F.col("md"), "n", "bad")
    a, b = F.col("bad") + k2 * F.col("md"), F.col("n") - F.col("bad") + k2 * (1 - F.col("md"))
    mean = a / (a + b)
    bound = F.greatest(F.lit(0.0), mean - z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
    return g.select("host", "domain", "suffix", "n", "bad", mean.alias("bad_mean"), bound.alias("bad_bound"))


def judge(seen: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = 0.5, z: float = 1.96) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of seen (page_id, host,
    path, bad), a table that is read twice. A host is blocked where the lower
    bound of its bad share passes ``limit``; ``z`` is the bound's number of
    standard deviations."""
    hosts = seen.where("bad is not null and host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = common.saved(hosts, "hosts", light=True)
    blocked = common.saved(reputations(hosts, z).where(F.col("bad_bound") > limit).select("host", F.lit("block").alias("by_host")), "blocked", light=True)
    placed = seen.drop("bad").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return placed.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_host", F.lit("allow")).alias("verdict")
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    forest = quality.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judge(outcomes(common.table(spark, sf_dir, "pages"), forest))
