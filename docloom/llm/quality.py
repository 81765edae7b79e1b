"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text come from its byte histogram, words and lines. Trees are
grown leaf by leaf on binned statistics with logistic loss, on the driver, from a
bounded sample of labelled rows (``max_rows``, those with the least hash of
doc_id; everything else covers all data). The trees are flattened into arrays,
and map tasks walk all trees of a batch of documents at once in numpy.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out of training. Inputs of a
score are the text's statistics only.

Defined results: a null text counts as empty and is scored like any other. A
doc_id with several labels counts with their mean; labels or ids that are null
are left out. With no labels at all, or labels of one kind, every score is the
smoothed share of label 1 ((ones + 1) / (labels + 2)).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common

# ----------------------------------------------------------------- statistics

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "high": range(128, 256),
    "space": (32, 9, 11, 12, 13),
    "line": (10,),
    "stop": b".!?",
    "comma": b",;:",
    "symbol": b"#$%&*+=<>@^_|~\\/",
    "bracket": b"()[]{}",
    "quote": b"\"'`-",
    "control": [x for x in range(32) if x not in (9, 10, 11, 12, 13)] + [127],
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _k] = 1

NAMES = [
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in _CLASSES), "entropy", "bytes_a_word", "distinct_words", "distinct_pairs", "longest_word",
    "short_words", "plain_words", "capital_words", "top_byte", "bytes_a_line", "distinct_lines", "repeated_bytes", "ended_lines", "longest_run", "words_a_stop",
    "same_word_again", "upper_lines", "upper_words", "marked_words",
]

_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
_MARKED = re.compile(r"^\W{1,4}$|\w\W{2,}$").search
_ENDS = (".", "!", "?", '"', ":", ";")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = hist @ _TABLE / n
    p = hist[hist > 0] / n
    words = text.split()
    w = max(1, len(words))
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    unique = set(lines)
    repeated = sum(map(len, lines)) - sum(map(len, unique))
    stops = float(hist[46] + hist[33] + hist[63])
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *shares, float(-(p * np.log2(p)).sum()), n / w, len(distinct) / w, len(set(zip(words, words[1:], strict=False))) / w,
        float(min(200, lengths.max(initial=0))), float((lengths <= 3).sum()) / w, sum(map(str.isalpha, distinct)) / max(1, len(distinct)), sum(map(str.istitle, distinct)) / max(1, len(distinct)),
        hist.max() / n, n / max(1, len(lines)), len(unique) / max(1, len(lines)), repeated / max(1, len(text)), sum(x.rstrip().endswith(_ENDS) for x in lines) / max(1, len(lines)),
        float(min(200, max((m.end() - m.start() for m in _RUN.finditer(text)), default=0))), w / (stops + 1),
        sum(map(str.__eq__, words, words[1:])) / w, sum(map(str.isupper, lines)) / max(1, len(lines)), sum(map(str.isupper, distinct)) / max(1, len(distinct)), sum(_MARKED(x) is not None for x in distinct) / max(1, len(distinct)),
    ]


# ---------------------------------------------------------------------- trees


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-(self.base + self.value[self.ends(x)].sum(axis=1))))

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each tree that a row ends in."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return node


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, leaves: int = 15, rate: float = 0.1, bins: int = 64, least: int = 8, l2: float = 1.0) -> Forest:
    """Leaf-wise boosting with logistic loss. y: share of label 1."""
    ones = float(y.sum()) + 1
    base = float(np.log(ones / (len(y) + 2 - ones)))
    empty = np.zeros(0, np.int32)
    if not len(y) or y.min() == y.max():
        return Forest(empty, empty, empty, empty, empty, empty, 0, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    features = x.shape[1]
    offset = np.arange(features) * bins
    flat = binned + offset
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots, deepest = [], [], [], [], [], [], 1

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = flat[rows].ravel()
        of = lambda v: np.bincount(at, None if v is None else np.repeat(v[rows], features), features * bins).reshape(features, bins)
        return of(g), of(h), of(None)

    def best(hist) -> tuple[float, int, int]:
        g, h, n = (np.cumsum(v, axis=1) for v in hist)
        gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
        gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
        gain[(n < least) | (nt - n < least)] = -1
        k = int(gain.argmax())
        return float(gain.flat[k]), k // bins, k % bins

    def leaf(depth: int, total: float) -> int:
        nonlocal deepest
        deepest = max(deepest, depth)
        k = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, total)):
            a.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        worth = lambda rows, g=g, h=h: -rate * g[rows].sum() / (h[rows].sum() + l2)
        every = np.arange(len(y))
        hist = histogram(every, g, h)
        open_ = [(leaf(0, worth(every)), every, hist, best(hist), 0)]
        roots.append(open_[0][0])
        count = 1
        while count < leaves:
            k = max(range(len(open_)), key=lambda i: open_[i][3][0])
            node, rows, hist, (gain, f, b), depth = open_[k]
            if gain <= 1e-6:
                break
            open_.pop(k)
            to_left = binned[rows, f] <= b
            parts = rows[to_left], rows[~to_left]
            small = 0 if len(parts[0]) <= len(parts[1]) else 1
            fresh = histogram(parts[small], g, h)
            rest = tuple(a - c for a, c in zip(hist, fresh, strict=True))
            feature[node], threshold[node] = f, edges[f][b] if b < len(edges[f]) else np.inf
            for side, to in enumerate((left, right)):
                own = fresh if side == small else rest
                to[node] = leaf(depth + 1, worth(parts[side]))
                open_.append((to[node], parts[side], own, best(own), depth + 1))
            count += 1
        for node, rows, *_ in open_:
            margin[rows] += value[node]
    return Forest(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float), np.array(roots), deepest, base)


# ------------------------------------------------------------------- operator

_STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **params) -> Forest:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    label = (
        labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("double").alias("q"))
        .where("of is not null and q is not null and crc32(cast(of as string)) % 4 <> 2")
        .groupBy("of")
        .agg(F.avg("q").alias("q"))
        .orderBy(F.xxhash64("of"), "of")
        .limit(max_rows)
    )
    wanted = common.ids_and_texts(docs, id_col, text_col).join(F.broadcast(label), F.col("doc_id") == F.col("of"))  # at most max_rows ids

    def collect(batches):
        for b in common.slices(batches):
            yield common.record(_STATS_Q, doc_id=b["doc_id"], q=b["q"], stats=[statistics(t) for t in common.texts(b["text"])])

    found = common.map_arrow(wanted.select("doc_id", "q", "text"), collect, _STATS_Q).groupBy("doc_id").agg(F.min("q").alias("q"), F.min("stats").alias("stats"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # at most max_rows
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r["q"] for r in rows], float), **params)


_STATS_Q = pa.schema([("doc_id", pa.int64()), ("q", pa.float64()), ("stats", pa.list_(pa.float64()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, forest: Forest, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle."""

    def walk(batches):
        for b in common.slices(batches):
            s = forest.score(np.array([statistics(t) for t in common.texts(b["text"])], float))
            yield common.record(SCORES, doc_id=b["doc_id"], held_out=[held_out(i) for i in b["doc_id"].to_pylist()], score=s, predicted=(s >= threshold).astype(np.int32))

    return common.map_arrow(common.ids_and_texts(docs, id_col, text_col), walk, SCORES)


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least ``threshold``, all columns kept."""

    at = docs.columns.index(text_col)

    def keep(batches):
        for b in common.slices(batches):
            s = forest.score(np.array([statistics(t) for t in common.texts(b.column(at))], float))
            if len(out := b.filter(pa.array(s >= threshold))):
                yield out

    return common.map_arrow(docs, keep, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
