"""Histogram gradient boosting over all rows of a table, however many there are.

Trees see a value only by its bin, and bins are the same for all features, so equal rows
of bins are counted once and what is fitted on is a written table of them. A level of a
tree is one aggregation of DataFrame functions: the growing tree is a Column that gives
a row its leaf, and rows are summed up by leaf, feature and bin; the driver has these
sums only. What the trees made so far say of a row is a column of the table. Sums are
whole numbers, so their order does not matter and a fit repeats exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import scratch
from docloom.llm.quality import Forest

#: Upper ends of bins, for features that are counts.
EDGES = np.array([*range(48), 52, 56, 60, 64, 72, 80, 96, 112, 128, 160, 192, 256, 384, 512, 1024], float)
BINS = len(EDGES) + 1
#: Different rows that a task has on average. So many need no shuffle for a level's sums.
ROWS = 20_000
#: After so many trees what they say is written, so that plans stay short.
TREES = 8
#: Gradients are counted in units of one by this.
UNIT = 2**20


def bins(f: Column) -> Column:
    """The bins of an array of features."""
    few, rest = int(EDGES[47]), F.array(*[F.lit(float(e)) for e in EDGES[48:]])
    return F.transform(f, lambda v: F.when(v <= few, F.greatest(F.ceil(v), F.lit(0))).otherwise(F.size(F.filter(rest, lambda e: e < v)) + few + 1).cast("int"))


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """x, keys, ones, n: how many rows (f, label, weight) of the same bins there are, and those of label 1."""
    some = rows.select(bins(F.col("f")).alias("x"), *keys, (F.col("label") * F.col("weight")).cast("long").alias("one"), F.col("weight").cast("long").alias("weight"))
    return scratch.saved(some.groupBy("x", *keys).agg(F.sum("one").alias("ones"), F.sum("weight").alias("n")), "counted")


def walked(t: Forest, root: int, told: Callable[[int], str], x: str = "x") -> str:
    """What is told of the leaf of one tree in which a row of features x ends, as SQL."""
    if t.left[root] == root:
        return told(root)
    yes, no = (walked(t, int(to[root]), told, x) for to in (t.left, t.right))
    return f"CASE WHEN {x}[{int(t.feature[root])}] <= {float(t.threshold[root])!r}D THEN {yes} ELSE {no} END"


def margin(t: Forest, before: str, x: str = "x") -> str:
    """What a forest adds to what there was before, as SQL."""
    return " + ".join([before, *(walked(t, int(r), lambda k: f"{float(t.value[k])!r}D", x) for r in t.roots)])


def probability(margin: str) -> str:
    return f"1 / (1 + exp(-({margin})))"


def score(t: Forest, x: str = "x") -> Column:
    """The probability of label 1 that all trees give to a row of features x."""
    return F.expr(probability(margin(t, f"{t.base!r}D", x)))


def _sums(rows: DataFrame, before: str, tree: Forest, leaves: list[int], features: int) -> np.ndarray:
    """Gradients, curvatures and rows by leaf, feature and bin, of the leaves of a growing
    tree. rows: x, ones, n, and what the margin before it is made of."""
    shape = (len(leaves), features, BINS)
    end = walked(tree, int(tree.roots[0]), lambda k: str(leaves.index(k)) if k in leaves else "CAST(NULL AS int)")
    here = rows.selectExpr("x", "n", "ones", f"{probability(before)} AS p", f"{end} AS leaf").where("leaf IS NOT NULL")
    g, h = (f"CAST(rint({v} * {UNIT}) AS long)" for v in ("(p * n - ones)", "(p * (1 - p) * n)"))
    each = here.selectExpr("leaf", "n", f"{g} AS g", f"{h} AS h", "posexplode(x) AS (feature, bin)")
    out = np.zeros((3, *shape))
    for leaf, feature, b, *sums in each.groupBy("leaf", "feature", "bin").agg(*[F.sum(k) for k in "ghn"]).collect():
        out[:, leaf, feature, b] = sums
    return out / np.array([UNIT, UNIT, 1]).reshape(3, 1, 1, 1)


def fit(rows: DataFrame, features: int, trees: int, leaves: int, rate: float, least: int, l2: float = 1.0) -> tuple[Forest, Forest]:
    """(forest over features, forest over bins). rows: counted(). Trees grow level by
    level; of the leaves of a level those of most gain are cut, up to ``leaves`` in all."""
    n, ones, different = (int(v or 0) for v in rows.agg(F.sum("n"), F.sum("ones"), F.count("*")).first())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    feature, cut, left, right, value, roots, deepest = [], [], [], [], [], [], 1

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (cut, BINS), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    def forest(of: list[int], thresholds: list[float]) -> Forest:
        whole = np.array
        return Forest(whole(feature, int), whole(thresholds, float), whole(left, int), whole(right, int), whole(value, float), whole(of, int), deepest, base)

    before, tasks = f"{base!r}D", different // ROWS + 1
    for made in range(trees if 0 < ones < n else 0):
        if made % TREES == 0:
            rows = scratch.saved(rows.selectExpr("x", "ones", "n", f"{before} AS margin").coalesce(tasks), "margins").coalesce(tasks)
            before = "margin"
        root = node()
        level, size, depth = [root], 1, 0
        while level and size < leaves:
            sums = np.cumsum(_sums(rows, before, forest([root], cut), level, features), axis=3)
            g, h, m = sums
            gt, ht, mt = (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(m < least) | (mt - m < least)] = -1
            best = gain.reshape(len(level), -1).argmax(axis=1)
            most = gain.reshape(len(level), -1).max(axis=1)
            worth = lambda a, b: float(-rate * a / (b + l2))
            following = []
            for i in np.argsort(-most, kind="stable")[: leaves - size]:
                if most[i] <= 1e-6:
                    break
                k, f, b = level[i], best[i] // BINS, best[i] % BINS
                feature[k], cut[k], left[k], right[k] = int(f), int(b), node(), node()
                value[left[k]], value[right[k]] = worth(g[i, f, b], h[i, f, b]), worth(gt[i, f, 0] - g[i, f, b], ht[i, f, 0] - h[i, f, b])
                following += [left[k], right[k]]
                size += 1
            if following:
                depth += 1
                deepest = max(deepest, depth)
            level = following
        if size == 1:
            break
        roots.append(root)
        before = margin(forest([root], cut), before)
    ends = [*EDGES, np.inf]
    return forest(roots, [ends[min(c, BINS - 1)] for c in cut]), forest(roots, cut)
