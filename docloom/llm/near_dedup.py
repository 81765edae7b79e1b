"""Near-duplicate classes by order MinHash and banded alignment.

1. One pass turns each text into words (runs of letters, digits and underscores,
   lower case) and the sequence of its five-word shingles. Shingles are labelled
   with their occurrence number. Each of bands x rows samplings takes the two
   least-hashed labelled shingles and keeps their order in the text, so that equal
   samples speak for a small edit distance, not only for common content.
2. Texts with equal words are one class from the start; one of each, its head,
   goes on.
3. Heads that share a band are candidates. A bucket gives a star: its least head
   against the others, never all pairs. Candidates are verified by alignment:
   the longest common subsequence of both shingle sequences, in the band of
   offsets that can still reach the threshold, over the size of the union.
4. Verified links make classes (least-label propagation with pointer jumps).
   Where a bucket still holds heads of several classes, the pairs between its
   classes are verified as well. Small buckets give all these pairs. Large ones
   give a star of another head in each of TURNS turns, which joins most classes
   with linear work. What stays mixed is then dealt into blocks of bounded size,
   and each pair of blocks of a bucket goes to a task that tests its heads of
   different classes and fitting sizes. In buckets of over FEW_BLOCKS blocks heads
   first meet in groups: two of different classes can only be similar if they share
   one of their rarest shared shingles (meetings()), and each such group is dealt
   into blocks in place of the bucket. So all candidates are tested, in one class or
   too far apart, and only links and members of groups, never pairs of heads, are rows.

The similarity of sequences a and b is m / (|a| + |b| - m) with m the length of
the common subsequence: Jaccard's, for shingles that stand in the same order.

Defined results: a null text counts as empty; all texts without words are one
class. A text of fewer than five words is one shingle. Null and repeated doc_ids
keep their rows; the kept row of a class is its least doc_id's (null last, then
the first in the scan). class_id is the least doc_id of the class. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import common

K, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 2
#: A bucket of up to SMALL heads gives all pairs between its classes, a larger one a star each turn and then meetings.
SMALL, TURNS = 16, 2
#: Shingles that a block holds on average; a head counts as LIGHTEST at least.
BLOCK, LIGHTEST = 40_000, 100
#: Blocks of a bucket up to which all their pairs are tested, which copies a head once for each; above, heads meet by shingles.
FEW_BLOCKS = 8
#: Counters of shingles, as powers of two: at least, at most; and how many a task sends at a time.
LEAST_BITS, MOST_BITS, COUNTERS = 16, 22, 100_000
#: Words whose hashes a worker keeps; a full cache starts anew.
CACHE_WORDS = 300_000
_WORDS = re.compile(r"\w+").findall
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------- sketches


class Hasher:
    """Hashes of words, kept by a worker."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        kept = self.kept
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        out = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        if len(kept) > CACHE_WORDS:
            kept.clear()
        return out


_hasher = Hasher()


def _forget() -> None:
    """A task's words are cheap to hash again, and other stages need the memory."""
    _hasher.kept.clear()


def shingles(text: str, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words, in order; of the whole text if it has fewer, none if no words."""
    w = _hasher(_WORDS(text.lower()))
    if not len(w):
        return w
    k = min(k, len(w))
    with np.errstate(over="ignore"):
        out = w[: len(w) - k + 1].copy()
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _MUL + w[i : len(w) - k + 1 + i]
        return (out ^ (out >> np.uint64(32))) * _MUL


def occurrences(s: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it."""
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]]))
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles mixed with their occurrence number: those of one text are distinct, and
    two texts have as many in common as their multisets of shingles."""
    with np.errstate(over="ignore"):
        return s ^ (occurrences(s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(s) else s


def order_minhash(s: np.ndarray, samples: int) -> np.ndarray:
    """A hash of each sampling's two least labelled shingles, in text order."""
    with np.errstate(over="ignore"):
        label = (s ^ (occurrences(s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _MUL
        label ^= label >> np.uint64(31)
        seeds = np.random.default_rng(5).integers(0, 2**63, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        out = np.empty(samples, np.uint64)
        for i, seed in enumerate(seeds):
            h = label * seed
            h ^= h >> np.uint64(33)
            a = int(h.argmin())
            h[a] = np.uint64(2**64 - 1)
            b = int(h.argmin())
            a, b = min(a, b), max(a, b)
            out[i] = (s[a] * np.uint64(31) + s[b]) * _MUL
        return out ^ (out >> np.uint64(32))


def bands(s: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.int64)
    x = order_minhash(s, n * rows).reshape(n, rows)
    with np.errstate(over="ignore"):
        out = np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(rows):
            out = (out ^ x[:, j]) * _MUL
            out ^= out >> np.uint64(30)
        return out.view(np.int64)


# ------------------------------------------------------------------ alignment


#: Bytes of the bit masks of a text's most frequent shingles, and places of a shingle that are set one by one.
MASK_BYTES, SINGLY = 64 << 20, 64


class Places:
    """Where each shingle stands in a text, as bits of a window. The most frequent
    shingles, as far as memory goes, have a mask of the whole text, which is
    shifted; others have lists of places, so that repeats cost no more than a
    shift of the window."""

    def __init__(self, a: np.ndarray, size: int):
        self.size, self.full = size, (1 << size) - 1
        values, first, counts = np.unique(a, return_index=True, return_counts=True)
        order = np.argsort(a, kind="stable")
        starts = np.cumsum(counts) - counts
        keep = max(1, MASK_BYTES // (len(a) // 8 + 1))
        often = set(np.argsort(-counts, kind="stable")[:keep][np.sort(-counts)[:keep] < -2].tolist())
        self.lists, self.masks = {}, {}
        for k, (x, at, n) in enumerate(zip(values.tolist(), starts.tolist(), counts.tolist(), strict=True)):
            places = order[at : at + n]
            if k in often:
                self.masks[x] = self._bits(places, len(a))
            else:
                self.lists[x] = places if n > SINGLY else places.tolist()

    @staticmethod
    def _bits(places: np.ndarray, size: int) -> int:
        on = np.zeros(size, np.uint8)
        on[places] = 1
        return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")

    def window(self, x: int, low: int) -> int:
        """Bit i: x stands at place low + i."""
        if (mask := self.masks.get(x)) is not None:
            return (mask >> low if low >= 0 else mask << -low) & self.full
        places = self.lists.get(x)
        if places is None:
            return 0
        if isinstance(places, np.ndarray):
            near = places[np.searchsorted(places, low) : np.searchsorted(places, low + self.size)] - low
            return self._bits(near, self.size) if len(near) else 0
        hits = 0
        for i in places:
            if 0 <= i - low < self.size:
                hits |= 1 << (i - low)
        return hits


def common_length(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common subsequence of a and b whose matches lie
    within ``width`` of the diagonal. Common ends are cut off; the rest is
    aligned bit-parallel over a window of 2 * width + 1 places that moves along."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b, n = a[head:], b[head:], n - head
    if not n:
        return head
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    size = 2 * width + 1
    full = (1 << size) - 1
    places = Places(a, size)
    v, found = full, 0  # bit i of v: place low + i of a; a zero bit counts one match
    for j, x in enumerate(b.tolist()):
        low = j - width
        if j:
            found += not v & 1  # the lowest place leaves the window
            v = v >> 1 | 1 << (size - 1)
        if hits := places.window(x, low):
            u = v & hits
            v = ((v + u) | (v - u)) & full
    return head + tail + found + size - v.bit_count()


def _repeats(a: np.ndarray) -> int:
    return len(a) - len(np.unique(a))


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The similarity, or 0 where it is surely below the threshold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    total = len(a) + len(b)
    # What both hold, in any order, bounds m, and most pairs end here.
    both = len(np.intersect1d(a, b))
    if both + _repeats(a) < threshold / (1 + threshold) * total - 1e-9:
        return 0.0
    # m >= t / (1 + t) * total is needed, so at most this many places differ
    width = int(total * (1 - 2 * threshold / (1 + threshold)) + 1e-9) + 1
    m = common_length(a, b, width)
    return m / (total - m)


# -------------------------------------------------------------------- classes

SKETCH = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("size", pa.int64()), ("mark", pa.int64()), ("bands", pa.list_(pa.int64()))])
SEQUENCE = pa.schema([("row_key", pa.int64()), ("seq", pa.binary())])


def _schema(arrow: pa.Schema):
    return from_arrow_schema(arrow)


def sketches(docs: DataFrame, k: int, n: int, rows: int) -> DataFrame:
    """A written table of row_key, doc_id, a 128-bit hash of the words (hi, lo), the number of shingles, common.mark() and the band hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        import xxhash

        for b in common.slices(batches):
            his, los, sizes, sigs = [], [], [], []
            texts = common.texts(b["text"])
            for t in texts:
                s = shingles(t, k)
                raw = xxhash.xxh3_128_digest(" ".join(_WORDS(t.lower()))) if len(s) < 3 else xxhash.xxh3_128_digest(s.tobytes())
                his.append(int.from_bytes(raw[:8], "big", signed=True))
                los.append(int.from_bytes(raw[8:], "big", signed=True))
                sizes.append(len(s))
                sigs.append(bands(s, n, rows))
            yield common.record(SKETCH, row_key=b["row_key"], doc_id=b["doc_id"], hi=his, lo=los, size=sizes, mark=[common.mark(t) for t in texts], bands=sigs)

    return common.saved_map(docs, run, SKETCH, "sketch", _forget)


def sequences(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(row_key, seq) of the rows in wanted (row_key, mark): the shingle sequences,
    read from the texts again. Each task knows its own wanted rows from a side file;
    a text with another mark than the first scan's raises."""
    side = common.saved_by(wanted.select(F.shiftright("row_key", 33).cast("int").alias("src"), "row_key", "mark").repartition("src"), "src", "wanted")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        found = common.read_side(f"{side}/src={TaskContext.get().partitionId()}", ["row_key", "mark"])
        mine = dict(zip(found["row_key"].to_pylist(), found["mark"].to_pylist(), strict=True)) if found is not None else {}
        keys, seen = np.array(sorted(mine), np.int64), 0
        for b in batches:
            for x in common.slices(iter([b.filter(pa.array(np.isin(b["row_key"].to_numpy(), keys)))])):
                seen += x.num_rows
                rows = common.texts(x["text"])
                if [common.mark(t) for t in rows] != [mine[i] for i in x["row_key"].to_pylist()]:
                    raise RuntimeError(common.OTHER)
                yield common.record(SEQUENCE, row_key=x["row_key"], seq=[shingles(t, k).tobytes() for t in rows])
        if seen != len(mine):
            raise RuntimeError(common.OTHER)

    return common.saved_map(docs, run, SEQUENCE, "sequences", _forget)


def verify(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in common.slices(batches):
            read = lambda c, b=b: [np.frombuffer(x, np.uint64) for x in b[c].to_pylist()]
            ok = [similarity(x, y, threshold) >= threshold for x, y in zip(read("sa"), read("sb"), strict=True)]
            yield common.record(out, a=b["a"].filter(pa.array(ok)), b=b["b"].filter(pa.array(ok)))

    both = pairs.join(seqs.select(F.col("row_key").alias("b"), F.col("seq").alias("sb")), "b").join(seqs.select(F.col("row_key").alias("a"), F.col("seq").alias("sa")), "a")
    return common.saved_map(both.select("a", "b", "sa", "sb"), run, out, "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b): label is the least node of the
    component. Least labels of neighbours, then a jump to the label's label, until
    nothing changes; each round is written to the shared folder."""
    edges = common.saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", light=True)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
        after = common.saved(moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("to", "label")).alias("label")), "labels", light=True)
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with the components that new links join: these are few,
    so the graph of their labels is small, whatever the components hold."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    ends = common.saved(ends, "ends", light=True)
    fresh = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).union(ends.select("b", "lb")).distinct()
    moved = components(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("label", "to")
    every = labels.unionByName(fresh.join(labels.select("node"), "node", "left_anti"))
    return common.saved(every.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", light=True)


def _fits(m, n, threshold: float):
    """Whether texts of m and n shingles can be similar at all."""
    return F.least(m, n) >= threshold * F.greatest(m, n)


def _between(x: DataFrame, y: DataFrame, threshold: float, both_ways: bool = False) -> DataFrame:
    """Pairs a < b of heads of one bucket, of different labels and fitting sizes."""
    x, y = (t.select("bucket", F.col("head").alias(h), F.col("label").alias(f"l{h}"), F.col("size").alias(f"n{h}")) for t, h in ((x, "a"), (y, "b")))
    pairs = x.join(y, "bucket").where("la <> lb" if both_ways else "a < b and la <> lb").where(_fits(F.col("na"), F.col("nb"), threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_links(x: list[np.ndarray], y: list[np.ndarray] | None, x_labels: list[int], y_labels: list[int], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Places (i, j) of links between x and y, or within x where y is None, that
    join all their linked labels. Every pair of different labels is tested, unless
    links before it have joined them. Shingles that both hold, counted for all
    pairs at once, bound the common subsequence as in similarity()."""
    within = y is None
    if within:
        y, y_labels = x, x_labels
    if not x or not y:
        return []
    every = np.concatenate([*x, *y])
    if not len(every):
        return []
    # Equal shingles of one text count by their occurrence, so they can't match twice.
    mx, my = [labelled(s) for s in x], [labelled(s) for s in y]
    ny = np.array([len(s) for s in y])
    flat = np.concatenate(my)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(y)), ny)[order]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    labels, out = np.array(y_labels), []
    for i, s in enumerate(mx):
        n = len(s)
        if not n:
            continue
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        count = hi - lo
        at = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        both = np.bincount(owner[at], minlength=len(y))
        ok = (both >= threshold / (1 + threshold) * (n + ny) - 1e-9) & (np.minimum(n, ny) >= threshold * np.maximum(n, ny)) & (labels != x_labels[i])
        if within:
            ok[: i + 1] = False
        for j in np.flatnonzero(ok).tolist():
            a, b = root(x_labels[i]), root(y_labels[j])
            if a != b and similarity(x[i], y[j], threshold) >= threshold:
                parent[b] = a
                out.append((i, j))
    return out


def slot(s: np.ndarray, bits: int) -> np.ndarray:
    """The counters of labelled shingles among 2 ** bits."""
    with np.errstate(over="ignore"):
        return ((s * _MUL) >> np.uint64(64 - bits)).astype(np.int64)


def counted(mine: DataFrame, bits: int) -> str:
    """The folder of a written table (slot, n) of the counters of shingles in mine (head, label,
    seq) that heads of different labels have: n, how many heads. A task sends its counters."""
    out = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        n, low, high = np.zeros(1 << bits, np.int32), None, None
        for b in common.slices(batches):
            if low is None:
                low, high = np.full(1 << bits, 2**63 - 1, np.int64), np.full(1 << bits, -(2**63), np.int64)
            for label, raw in zip(b["label"].to_pylist(), b["seq"].to_pylist(), strict=True):
                at = slot(labelled(np.frombuffer(raw, np.uint64)), bits)
                n[at] += 1
                low[at], high[at] = np.minimum(low[at], label), np.maximum(high[at], label)
        used = np.flatnonzero(n)
        for i in range(0, len(used), COUNTERS):
            at = used[i : i + COUNTERS]
            yield common.record(out, slot=at, n=n[at], low=low[at], high=high[at])

    every = common.map_arrow(mine.select("label", "seq"), run, out).groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    path = common.scratch_path(mine.sparkSession, "counters")
    every.where("low <> high").select("slot", "n").write.parquet(path)
    return path


def meetings(mixed: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(bucket, head, size, label): groups of heads of mixed (head, size, label), such
    that any two of different labels whose similarity reaches the threshold share one.

    Texts of m and n shingles that are similar have t / (1 + t) * (m + n) of them in
    common, and n >= t * m, hence t * m at least. Shingles of one label can't be among
    these, so a head with fewer others than t * m meets nobody. Of those with more, the
    rarest of all but t * m - 1 are kept: the rarest common one of two similar heads is
    kept by both. Any order that all heads share serves, so how rare a shingle is comes from
    counters that others may share, which every task reads; only kept ones are dealt out.
    Groups with the same members are one. Rows are linear in shingles."""
    shared = pa.schema([("head", pa.int64()), ("size", pa.int64()), ("label", pa.int64()), ("bucket", pa.list_(pa.int64()))])
    heads = common.saved(mixed.select("head", "size", "label").distinct(), "meeting", light=True)
    total = heads.agg(F.sum("size")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * total).bit_length()))
    mine = common.saved(heads.join(seqs.select(F.col("row_key").alias("head"), "seq"), "head").select("head", "size", "label", "seq"), "meeting")
    path = counted(mine, bits)

    def run(batches: Iterator[pa.RecordBatch]):
        found = None
        for b in common.slices(batches):
            if found is None:
                found = common.read_side(path, ["slot", "n"])
                slots, n = (found[c].to_numpy() if found is not None else np.zeros(0, np.int64) for c in ("slot", "n"))
                order = np.argsort(slots)
                slots, n = np.append(slots[order], 1 << bits), np.append(n[order], 0)
            kept = []
            for size, raw in zip(b["size"].to_pylist(), b["seq"].to_pylist(), strict=True):
                s = labelled(np.frombuffer(raw, np.uint64))
                at = slot(s, bits)
                place = np.searchsorted(slots, at)
                wide = slots[place] == at
                s, often = s[wide], n[place[wide]]
                keep = max(0, len(s) - max(1, int(np.ceil(size * threshold - 1e-9))) + 1)
                kept.append(s[np.lexsort((s, often))[:keep]].view(np.int64))
            yield common.record(shared, head=b["head"], size=b["size"], label=b["label"], bucket=kept)

    held = common.saved(common.map_arrow(mine, run, shared).select(F.explode("bucket").alias("bucket"), "head", "size", "label"), "kept")
    members = [F.bit_xor(F.xxhash64("head")).alias("x"), F.bit_xor(F.xxhash64("head", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n")]
    several = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), *members).where("low <> high")
    several = common.saved(several.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "several", light=True)
    return held.join(several, "bucket")


def groups(mixed: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """mixed (bucket, head, size, label) with the meetings of its heads in place of each bucket of over FEW_BLOCKS blocks."""
    crowded = mixed.groupBy("bucket").agg(F.sum(F.greatest("size", F.lit(LIGHTEST))).alias("w")).where(F.col("w") > FEW_BLOCKS * BLOCK).select("bucket")
    crowded = common.saved(crowded, "crowded", light=True)
    if crowded.isEmpty():
        return mixed
    rest = mixed.join(crowded, "bucket", "left_anti").select("bucket", "head", "size", "label")
    met = meetings(mixed.join(crowded, "bucket"), seqs, threshold).select("bucket", "head", "size", "label")
    return common.saved(rest.unionByName(met), "meetings", light=True)


def blocks(mixed: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the labels of each bucket of mixed (bucket, head, size,
    label), from all pairs of heads of different labels and fitting sizes.

    A label with more than a block's shingles in a bucket has blocks of its own,
    which need no test against each other; other labels share blocks."""
    weight = F.greatest("size", F.lit(LIGHTEST))
    by_label = mixed.groupBy("bucket", "label").agg(F.sum(weight).alias("w"))
    by_label = common.saved(by_label, "weights", light=True)
    shared = by_label.where(F.col("w") <= BLOCK).groupBy("bucket").agg(F.ceil(F.sum("w") / BLOCK).alias("shared"))
    placed = mixed.join(by_label, ["bucket", "label"]).join(shared, "bucket", "left")
    alone = F.col("w") > BLOCK
    # The block's name: its label (null for shared ones) and a number.
    number = F.when(alone, F.pmod(F.xxhash64("head"), F.ceil(F.col("w") / BLOCK))).otherwise(F.pmod(F.xxhash64("label", "bucket"), F.col("shared")))
    block = F.struct(F.coalesce(F.when(alone, F.col("label")), F.lit(-1)).alias("own"), number.alias("no"))
    placed = common.saved(placed.select("bucket", "head", "size", "label", block.alias("block")), "blocks", light=True)
    sizes = placed.groupBy("bucket", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    sizes = common.saved(sizes, "sizes", light=True)
    one, two = (sizes.select("bucket", F.col("block").alias(b), F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")) for b in "xy")
    tasks = one.join(two, "bucket").where("x <= y and (x.own = -1 or x.own <> y.own)").where((F.col("high_x") >= threshold * F.col("low_y")) & (F.col("high_y") >= threshold * F.col("low_x")))
    tasks = common.saved(tasks.select("bucket", "x", "y"), "tasks", light=True)
    ends = tasks.select("bucket", "x", "y", F.col("x").alias("block"), F.lit(False).alias("right")).unionByName(tasks.where("x <> y").select("bucket", "x", "y", F.col("y").alias("block"), F.lit(True).alias("right")))
    rows = placed.join(ends, ["bucket", "block"]).select(F.xxhash64("bucket", "x", "y").alias("task"), "right", "head", "label", (F.col("x") == F.col("y")).alias("within"))
    rows = rows.join(seqs.select(F.col("row_key").alias("head"), "seq"), "head")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(t: pa.Table) -> pa.Table:
        right = np.array(t["right"].to_pylist(), bool)
        heads, labels, seq = (np.array(t["head"].to_pylist(), np.int64), t["label"].to_pylist(), [np.frombuffer(s, np.uint64) for s in t["seq"].to_pylist()])
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        part = lambda of, at: [of[k] for k in at]
        if t["within"][0].as_py():
            found, j = block_links(part(seq, i), None, part(labels, i), [], threshold), i
        else:
            found = block_links(part(seq, i), part(seq, j), part(labels, i), part(labels, j), threshold)
        pairs = [sorted((int(heads[i[p]]), int(heads[j[q]]))) for p, q in found]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}, schema=out)

    return common.saved(rows.groupBy("task").applyInArrow(test, _schema(out)), "links", light=False).distinct()


def classes(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as row_key, mark, doc_id, class_id, class_size, kept.

    What is known of a bucket or class is written before it is joined back to its
    members: both sides of such a join are then plain shuffles, of which adaptive
    execution splits the hot ones."""
    slim = common.ids_and_texts(docs, id_col, text_col).withColumn("row_key", common.row_key())
    sketch = sketches(slim, k, n_bands, rows)
    heads = sketch.groupBy("hi", "lo").agg(F.min("row_key").alias("head"))
    heads = common.saved(heads, "heads", light=True)
    posts = sketch.select(F.col("row_key").alias("head"), "size", "mark", "bands").join(heads.select("head"), "head").select("head", "size", "mark", F.explode("bands").alias("bucket"))
    full = posts.groupBy("bucket").agg(F.min(F.struct("head", "size")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    full = common.saved(full.select("bucket", "least"), "full", light=True)
    posts = common.saved(posts.join(full, "bucket"), "posts", light=True)
    stars = posts.where("head <> least.head").where(_fits(F.col("size"), F.col("least.size"), threshold)).select(F.col("least.head").alias("a"), F.col("head").alias("b")).distinct()
    tested = stars = common.saved(stars, "stars", light=True)
    seqs = sequences(slim, posts.select(F.col("head").alias("row_key"), "mark").distinct(), k)
    links = verify(stars, seqs, threshold)
    labels = components(links)
    posts = posts.select("bucket", "head", "size")
    for turn in range(1, TURNS + 2):
        placed = posts.join(labels.withColumnRenamed("node", "head"), "head", "left").withColumn("label", F.coalesce("label", "head"))
        placed = common.saved(placed, "placed", light=True)
        mixed = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        mixed = common.saved(mixed.select("bucket", (F.col("n") > SMALL).alias("large")), "mixed", light=True)
        mixed = placed.join(mixed, "bucket")
        few, many = mixed.where("not large").drop("large"), common.saved(mixed.where("large").drop("large"), "many", light=True)
        if turn > TURNS:  # all small buckets are done since the first turn
            fresh = blocks(groups(many, seqs, threshold), seqs, threshold)
        else:
            lead = many.groupBy("bucket").agg(F.min_by(F.struct("head", "size", "label"), F.xxhash64("head", "bucket", F.lit(turn))).alias("lead")).select("bucket", "lead.*")
            lead = common.saved(lead, "lead", light=True)
            pairs = _between(few, few, threshold).unionByName(_between(lead, many, threshold, both_ways=True))
            more = common.saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "more", light=True)
            fresh = verify(more, seqs, threshold)
            tested = tested.unionByName(more)
        if not fresh.isEmpty():
            labels = joined(labels, fresh)
        posts = many.select("bucket", "head", "size")
        if many.isEmpty():
            break
    heads = heads.join(labels.withColumnRenamed("node", "head"), "head", "left").select("hi", "lo", F.coalesce("label", "head").alias("label"))
    placed = common.saved(sketch.drop("bands", "size").join(heads, ["hi", "lo"]).drop("hi", "lo"), "classes")
    # A null doc_id sorts last: ordered by (is null, doc_id, row_key).
    best = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    best = common.saved(best.select("label", F.col("best.doc_id").alias("class_id"), F.col("best.row_key").alias("keep_key"), "class_size"), "best", light=True)
    return placed.join(best, "label").select("row_key", "mark", "doc_id", "class_id", "class_size", (F.col("row_key") == F.col("keep_key")).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns kept."""
    return common.drop_rows(docs, classes(docs, id_col=id_col, text_col=text_col).where("not kept").select("row_key", "mark"), text_col)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).drop("row_key", "mark")
