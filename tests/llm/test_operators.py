"""The training-data operators against brute force, libraries and hard rows."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, binary_output, bpe, common, exact_dedup, license_scan, near_dedup, packing, quality, token_counts, tokenizers_, url_filter
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (tokenizers_.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def corpus(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ------------------------------------------------------------------ tokenizers

MIXED = st.text(st.sampled_from("ab'stLL rEé  ñßΣσİ12½٣日本🏽́.,;#<|>\t\n\x1c\x85"), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=8))
def test_encoders_equal_the_library(texts):
    texts = [*texts, "x<|endoftext|>y", "<|startoftext|>"]
    word, byte = library(WORD), library(BYTE)
    encoder, table = bpe.word_codec(WORD)
    for t, raw, other in zip(texts, encoder(texts), tokenizers_.word_bpe(WORD)(texts), strict=True):
        want = word.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(raw, encoder.dtype)
        assert ids.tolist() == want and raw == other
        assert table.decode(ids).decode() == word.decode(want, skip_special_tokens=False)
        assert tokenizers_.byte_bpe(BYTE)(t).tolist() == byte.encode(t, add_special_tokens=False).ids


def test_backtracking_on_long_words():
    model, lib = bpe.Backtracking(tokenizers_.load(WORD)), library(WORD).model
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300, 5000):
        for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "théàn"):
            w = "".join(rng.choice(list(letters), n)).encode().decode("latin-1").translate({b: c for c, b in tokenizers_._byte_chars().items()})
            assert model.word(w) == [t.id for t in lib.tokenize(w)]


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.pieces_of(PIECE)
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library(spark):
    t, count = unigram(), token_counts.counter(PIECE)
    texts = [x for _, x in corpus(spark)] + ["", " ", " a", "▁b", "日本語🏽🏽x", "x" * 300, "a\x00b", "a  b\n"]
    assert [n for n, _, _ in count(texts)] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=5))
def test_counts_of_odd_texts(texts):
    t = unigram() if not hasattr(test_counts_of_odd_texts, "t") else test_counts_of_odd_texts.t
    test_counts_of_odd_texts.t = t
    assert [n for n, _, _ in token_counts.counter(PIECE)(texts)] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_long_texts_on_both_sides_of_the_limit():
    """byte_bpe changes its engine at LONG_TEXT characters; ids must not."""
    lib = library(BYTE)
    word = "Ab é 12, x\n" * (tokenizers_.LONG_TEXT // 11 + 2)
    for n in (tokenizers_.LONG_TEXT - 1, tokenizers_.LONG_TEXT, tokenizers_.LONG_TEXT + 7):
        assert tokenizers_.byte_bpe(BYTE)(word[:n]).tolist() == lib.encode(word[:n], add_special_tokens=False).ids


# ----------------------------------------------------------------- second scans


def test_other_rows_on_a_second_scan_raise(spark):
    docs = helpers.docs(spark)
    dropped = exact_dedup.exact_dedup(docs).where("not kept").select("row_key", "mark")
    other = helpers.docs(spark, [(i, (t or "") + "!", *rest) for i, t, *rest in helpers.ROWS])
    assert common.drop_rows(docs, dropped).count() == docs.count() - dropped.count()
    with pytest.raises(Exception, match="other partitions"):
        common.drop_rows(other, dropped).count()


def test_only_named_files_are_read(spark):
    """What a lost attempt has left is no part of the table."""
    from docloom.llm.common import open_fs

    t = common.saved(spark.range(10), "t")
    fs, base = open_fs(t.inputFiles()[0].rpartition("/")[0])
    with fs.open_output_stream(f"{base}/.half") as f:
        f.write(b"PAR1")
    again = spark.read.parquet(f"file://{base}")
    assert sorted(r.id for r in again.collect()) == list(range(10))


# --------------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_patterns_use_each_piece_once(lengths):
    histogram = Counter(lengths)
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for pattern, n in patterns:
        assert 0 < sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            used[k] += v * n
    assert used == histogram
    ranks = Counter()
    for length, lo, hi, _, _ in packing.places(patterns):
        assert lo == ranks[length]
        ranks[length] = hi
    assert ranks == histogram


def test_op1(spark):
    got = packing.op1_packing(spark, SF).collect()
    lib, by_doc, by_seq = library(BYTE), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in corpus(spark):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    fills = []
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) <= 2048 and sum(fills) / (2048 * len(fills)) > 0.97


def test_sequences(spark):
    packed = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), size=2048, with_ids=True)
    rows = packing.sequences(packed, 2048).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in rows)
    assert sum(sum(s > 0 for s in r.segments) for r in rows) == packed.agg(F.sum("length")).first()[0]


# ------------------------------------------------------------------ exact dedup


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=60))
def test_rice_codes(values):
    v = np.array(sorted(values), np.uint64)
    assert exact_dedup.rice_decode(exact_dedup.rice_encode(v), len(v)).tolist() == v.tolist()


def test_exact_dedup_of_hard_rows(spark):
    docs = helpers.docs(spark)
    got = exact_dedup.exact_dedup(docs, owners=3).collect()
    assert len(got) == len(helpers.ROWS)
    norm = lambda t: (t or "").encode().lower()
    for text in {norm(t) for _, t, *_ in helpers.ROWS}:
        ids = [i for i, t, *_ in helpers.ROWS if norm(t) == text]
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text).hexdigest()]
        assert len(mine) == len(ids) and sum(r.kept for r in mine) == 1
        assert {(r.keep_id, r.group_size) for r in mine} == {(max((i for i in ids if i is not None), default=None), len(ids))}
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for _, t, *_ in helpers.ROWS})


# -------------------------------------------------------------------- near dedup


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_alignment(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    m = plain_lcs(a, b)
    assert near_dedup.common_length(x, y, max(len(a), len(b), 1)) == m
    want = m / (len(a) + len(b) - m) if a and b else float(len(a) == len(b))
    got = near_dedup.similarity(x, y)
    assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got - want) < 1e-12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 30), st.integers(0, 64))
def test_places(a, size, mask_bytes):
    old = near_dedup.MASK_BYTES, near_dedup.SINGLY
    near_dedup.MASK_BYTES, near_dedup.SINGLY = mask_bytes, 4
    try:
        places = near_dedup.Places(np.array(a, np.uint64), size)
    finally:
        near_dedup.MASK_BYTES, near_dedup.SINGLY = old
    for low in range(-size - 1, len(a) + 2):
        for x in range(5):
            assert places.window(x, low) == sum(1 << i for i in range(size) if 0 <= low + i < len(a) and a[low + i] == x)


@pytest.mark.parametrize("kinds", [1, 5, 2000])
def test_alignment_of_long_repeats(kinds):
    rng = np.random.default_rng(0)
    a = rng.integers(0, kinds, 100_000).astype(np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 3000)] = 2**40
    begin = time.time()
    assert near_dedup.similarity(a, b) > 0.9
    assert time.time() - begin < 10  # two seconds on an idle core


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_classes_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(1)
    words = rows[1][1].split()[:150]
    for k in range(60):  # a large group of near copies
        w = list(words)
        for i in rng.integers(0, len(w), 2):
            w[i] = f"edit{k}x{i}"
        rows.append((10_000 + k, " ".join(w)))
    docs = helpers.docs(spark, [(i, t, "en", "s", i) for i, t in rows])
    got = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
    seq = {i: near_dedup.shingles(t) for i, t in rows}
    sets = {i: set(s.tolist()) for i, s in seq.items()}
    parent = {i: i for i in seq}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(seq)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(seq[a]), len(seq[b])) < 0.8 * max(len(seq[a]), len(seq[b])) or len(sets[a] & sets[b]) < 0.5 * len(sets[a]):
                continue
            if near_dedup.similarity(seq[a], seq[b]) >= 0.8 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in ids} == {i: r.class_id for i, r in got.items()}
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    sizes = Counter(root(i) for i in ids)
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


@pytest.mark.parametrize("few_blocks", [0, near_dedup.FEW_BLOCKS])
def test_near_classes_of_thousands_of_copies(spark, monkeypatch, few_blocks):
    """Copies of one text, each with two edits of its own out of many: two are
    similar only if they share an edit (or nearly), so classes are many and small
    in buckets of hundreds."""
    monkeypatch.setattr(near_dedup, "FEW_BLOCKS", few_blocks)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(2000):
        w = list(base)
        for i in rng.choice(100, 2, replace=False):
            w[i] = f"edit{i}x{rng.integers(60)}"
        rows.append((k, " ".join(w)))
    seq = [near_dedup.shingles(t) for _, t in rows]
    codes = np.unique(np.concatenate(seq), return_inverse=True)[1].reshape(-1)
    held = np.zeros((len(rows), codes.max() + 1), np.float32)
    held[np.repeat(np.arange(len(rows)), [len(s) for s in seq]), codes] = 1
    common_ = held @ held.T
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = held.sum(axis=1)
    for a, b in zip(*np.nonzero(np.triu(common_ / (size[:, None] + size - common_) >= 0.79, 1)), strict=True):
        if root(a) != root(b) and near_dedup.similarity(seq[a], seq[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {i: root(i) for i in range(len(rows))}
    assert len(set(want.values())) > 50
    got = near_dedup.classes(helpers.docs(spark, [(i, t, "en", "s", i) for i, t in rows])).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_meetings_lose_no_similar_pair(spark):
    """Unlike texts with a common middle, some of them with a near copy: the copies meet,
    and what does not reach the threshold hardly meets at all."""
    rng = np.random.default_rng(11)
    middle, rows = [f"m{i}" for i in range(60)], []
    for k in range(400):
        w = [f"a{k}x{i}" for i in range(25)] + middle + [f"b{rng.integers(40)}y{i}" for i in range(25)]
        rows.append(w)
        if k % 4 == 0:
            w = list(w)
            w[int(rng.integers(len(w)))] = "edit"
            rows.append(w[int(rng.integers(3)) :] + ["m1 m2 m3 m4 m5 m6"] * (k % 3))
    seq = [near_dedup.shingles(" ".join(w)) for w in rows]
    mixed = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(seq)], "head long, size long, label long")
    seqs = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(seq)], "row_key long, seq binary")
    met: dict[int, set[int]] = {}
    for r in near_dedup.meetings(mixed, seqs, 0.8).collect():
        met.setdefault(r.bucket, set()).add(r["head"])
    pairs = {(a, b) for g in met.values() for a in g for b in g if a < b}
    similar = {(a, b) for a in range(len(seq)) for b in range(a + 1, len(seq)) if near_dedup.similarity(seq[a], seq[b]) >= 0.8}
    assert len(similar) > 80 and similar <= pairs
    assert len(pairs) < len(seq) ** 2 / 20
    links = {(r.a, r.b) for r in near_dedup.blocks(near_dedup.meetings(mixed, seqs, 0.8), seqs, 0.8).collect()}

    def parts(pairs):
        of = list(range(len(seq)))
        for a, b in sorted(pairs):
            of = [of[a] if x == of[b] else x for x in of]
        return [min(i for i, y in enumerate(of) if y == x) for x in of]

    assert links <= similar and parts(links) == parts(similar)
    assert near_dedup.meetings(mixed.limit(0), seqs, 0.8).isEmpty()


def _made_by_joins(spark, before: int) -> int:
    """Rows that the joins of all executions after the first ``before`` have made."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    every = store.executionsList()
    for i in range(before, every.size()):
        k = every.apply(i).executionId()
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    total += int(v.get().replace(",", ""))
    return total


def test_meetings_join_kept_shingles_only(spark):
    """Heads that share most shingles: those that rarity leaves out pass through no join."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    seq = []
    for _ in range(60):
        s = base.copy()
        s[rng.integers(0, 1000, 150)] = rng.integers(0, 2**63, 150, dtype=np.uint64)
        seq.append(s)
    mixed = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(seq)], "head long, size long, label long")
    seqs = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(seq)], "row_key long, seq binary")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert near_dedup.meetings(mixed, seqs, 0.8).count()
    assert _made_by_joins(spark, before) < 0.25 * sum(map(len, seq))


def test_near_dedup_of_hard_rows(spark):
    docs = helpers.docs(spark)
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(helpers.ROWS)
    one = {(r.doc_id, r.class_id, r.class_size) for r in got}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (None, None, 1), (5, 5, 1), (7, 7, 1), (6, 6, 2), (6, 6, 1)} == one
    kept = near_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) == 7


# ------------------------------------------------------------------ binary files


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.int64)
    h = binary_output.PerfectHash.build(k)
    assert sorted(h.lookup(k).tolist()) == list(range(len(k)))


def test_token_files(spark):
    docs = helpers.docs(spark)
    folder = common.scratch_path(spark, "ids")
    binary_output.write_ids(docs, folder, shards=3)
    got = binary_output.read_digests(spark, folder).collect()
    assert len(got) == len(helpers.ROWS)
    lib, at = library(WORD), 0
    texts = {}
    for i, t, *_ in helpers.ROWS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(texts.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    found = binary_output.lookup(spark, folder, spark.createDataFrame([(6,), (3,), (12345,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in found) == [3, 6, 6, 6] and next(r.ids for r in found if r.doc_id == 3) == [1]


def test_op5_order(spark):
    got = sorted(binary_output.op5_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    starts = np.cumsum([0, *[r.n_tokens for r in got]])
    assert [r.start for r in got] == starts[:-1].tolist()


# ------------------------------------------------------------------------- bpe


def test_op7(spark):
    lib = library(WORD)
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, SF).collect()}
    for i, t in corpus(spark):
        ids = lib.encode(t, add_special_tokens=False).ids
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --------------------------------------------------------------------- quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    s = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(s) > 50 and np.mean([r.predicted == r.quality for r in s]) > 0.9
    assert all(0 <= r.score <= 1 for r in s)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in s)


def test_forest_learns_and_handles_odd_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x, y)
    assert ((f.score(x) > 0.5) == y).mean() > 0.98
    for labels in (np.zeros(0), np.ones(5), np.zeros(5)):
        p = quality.fit(np.zeros((len(labels), 5)), labels).score(np.zeros((3, 5)))
        assert np.allclose(p, (labels.sum() + 1) / (len(labels) + 2))


def walk(forest, x):
    """The score of one row, by walking each tree from its root."""
    total = forest.base
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + np.exp(-total))


def test_op8_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    for i, t in corpus(spark):
        want = walk(forest, np.array(quality.statistics(t)))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_first_split_equals_exact_search():
    """On few distinct values bins lose nothing: the first tree's first split is the best of all."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=400) > 11).astype(float)
    f = quality.fit(x, y, trees=1, leaves=2)
    base = 1 / (1 + np.exp(-f.base))
    g, h = base - y, np.full(400, base * (1 - base))

    def gain(k, cut):
        left = x[:, k] <= cut
        if min(left.sum(), (~left).sum()) < 8:
            return -1.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left)

    best = max(gain(k, c) for k in range(4) for c in range(20))
    assert abs(gain(f.feature[0], f.threshold[0]) - best) < 1e-9


def test_quality_of_a_long_word():
    begin = time.time()
    assert all(np.isfinite(quality.statistics("x" * 2_000_000))) and all(np.isfinite(quality.statistics("é\x00" * 500_000)))
    assert time.time() - begin < 20


def test_quality_of_hard_rows(spark):
    docs = helpers.docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(helpers.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, quality.train(docs, labels), 0.0).count() == len(helpers.ROWS)


# -------------------------------------------------------------------- licenses


def plain_base(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


PHRASES = st.lists(st.sampled_from(["gnu", "general", "public", "license", "Apache", "MIT", "License", "cc", "CC-BY", "by", "é", "x1", "\n", ", ", " ", "  ", "."]), max_size=40).map("".join)


def test_base_phrases(spark):
    texts = ["GNU General\nPublic  License; gnu-general.public license", "xmit license mit license2 Mit, License", "cc by-sa CC_BY ccby"] + [t for _, t in corpus(spark)]
    docs = helpers.docs(spark, [(i, t, "en", "s", i) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@settings(max_examples=200, deadline=None)
@given(PHRASES)
def test_base_phrases_anywhere(text):
    low = text.encode().lower()
    starts = license_scan._WORD[np.frombuffer(low, np.uint8)]
    begins = starts.copy()
    begins[1:] &= ~starts[:-1]
    places = license_scan.base_places(low, license_scan.BASE)
    numbers = sorted(int(np.count_nonzero(begins[:at])) for at, _ in places)
    n, hits, first, last, _ = plain_base(text)
    assert (int(begins.sum()), len(numbers), numbers[0] if numbers else None, numbers[-1] if numbers else None) == (n, hits, first, last)


@pytest.mark.parametrize("text, label", [("MIT No\nAttribution", "mit-0"), *[(f"the GNU{c}General{c}Public{c}License v3", "gpl-3.0") for c in "\r\f\xa0\n "]])
def test_white_space_of_all_kinds(spark, text, label):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert label in license_scan.scan(docs).first().labels.split(",")


def test_rules():
    s = license_scan.scanner()
    assert len(s.rules) > 200
    labels = lambda t: [x[2] for x in s(t.lower())]
    assert labels("This work is licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("released under the GNU General Public License v3 or later") == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: CC BY-SA 4.0") == ["cc-by-sa-4.0"]
    assert labels("the MIT license and the BSD license") == ["mit", "bsd"]
    assert labels("All rights reserved.") == ["proprietary"] and labels("nothing here") == []
    assert labels("licensed under cc+by 4.0") == [] and labels("accept by 4.0") == []
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
    assert labels(text) == ["mit"]


def sample(pattern, rng):
    """A text that a regular expression matches."""
    from re import _parser as parser

    def one(tree):
        out = ""
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "NOT_LITERAL":
                out += "x"
            elif op == "IN":
                choices = []
                for kind, x in arg:
                    choices += {"LITERAL": lambda x=x: [chr(x)], "RANGE": lambda x=x: [chr(x[0]), chr(x[1])], "CATEGORY": lambda x=x: [" ", "\n"] if "SPACE" in str(x) else ["7"], "NEGATE": lambda: ["y"]}[str(kind)]()
                out += "y" if str(arg[0][0]) == "NEGATE" else choices[rng.integers(len(choices))]
            elif op == "BRANCH":
                out += one(arg[1][rng.integers(len(arg[1]))])
            elif op == "SUBPATTERN":
                out += one(arg[3])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = arg
                out += "".join(one(sub) for _ in range(rng.integers(low, min(int(high), low + 2) + 1)))
            elif op == "CATEGORY":
                out += " "
            else:
                assert op in ("ASSERT", "ASSERT_NOT", "AT"), op
        return out

    return one(parser.parse(pattern))


def test_prefilter_loses_nothing():
    """Texts made from every rule: all matches hold the rule's keyword, and the
    gated scan gives what all rules give."""
    s, rng = license_scan.scanner(), np.random.default_rng(4)
    gate = license_scan._gate(tuple(license_scan.BASE))
    texts = []
    for r in s.rules:
        made = [sample(r.match.pattern, rng) for _ in range(8)]
        hits = [(m[0], t) for t in made if (m := r.match.search(f" {t} "))]
        assert hits, r
        for hit, t in hits:
            assert r.keyword in " ".join(hit.split()), (r, hit)
            texts.append(t)
    for k, t in enumerate(texts):
        t = f"words before {t} and after {texts[k * 7 % len(texts)]}."
        assert gate(t.encode()) and s(t) == s(t, every=True)


SPANS = st.lists(st.tuples(st.integers(-3, 0), st.integers(0, 12), st.integers(1, 6)), max_size=30)


@settings(max_examples=200, deadline=None)
@given(SPANS)
def test_suppression(spans):
    found = sorted((p, -n, a, a + n, k) for k, (p, a, n) in enumerate(spans))
    kept = []
    for _, _, a, z, k in found:
        if not any(x <= a and z <= y for x, y, _ in kept):
            kept.append((a, z, k))
    assert license_scan.outer(found) == kept


def test_scan_equals_plain_code(spark):
    """Labels and score of the query, by all rules without any prefilter."""
    s = license_scan.scanner()
    got = {r.doc_id: r for r in license_scan.op4_license_scan(spark, SF).collect()}
    for i, t in corpus(spark):
        n_words, n_base, first, last, basic = plain_base(t)
        spans = s(t.encode().lower().decode(), every=True)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n_base, first, last, basic)
        assert r.labels == ",".join(sorted({*filter(None, basic.split(",")), *(x[2] for x in spans)}))
        assert r.score == max([0.6 * (n_base > 0), *(x[3] for x in spans)])


def test_many_mentions_take_linear_time():
    begin = time.time()
    assert len(license_scan.scanner()("the mit license. " * 30_000)) == 30_000
    assert time.time() - begin < 10


# ------------------------------------------------------------------------ urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def plain_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q", "https://a.example.com/en/", "https://b.www.example.com/en/1#f", "http://x.net/es/", "http://net/fr/a", "ftp://x.org?u=http://y.com/", "http://évil.NET/es/é", "http://com", "http://a.com#x/", "http://spam-farm.org/a", "x://y://z.com/"]


class Plain:
    """A stand-in for the forest: texts of many words are good."""

    def score(self, x):
        return (x[:, 1] > np.log1p(3)).astype(float)


def plain_reputations(counts, z=1.96):
    """host -> (mean, lower bound), from {host: (n, bad)}, in plain Python."""
    up = lambda of, key: {k: (sum(n for h, (n, _) in of.items() if key(h) == k), sum(b for h, (_, b) in of.items() if key(h) == k)) for k in {key(h) for h in of}}
    domain = lambda h: ".".join(h.split(".")[-(3 if ".".join(h.split(".")[-2:]) in url_filter.LONG_SUFFIXES else 2) :])
    suffix = lambda d: ".".join(d.split(".")[-2:]) if ".".join(d.split(".")[-2:]) in url_filter.LONG_SUFFIXES else d.split(".")[-1]

    def strength(groups, mean):
        size = sum(n for n, _ in groups.values())
        noise = sum(mean(k) * (1 - mean(k)) for k in groups)
        spread = sum(n * (b / n - mean(k)) ** 2 for k, (n, b) in groups.items())
        within = sum(n * mean(k) * (1 - mean(k)) for k, (n, _) in groups.items())
        return min(1000.0, max(1.0, within / size / max((spread - noise) / size, 1e-9) - 1))

    domains = up(counts, domain)
    suffixes = up(domains, suffix)
    every = (sum(b for _, b in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)
    k0 = strength(suffixes, lambda _: every)
    ms = {k: (b + k0 * every) / (n + k0) for k, (n, b) in suffixes.items()}
    k1 = strength(domains, lambda d: ms[suffix(d)])
    md = {d: (b + k1 * ms[suffix(d)]) / (n + k1) for d, (n, b) in domains.items()}
    k2 = strength(counts, lambda h: md[domain(h)])
    out = {}
    for h, (n, bad) in counts.items():
        a, b = bad + k2 * md[domain(h)], n - bad + k2 * (1 - md[domain(h)])
        out[h] = a / (a + b), max(0.0, a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out


def plain_verdicts(pages, bad):
    """Of (page_id, url) rows, with bad[k] the outcome of the k-th."""
    places, counts = [plain_url(u) for _, u in pages], {}
    for (host, _), b in zip(places, bad, strict=True):
        if host and b is not None:
            n, m = counts.get(host, (0, 0))
            counts[host] = n + 1, m + b
    bound = {h: x[1] for h, x in plain_reputations(counts).items()} if counts else {}
    out = []
    for (i, _), (host, path) in zip(pages, places, strict=True):
        verdict, rule = plain_rule(host, path)
        out.append((i, host, path, rule, verdict or ("block" if bound.get(host, 0) > 0.5 else "allow")))
    return Counter(out)


def rows_of(df):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


def test_urls(spark):
    rows = [(i, u, "<p>a text of some words</p>" if i % 2 else None) for i, u in enumerate(URLS)]
    rows += [(3, "http://spam-farm.org/b", "%%%%###"), (None, "http://y.org/", "<p>x"), (50, "http://y.org/", "<p>word</p>" * 50_000)]
    rows += [(100 + k, f"http://h{k % 4}.co.uk/{k}", "few words" if k % 4 < 2 else "a text of rather many words") for k in range(80)]
    clash = {c: F.lit("clash") for c in ("host", "n", "bad", "path", "fit", "domain", "suffix", "by_host", "rule", "verdict")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash)
    got = rows_of(url_filter.judge(url_filter.outcomes(pages, Plain())))
    bad = [int(len(url_filter.main_text(h).split()) <= 3) if h else None for _, _, h in rows]
    assert got == plain_verdicts([(i, u) for i, u, _ in rows], bad)
    assert {v for *_, rule, v in got if rule is None} == {"allow", "block"}
    empty = pages.limit(0)
    assert url_filter.judge(url_filter.outcomes(empty, Plain())).count() == 0
    nothing = url_filter.judge(url_filter.outcomes(pages.where("html is null"), Plain()))
    assert nothing.where("rule is null and verdict = 'block'").count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<br>b &amp; <b>c</b>d</p>", "a\nb & cd"), ("<nav>menu</nav><article><h1>t</h1><script>x</script>y</article>tail", "t\ny"),
        ("<article> </article>rest", "rest"), ("a<!-- b", "a"), ("<script>a", ""), ("<style>p</STYLE >z", "z"), ("a < b", "a < b"), ("</nav>x<nav>y", "x"), ("<a<a<a<p>k", "<a<a<a\nk"),
    ],
)
def test_main_text(html, text):
    assert url_filter.main_text(html) == text


@pytest.mark.parametrize("part", ["<script>", "<!--", "<a", "<nav>", "<", "</article>", "<style><p>"])
def test_main_text_of_long_pages(part):
    begin = time.time()
    url_filter.main_text(part * 300_000)
    assert time.time() - begin < 10


def test_main_text_of_long_names():
    begin = time.time()
    assert url_filter.main_text("<" + "a" * 1_000_000) == "<" + "a" * 1_000_000
    assert time.time() - begin < 1


def test_op10(spark):
    """The whole query by brute force: scores of main texts, then rules and reputations in plain Python."""
    forest = quality.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    texts = [url_filter.main_text(p.html) for p in pages]
    low = [walk(forest, np.array(quality.statistics(t))) < 0.5 for t in texts]
    bad = [int(x) if t else None for x, t in zip(low, texts, strict=True)]
    assert rows_of(url_filter.op10_url_filter(spark, SF)) == plain_verdicts([(p.page_id, p.url) for p in pages], bad)


def test_reputations_shrink(spark):
    hosts = spark.createDataFrame([("bad.a.com", 200, 198), ("good.a.com", 500, 5), ("new.a.com", 1, 1), ("x.b.org", 300, 3)], "host string, n long, bad long")
    r = {x.host: x for x in url_filter.reputations(hosts).collect()}
    want = plain_reputations({"bad.a.com": (200, 198), "good.a.com": (500, 5), "new.a.com": (1, 1), "x.b.org": (300, 3)})
    assert all(np.allclose((r[h].bad_mean, r[h].bad_bound), w) for h, w in want.items())
    assert r["bad.a.com"].bad_bound > 0.9 and r["good.a.com"].bad_mean < 0.05
    assert r["new.a.com"].bad_mean < 1 and r["new.a.com"].bad_bound < 0.5
    assert r["bad.a.com"].domain == "a.com" and r["x.b.org"].suffix == "org"


# --------------------------------------------------------------------- vectors


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in ann.op3_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = sum(len({r.vec_id for r in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11)) and [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)


def test_recall_with_many_lists(spark):
    """Vectors spread evenly over the sphere, in far more lists than a query's least number of probes."""
    x = np.random.default_rng(11).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(df, list_size=16)
    assert len(index.graph.c) > 20 * 48
    got: dict[int, set] = {}
    for r in ann.search(index, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 200 and hits / 2000 >= 0.93


def test_lists_are_balanced():
    """Nine in ten vectors lie in one small part of space."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1000, 16)), 0.01 * rng.normal(size=(9000, 16)) + 3])
    c = ann.centres(x, 64)
    n = np.bincount(ann._nearest(x, c), minlength=len(c))
    assert 48 <= len(c) <= 96 and n.max() <= 2.5 * len(x) / len(c)


def test_recall_on_skewed_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(2000, 32)), 0.05 * rng.normal(size=(6000, 32)) + 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df, list_size=32)
    sizes = [r["count"] for r in index.postings.groupBy("list").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 12 * sum(sizes) / len(sizes)
    got, want = {}, brute(rows)
    for r in ann.search(index, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(300 + i, rng.normal(size=7).tolist()) for i in range(40)] + [(500, [1e200, 1.0, 0.0, 0.0])]
    rows += [(100, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.4])]  # ids again, with other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(ann.build(df, list_size=400), df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 100, 300):
        best = {}
        for mine in [np.array(v) for i, v in rows if i == q]:
            for i, v in rows:
                if i != q and len(v) == len(mine):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((mine - np.array(v)) ** 2).sum())))
        want = sorted((d, i) for i, d in best.items())[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([d for _, d in got[q]], [d for d, _ in want], rtol=1e-12)


def test_vectors_of_all_kinds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)]
    rows += [(2000, None), (2100, [0.0] * 4), (2200, [1.0, None, 0.0, 0.0]), (2300, [float("nan"), 0.0, 0.0, 1.0]), (2400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    df = df.withColumns({c: F.lit("clash") for c in ("list", "vec", "ids", "query", "query_id", "q", "rank", "score", "block", "id", "v")})
    index = ann.build(df, list_size=20)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 8)  # many blocks, of queries as well
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    got = {}
    for r in ann.search(index, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    assert got[1000] == want[1000] == [(1001 + i, 0.0) for i in range(10)]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(ann.build(few), few).collect()] in ([(0, 1), (1, 0)], [(1, 0), (0, 1)])
    assert ann.build(few.limit(0)) is None


# ----------------------------------------------------------- hard rows, empties


def test_hard_rows_keep_their_number(spark):
    docs = helpers.docs(spark)
    for df in (license_scan.scan(docs), token_counts.count_tokens(docs), bpe.encode_decode(docs), bpe.encode_decode(docs, digests=True)):
        assert df.count() == len(helpers.ROWS)
    word = library(WORD)
    want = Counter((i, len(ids := word.encode(t or "", add_special_tokens=False).ids), word.decode(ids, skip_special_tokens=False)) for i, t, *_ in helpers.ROWS)
    assert Counter((r.doc_id, len(r.ids), r.decoded) for r in bpe.encode_decode(docs).collect()) == want
    pieces = unigram()
    want = Counter((i, len(pieces.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in helpers.ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs).collect()) == want
    want = Counter((i, *plain_base(t or "")) for i, t, *_ in helpers.ROWS)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()) == want
    packed = packing.pack_documents(docs)
    n = packed.where("start = 0").count()
    assert n == len(helpers.ROWS)


@pytest.mark.parametrize("f", ["exact", "near", "pack", "files", "license", "count", "bpe", "quality"])
def test_empty_tables(spark, f):
    docs = helpers.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    if f == "files":
        folder = common.scratch_path(spark, "none")
        binary_output.write_ids(docs, folder, shards=2)
        out = binary_output.read_digests(spark, folder)
    else:
        out = {
            "exact": lambda: exact_dedup.exact_dedup(docs), "near": lambda: near_dedup.classes(docs), "pack": lambda: packing.pack_documents(docs), "license": lambda: license_scan.scan(docs),
            "count": lambda: token_counts.count_tokens(docs), "bpe": lambda: bpe.encode_decode(docs), "quality": lambda: quality.score(docs, quality.train(docs, labels)),
        }[f]()
    assert out.count() == 0
