"""The pipeline's stages on their own inputs, and against brute force as a whole."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import common, quality, registry, tokenizers_
from tests.llm import helpers
from tests.llm.test_operators import plain_lcs, walk

SF = "/root/testdata/sf0.001"


def plain_quality(rows, labels):
    """Kept ids: the forest is fitted on its own, each row walks the trees one by one."""
    mean = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            mean.setdefault(i, []).append(q)
    texts = {i: t for i, t in rows if i in mean}
    ids = sorted(texts)
    x = np.array([quality.statistics(texts[i] or "") for i in ids]).reshape(len(ids), len(quality.NAMES))
    forest = quality.fit(x, np.array([np.mean(mean[i]) for i in ids], float))
    return [(i, t) for i, t in rows if walk(forest, np.array(quality.statistics(t or ""))) >= 0.7]


def plain_exact(rows):
    best = {}
    for i, t in rows:
        key = (t or "").encode().lower()
        best[key] = max(best.get(key, -1), i)
    return [(i, t) for i, t in rows if best[(t or "").encode().lower()] == i]


def plain_near(rows):
    """All pairs, by the plain table of common subsequences."""
    seq = [[tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if (w := re.findall(r"\w+", (t or "").lower())) else [] for _, t in rows]
    sets = [set(s) for s in seq]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            m, n = len(seq[a]), len(seq[b])
            if not m or not n:
                near = m == n
            elif min(m, n) < 0.8 * max(m, n) or len(sets[a] & sets[b]) < 0.4 * min(len(sets[a]), len(sets[b])):
                near = False
            else:
                codes = {x: k for k, x in enumerate(sets[a] | sets[b])}
                c = plain_lcs([codes[x] for x in seq[a]], [codes[x] for x in seq[b]])
                near = c / (m + n - c) >= 0.8
            if near:
                label[max(root(a), root(b), key=lambda i: rows[i][0])] = min(root(a), root(b), key=lambda i: rows[i][0])
    return [rows[i] for i in range(len(rows)) if root(i) == i]


def plain_pieces(rows):
    lib, out = Tokenizer.from_file(tokenizers_.path("byte_bpe_50k.json")), []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    return out


def test_run_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    wants = [plain_quality(rows, labels)]
    wants.append(plain_exact(wants[-1]))
    wants.append(plain_near(wants[-1]))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants, strict=True):
        docs = common.saved(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(plain_pieces(wants[-1]))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 0.95 * 2048 * len(fill)


@pytest.mark.parametrize("rows", [helpers.ROWS, []])
def test_hard_rows(spark, rows):
    """Each stage on the hard rows themselves, so that none is spared by the one before, and all in a row."""
    hard = chained = helpers.docs(spark, rows)
    texts = {(t or "").encode().lower() for _, t, *_ in rows}
    least = {"quality": 0, "exact_dedup": len(texts), "near_dedup": 7 if rows else 0, "packing": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, hard, SF), "stage")
        assert out.count() >= least[name] and (rows or out.count() == 0)
        chained = common.saved(stage(spark, chained, SF), "chained")
        if name != "packing":
            assert out.columns == chained.columns == hard.columns


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
