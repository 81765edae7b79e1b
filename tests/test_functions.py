"""Functions against plain Python, on generated texts."""

import re
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import splitters
from docloom.functions import text as T
from docloom.functions.names import name_candidates
from docloom.operators import regions
from docloom.sources import web

ALPHABET = st.text(st.sampled_from("abc ABCđĐếặ012,.;:!?%()-/\n\tÉß½_ ¦|"), max_size=60)
TEXTS = st.lists(ALPHABET, min_size=1, max_size=20)


def column(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_tokenize(spark, texts):
    def plain(t):
        out = []
        for tok in re.findall(r"[\wÀ-ỹ]+(?:[-/.][\wÀ-ỹ]+)*", t.lower()):
            out.append(tok)
            if re.search(r"[-/.]", tok):
                out += [re.sub(r"[-/.]", "", tok), *[p for p in re.split(r"[-/.]", tok) if p]]
        return out

    assert column(spark, texts, T.tokenize("t")) == [plain(t) for t in texts]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_folding(spark, texts):
    def plain(t):
        t = unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in t if unicodedata.category(c) != "Mn")

    assert column(spark, texts, T.strip_diacritics("t")) == [plain(t) for t in texts]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_clean_and_match(spark, texts):
    def clean(t):
        t = re.sub(r"[ \t]+", " ", t.replace("\xa0", " "))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", t)).strip()

    assert column(spark, texts, T.clean_text("t")) == [clean(t) for t in texts]
    assert column(spark, texts, T.normalize_for_match("t")) == [re.sub(r"\s+", " ", t.lower()).strip() for t in texts]


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(4, 30))
def test_segments_join_to_the_text(text, limit):
    parts = splitters.split_segments_py(text, limit)
    assert "".join(parts) == text and all(len(p) <= limit for p in parts)


def test_split_text_keeps_bullets_whole():
    text = "\n".join(f"- mục {i} " + "x" * 60 for i in range(8)) + "\n\n" + " ".join(f"Câu số {i} dài vừa phải." for i in range(60))
    parts = splitters.split_text_py(text, 400)
    assert all(len(p) <= 400 for p in parts)
    assert all(f"- mục {i} " + "x" * 60 in "\n".join(parts) for i in range(8))
    assert splitters.split_text_py("  ", 10) == [] and splitters.split_text_py("a b", 10) == ["a b"]
    assert splitters.split_text_py("word " * 50, 40, 10)[1].count("\n") == 1


def test_estimate_tokens_rounds_half_to_even(spark):
    lengths = [0, 1, 9, 18, 27, 45, 63, 1000, 7201]
    assert column(spark, ["x" * n for n in lengths], T.estimate_tokens("t")) == [max(1, round(n / 3.6)) if n else 0 for n in lengths]


def test_point_ids_are_uuid5(spark):
    names = ["a", "chunk-1", "đ", ""]
    assert column(spark, names, T.point_id("t")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_masks(spark):
    got = column(spark, ["Gọi 0901 234 567 hoặc a.b@c.vn", "thẻ 4111 1111 1111 1111 xong", "CCCD 012345678901", "+84 91 234 56 78", None], T.mask_pii("t"))
    assert got == ["Gọi <PHONE> hoặc <EMAIL>", "thẻ <CARD>xong", "CCCD <ID>", "<PHONE>", None]


def test_names(spark):
    got = column(spark, ["Theo ông Nguyễn Văn An, và Trần Thị Mai.", "Ông A", "HÀ NỘI", "Công Ty ABC Việt Nam"], name_candidates("t"))
    assert got == [["Nguyễn Văn An", "Trần Thị Mai"], [], [], ["Công Ty", "Việt Nam"]]


def test_html_tables():
    html = "<table><tr><th colspan=2>Phí</th></tr><tr></tr><tr><td>Gold</td><td>499.000</td></tr></table>"
    assert web.table_rows_py(html) == [["Phí", "Phí"], ["Gold", "499.000"]]


def test_regions():
    grid = [["Báo cáo", "", ""], ["", "", ""], ["a", "b", ""], ["1", "2", ""], ["", "", ""], ["", "", "x"]]
    assert regions.regions_of(grid) == [(1, 1, 1, 1), (3, 4, 1, 2), (6, 6, 3, 3)]
    assert regions.classify_region([["Báo cáo"]]) == "text" and regions.classify_region([["Doanh thu", "12"]]) == "kpi"
    assert regions.classify_region([["a", "b"], ["x", "1"], ["y", "2"], ["z", "3"], ["w", "4"]]) == "table"
    assert regions.render_kpi([["A", "B"], ["1", "2"]]) == "KPI:\n- A: 1\n- B: 2"


def test_sentence_around(spark):
    df = spark.createDataFrame([("Một. Xem Bảng 2 nhé. Hết", 9)], "t string, at int")
    assert df.select(T.sentence_around(F.col("t"), F.col("at"))).first()[0] == "Xem Bảng 2 nhé."
