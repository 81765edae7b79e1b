"""Small block fixtures with known results."""

from docloom.schema import BLOCKS as BLOCK_SCHEMA

_FIELDS = [f.strip().split(" ", 1)[0] for f in BLOCK_SCHEMA.replace("\n", " ").split(",")]


def block(document: str, key: str, kind: str, content: str, order: int, path=(), page=None, sheet=None, area=None, rows=None, derived=None, ranges=None, image=None, numbers=None) -> tuple:
    return (document, key, kind, content, f"{document}.docx", list(path), page, sheet, area, order, rows, derived, ranges, image, numbers)


_A = ["A"]
BLOCKS = [
    block("d1", "h1", "heading", "A", 0, _A, 1),
    block("d1", "p1", "text", "Mở đầu. Xem Bảng 2 để biết chi tiết. Hết.", 1, _A, 1),
    block("d1", "c1", "caption", "Bảng 2: Phí thẻ", 2, _A, 1),
    block("d1", "t1", "table", "Loại | Phí", 3, _A, 1, rows=[["Loại", "Phí"], ["Gold", "499000"]]),
    block("d1", "t2", "table", "Visa | 1", 4, _A, 2, rows=[["Visa", "1"]]),
    block("d1", "p2", "text", "Đoạn văn sau bảng.", 5, _A, 2),
    block("d1", "i1", "image", "OCR", 6, _A, 2),
    block("d1", "v1", "image", "Mô tả hình", 7, _A, 2, derived="i1"),
    block("d2", "k1", "table", "x", 0, sheet="Doanh thu", area="A1:C5", rows=[["x", "y"], ["1", "2"]]),
    block("d2", "g1", "chart", "Chart type: bar", 1, sheet="Bieu do", ranges=["'Doanh thu'!$B$2:$B$4", "'Khac'!$A$1"]),
    block("d2", "k2", "table", "z", 2, sheet="Doanh thu", area="E1:F5", rows=[["z"], ["3"]]),
]

EDGES = [
    ("p1", "h1", "belongs_to_section"), ("c1", "h1", "belongs_to_section"), ("t1", "h1", "belongs_to_section"), ("t2", "h1", "belongs_to_section"), ("p2", "h1", "belongs_to_section"), ("i1", "h1", "belongs_to_section"), ("v1", "h1", "belongs_to_section"),
    ("t1", "c1", "captioned_by"), ("t1", "p1", "referenced_by"), ("t2", "t1", "continues"), ("v1", "i1", "derived_from"), ("g1", "k1", "visualizes"),
]

ATTRIBUTES = [("c1", None, "t1", 0, ""), ("t1", "Bảng 2: Phí thẻ", None, 1, ""), ("t2", None, None, 0, "Loại|Phí")]

#: document, ordinal, type, blocks, first and last page
CHUNKS = [
    ("d1", 0, "text", 1, 1, 1), ("d1", 1, "table", 1, 1, 1), ("d1", 2, "table", 1, 2, 2), ("d1", 3, "text", 1, 2, 2), ("d1", 4, "image", 1, 2, 2), ("d1", 5, "image", 1, 2, 2),
    ("d2", 0, "table", 1, None, None), ("d2", 1, "chart", 1, None, None), ("d2", 2, "table", 1, None, None),
]

OFFICIAL = [
    block("o", "b1", "text", "ỦY BAN NHÂN DÂN HUYỆN X\nSố: 123/QĐ-UBND\nngày 05 tháng 03 năm 2025", 0, page=1),
    block("o", "b2", "heading", "QUYẾT ĐỊNH", 1, ["QUYẾT ĐỊNH"], 1),
    block("o", "b3", "text", "Theo đề nghị của ông Nguyễn Văn An. Yêu cầu: Nguyễn Văn An thực hiện.", 2, ["QUYẾT ĐỊNH"], 1),
    block("o", "b4", "text", "CHỦ TỊCH\nTrần Thị Mai", 3, ["QUYẾT ĐỊNH"], 2),
]
