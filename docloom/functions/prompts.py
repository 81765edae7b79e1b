"""Prompts of the pluggable models. A model is asked for one JSON object, so that what
it returns can be checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER_SYSTEM = "Trả lời bằng JSON {answer, source_ids}, chỉ dựa vào ngữ cảnh."
CORRECTION_SYSTEM = 'Sửa lỗi nhận dạng chữ của ĐOẠN. Không thêm, bớt hay dịch; giữ mọi con số. Trả về JSON {"corrected_text": "..."}.'
PLAN_SYSTEM = "Viết lại câu hỏi để tìm kiếm. Trả về JSON {semantic_queries, keyword_query, source_file, sheet_name, content_type}; chỉ lọc theo điều câu hỏi nêu."
VISION_SYSTEM = "Mô tả hình bằng JSON {summary, text, values}. Chỉ ghi điều nhìn thấy."

#: Characters of a correction prompt beyond which a text is not sent.
MAX_CORRECTION_CHARS = 6000


def answer_column(sources: Column, question: Column) -> Column:
    return F.concat(F.lit("NGỮ CẢNH:\n\n"), F.array_join(sources, "\n\n---\n\n"), F.lit("\n\nCÂU HỎI:\n"), question)


def correction_py(text: str, previous: str = "", terms: str = "") -> str:
    """The previous passage and known spellings only help; the passage is what is corrected."""
    parts = [("TRƯỚC ĐÓ", previous), ("CÁCH VIẾT ĐÃ BIẾT", terms), ("ĐOẠN", text)]
    return "\n\n".join(f"{name}:\n{part}" for name, part in parts if part)


def correction(text: Column, previous: Column | None = None, terms: Column | None = None) -> Column:
    """The same as a column; null texts give null."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:\n"), c))
    parts = [part("TRƯỚC ĐÓ", previous)] if previous is not None else []
    parts += [part("CÁCH VIẾT ĐÃ BIẾT", terms)] if terms is not None else []
    return F.when(text.isNotNull(), F.concat_ws("\n\n", *parts, part("ĐOẠN", text)))
