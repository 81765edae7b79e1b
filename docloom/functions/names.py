"""Proper-name candidates: runs of at least two title-case words."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE

#: Words that may open such a run without being part of the name.
LEADING_WORDS = [
    "ông", "bà", "anh", "chị", "đồng", "chí", "theo", "căn", "cứ", "của", "về", "tại", "do",
    "và", "các", "những", "với", "cho", "trong", "khi", "nếu", "đã", "sẽ", "được", "bị",
    "kính", "gửi", "tên", "ngày", "tháng", "năm", "số",
]


#: A name word, and what may stand between two; Java and the regex package read them alike.
_WORD = r"\p{Lu}(?=[\p{L}\p{N}_\p{M}]*\p{Ll})[\p{L}\p{N}_\p{M}]+"
_GAP = r"(?<=[\p{L}\p{N}_])[ ]+(?=[\p{L}\p{N}_])"
_RUN = rf"(?<![\p{{L}}\p{{N}}_])({_WORD}(?:{_GAP}{_WORD})*)(?![\p{{L}}\p{{N}}_])"
_LEAD = "^(?:(?:" + "|".join(LEADING_WORDS) + r")(?:[ ]+|$))+"


def name_candidates(c: Column | str) -> Column:
    """array<string> of the runs of a text, in order. A run ends at a line end, at
    punctuation, or at a word that is no name word (upper case first, some lower
    case, two characters or more); leading words are dropped from its front."""
    text = F.col(c) if isinstance(c, str) else c
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUN), F.lit(1))
    trimmed = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, "(?iu)" + _LEAD, ""), f"{SPACE}+", " "))
    return F.filter(trimmed, lambda r: F.contains(r, F.lit(" ")))


@functools.cache
def _patterns():
    import regex

    return regex.compile(_RUN), regex.compile(_LEAD, regex.IGNORECASE)


def name_candidates_py(text: str | None) -> list[str]:
    """The same of one text, for operators that keep state in Python."""
    run, lead = _patterns()
    trimmed = (" ".join(lead.sub("", m[1]).split()) for m in run.finditer(text or ""))
    return [t for t in trimmed if " " in t]
