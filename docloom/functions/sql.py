"""The text functions under names that SQL can call.

Those of the JVM become temporary SQL functions, which Catalyst inlines; splitters
are registered as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions import splitters
from docloom.functions.text import SPACES


def _quoted(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


_SPACES = _quoted(SPACES)
_COLLAPSED = f"btrim(regexp_replace(translate({{0}}, {_SPACES}, '{' ' * len(SPACES)}'), ' {{{{2,}}}}', ' '), ' ')"

#: name -> (arguments, result, body)
FUNCTIONS = {
    "docloom_strip": ("t STRING", "STRING", f"btrim(t, {_SPACES})"),
    "docloom_collapse": ("t STRING", "STRING", _COLLAPSED.format("t")),
    "docloom_normalize": ("t STRING", "STRING", _COLLAPSED.format("lower(t)")),
    "docloom_text_sha1": ("t STRING", "STRING", "sha1(t)"),
    "docloom_sanitize": ("t STRING", "STRING", r"regexp_replace(regexp_replace(coalesce(t, ''), r'<\|im_(start|end)\|>', '<im>'), r'\[(SOURCE_[0-9]+)\]', '($1)')"),
    "docloom_is_refusal": ("t STRING", "BOOLEAN", "contains(lower(coalesce(t, '')), 'không tìm thấy đủ thông tin') OR contains(lower(coalesce(t, '')), 'không có thông tin')"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with the session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("array<string>")
    def split_text(texts: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([splitters.split_text_py(t, int(n)) for t, n in zip(texts, limit, strict=True)])

    @F.pandas_udf("array<string>")
    def split_segments(texts: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([splitters.split_segments_py(t, int(n)) for t, n in zip(texts, limit, strict=True)])

    spark.udf.register("docloom_split_text", split_text)
    spark.udf.register("docloom_split_segments", split_segments)
    return [*FUNCTIONS, "docloom_split_text", "docloom_split_segments"]
