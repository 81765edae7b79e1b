"""Models on executors: rows of a table go through a function of Python, in batches.

A model is a plain function, or a PerWorker that is loaded once for each Python worker.
Its outputs are written before anything reads them, so that no model is asked twice
for a row because two later steps read the same plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import scratch

_loaded: dict[str, Any] = {}


class PerWorker:
    """A model that is loaded where it is first called, and kept until its Python
    worker ends. Only ``load`` travels to executors, never what it returns."""

    def __init__(self, load: Callable[[], Callable]):
        self.load, self.name = load, uuid.uuid4().hex

    def __call__(self, *args):
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name](*args)


def outputs(df: DataFrame, key: str, inputs: list[str], model: Callable, tries: int = 2, tasks: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """A written table of key, output and error of each row of df: ``model`` of its
    string inputs (nulls as empty texts). A row whose model fails ``tries`` times has a
    null output and the last error, and the others go on. Rows are dealt by key into
    ``tasks`` tasks (by default as many as a shuffle has), since a few rows can keep a model
    busy for long; ``profile`` asks for executors with what the model needs, such as GPUs."""
    kind = df.schema[key].dataType.simpleString()
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"in{i}") for i, c in enumerate(inputs)]

    def one(args: tuple) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                return model(*args), None
            except Exception as e:  # whatever a model raises belongs to its row
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches):
        for b in batches:
            got = [one(a) for a in zip(*(b[f"in{i}"] for i in range(len(inputs))), strict=True)]
            yield b[["key"]].assign(output=[o for o, _ in got], error=[e for _, e in got])

    dealt = df.select(F.col(key).alias("key"), *texts).repartition(tasks, "key")
    return scratch.saved(dealt.mapInPandas(run, f"key {kind}, output string, error string", profile=profile), "outputs").withColumnRenamed("key", key)
