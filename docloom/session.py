"""SparkSession builder with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE on and UTC times. ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
