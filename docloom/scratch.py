"""Tables that cut a plan's lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share. Where spark.checkpoint.dir is
    unset a temporary one serves a local session; on a cluster that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    out = f"{root.rstrip('/')}/docloom-{what}-{uuid.uuid4().hex}"
    _made.append((spark, out))
    return out


def saved(df: DataFrame, what: str) -> DataFrame:
    """df, written by Spark and read back."""
    to = path(df.sparkSession, what)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def release() -> None:
    """Remove all scratch tables made so far (results that read them end with that)."""
    while _made:
        spark, out = _made.pop()
        if (jvm := spark.sparkContext._jvm) is not None:
            p = jvm.org.apache.hadoop.fs.Path(out)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        _made.clear()
