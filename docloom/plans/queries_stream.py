"""Queries of streaming operators; a stream over available files runs to its end and is read back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from docloom import scratch
from docloom.plans.queries_text import read
from docloom.plans.registry import query
from docloom.streaming import correction


@contextmanager
def _rocksdb(spark):
    """The state store that transformWithState needs, for the streams that start inside."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query(
    "upload_claims",
    """WITH e AS (SELECT event_id, 'user ' || user_id AS name, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'done' ELSE 'claim' END AS kind FROM events),
f AS (SELECT *, count(*) FILTER (kind = 'failed') OVER (PARTITION BY name ORDER BY event_id) AS epoch FROM e)
SELECT name, event_id, row_number() OVER (PARTITION BY name, epoch ORDER BY event_id) = 1 AS accepted FROM f WHERE kind = 'claim'""",
)
def upload_claims(spark, sf_dir):
    """All events as uploads of one file a user: an error releases the claim before it. A
    stream over several micro-batches."""
    base = scratch.path(spark, "claims")
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "done").otherwise("claim")
    rows = e.select(F.concat(F.lit("user "), "user_id").alias("name"), F.lit("hash").alias("sha256"), "event_id", kind.alias("kind"))
    # Each part is written by all tasks and is a micro-batch of a run that goes on where the last one ended.
    cut = [r[0] for r in [rows.agg(F.expr("percentile_approx(event_id, array(0.4, 0.7))")).first()]][0] or [0, 0]
    for part in (F.col("event_id") <= cut[0], (F.col("event_id") > cut[0]) & (F.col("event_id") <= cut[1]), F.col("event_id") > cut[1]):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        out = correction.upload_claims(spark.readStream.schema(correction.CLAIMS).parquet(f"{base}/in"))
        with _rocksdb(spark):
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").drop("sha256")


@query("stream_ordered_correction")
def stream_ordered_correction(spark, sf_dir):
    """All turns of conversations, fed out of order over several micro-batches; the
    corrector (upper case) sees the corrected turn before. SQL can't express
    segments, tails and the upper case of sharp s, so there is no oracle; a test
    compares with plain Python."""
    from pyspark.sql import Window

    base = scratch.path(spark, "stream")
    c = read(spark, sf_dir, "conversations").withColumn("index", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"))
    rows = c.select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("generation"), "index", F.lit("text").alias("label"), F.col("text").alias("raw_text"))
    rows.repartitionByRange(3, F.desc("index")).write.parquet(f"{base}/in")  # later turns come first
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = correction.correct(stream, lambda text, previous: text.upper())
    with _rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    return done.select("document_id", "index", "content", F.upper("previous").alias("previous_upper"))
