"""Event streams: windows under a watermark, sessions, and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.windows import latest

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and type; rows later than the watermark are dropped."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", ts).withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", ts)
    out = e.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with no gap longer than ``gap`` between them."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", ts).withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", ts)
    out = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n", F.round("total", 2).alias("total"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there and return it as a table (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upserted(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The table that upsert_stream keeps under path: the newest row of each key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/v=*")
    return latest(rows, keys, [F.desc(version), F.desc("v")]).drop("v")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, compact: int = 16):
    """Keep the newest row per key under path. A batch writes its own newest rows (path/v=<batch>);
    every ``compact`` batches all that is there becomes one table again, and what the compaction
    before that has taken in is deleted, so work and space follow the batches, not their square. A
    failed batch is simply run again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        whole = number > 0 and number % compact == 0
        if whole:
            before = spark.read.option("basePath", path).parquet(*[f"{path}/v={n}" for n in range(max(0, number - compact), number)])
            rows = batch.withColumn("v", F.lit(number)).unionByName(before)
        else:
            rows = batch.withColumn("v", F.lit(number))
        latest(rows, keys, [F.desc(version), F.desc("v")]).drop("v").write.mode("overwrite").parquet(f"{path}/v={number}")
        if whole:
            at = spark._jvm.org.apache.hadoop.fs.Path
            for n in range(number - 2 * compact, number - compact):
                if n >= 0:
                    at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(f"{path}/v={n}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
