"""Streaming.

X01 applies the window statistics to every tumbling window of an event
stream (watermarked, append mode); the same function runs on a batch
DataFrame, which is how it is checked.  X02 extracts pass features
incrementally as new pass files land, reusing the batch operator per
micro-batch.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwear.operators.signal_stats import CHANNELS, extract_pass_features
from flankwear.sources.files import SIGNAL_SCHEMA, with_pass_key


def tumbling_stats(df: DataFrame, ts: str, duration: str, keys: Sequence[str] = (), x: str = "x",
                   watermark: str | None = None) -> DataFrame:
    """RMS, peak-to-peak and count per tumbling window (and keys)."""
    if watermark:
        # event-time watermarks need TIMESTAMP (session-zone) values
        if dict(df.dtypes)[ts] == "timestamp_ntz":
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        df = df.withWatermark(ts, watermark)
    g = df.groupBy(F.window(ts, duration).alias("w"), *keys).agg(
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), (F.max(x) - F.min(x)).alias("p2p"),
        F.count(F.col(x)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rms", "p2p", "n")


def stream_window_stats(spark: SparkSession, path: str, schema, ts: str, duration: str, keys: Sequence[str],
                        x: str, sink_path: str, checkpoint: str, watermark: str = "10 minutes"):
    """X01 as a running query: parquet file stream -> windowed stats -> parquet (append)."""
    src = spark.readStream.schema(schema).parquet(path)
    out = tumbling_stats(src, ts, duration, keys, x, watermark)
    return (out.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
            .outputMode("append").start())


def incremental_pass_features(spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
                              channels: Sequence[str] = CHANNELS, trigger_once: bool = True):
    """New pass files -> pass features, one folder per micro-batch.

    Each micro-batch holds whole files, so the batch operator sees every
    sample of a pass; the sample index is the read order inside the file.
    """
    src = (spark.readStream.schema(SIGNAL_SCHEMA).option("header", "false").option("pathGlobFilter", "c_*.csv")
           .csv(in_path).select("*", F.col("_metadata.file_path").alias("file")))

    def batch(df: DataFrame, batch_id: int) -> None:
        from flankwear.operators.ordering import with_position
        d = df.withColumn("_rid", F.monotonically_increasing_id())
        d = with_position(d, ["file"], ["_rid"], name="i").drop("_rid")
        d = with_pass_key(d).unpivot(["tool", "passe", "i"], list(channels), "channel", "x")
        # one folder per micro-batch: a replayed batch overwrites its own rows
        extract_pass_features(d, channels).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
