"""Sinks (K01-K07): parquet / CSV / JSON writers and the model writer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, partition_by: str | None = "tool") -> None:
    """Feature / label table, partitioned by tool for later pruning."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_balanced(df: DataFrame, path: str) -> None:
    """One table with ``row_id, is_synthetic, weight``."""
    df.write.mode("overwrite").parquet(path)


def write_fused(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K03."""
    w = df.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))


def write_profile(df: DataFrame, path: str, step: str) -> None:
    """Append one JSON row per analysis step instead of mutating a document."""
    df.withColumn("step", F.lit(step)).write.mode("append").json(path)


def write_results(oof: DataFrame, metrics: DataFrame, meta: DataFrame, path: str) -> None:
    """The three result tables."""
    oof.write.mode("overwrite").parquet(f"{path}/oof")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    meta.write.mode("overwrite").json(f"{path}/run_meta")


def write_summary(metrics: DataFrame, path: str) -> None:
    """K06."""
    metrics.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def save_model(model, path: str) -> None:
    """Spark ML's own format."""
    model.write().overwrite().save(path)
