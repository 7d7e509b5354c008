"""Session construction and lineage-cutting helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "flankwear",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    On a cluster pass ``master=None`` and let the launcher decide; size
    ``shuffle_partitions`` to roughly (input bytes / 128 MB).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL_DIR: str | None = None


def partitions_for(input_bytes: int, target_bytes: int = 128 * 1024 * 1024, cores: int | None = None) -> int:
    """Shuffle partition count so each partition holds about ``target_bytes`` of shuffled data
    (at least 2x the cores, so every core gets work and AQE can coalesce the rest)."""
    n = max(1, -(-int(input_bytes) // int(target_bytes)))
    return max(n, 2 * (cores or 1))


def configure_for_input(spark: SparkSession, input_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Size ``spark.sql.shuffle.partitions`` and the scan split size for an input of ``input_bytes``."""
    cores = spark.sparkContext.defaultParallelism
    n = partitions_for(input_bytes, target_bytes, cores)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local tests)
    is a private scratch folder created.
    """
    global _LOCAL_DIR
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _LOCAL_DIR
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is invisible to executors: a cluster must name a shared one
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (stage tables are written there)")
        # unset in a local session (tests): a private scratch folder; the session conf itself
        # is not modifiable at runtime, so only the context's checkpoint folder is set
        d = _LOCAL_DIR = tempfile.mkdtemp(prefix="flankwear-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def write_stage(df: DataFrame, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Write a stage table under the shared checkpoint folder and read it back.

    Columnar files are cheaper to write and re-read than serialized RDD
    checkpoints, and they pin the exact rows every later reader sees.
    """
    name = name or f"stage-{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(df.sparkSession), "stages", name)
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)
