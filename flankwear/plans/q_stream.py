"""Queries: streams of given tables, written in parts and worked off by running queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.q_files import _folder
from flankwear.plans.sqlgen import present, r
from flankwear.streaming import passes as ps

#: Days are passes here, event types channels.
_KEYS = "'c' || CAST(user_id % 6 AS VARCHAR) AS tool, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS passe, event_type AS channel"


@register("x02_pass_moments", f"""WITH s AS (SELECT {_KEYS}, value AS x FROM events WHERE value IS NOT NULL),
m AS (SELECT *, avg(x) OVER (PARTITION BY tool, passe, channel) AS mu FROM s)
SELECT tool, passe, channel, count(*) AS n, """ + ", ".join([
    r("avg(x)", "mean"), r("sqrt(avg((x - mu) * (x - mu)))", "std"), r("sqrt(avg(x * x))", "rms"), r("max(abs(x))", "max"),
    r("max(x) - min(x)", "p2p"), r("sum(x * x)", "energy"), r("avg(x * x)", "energy_mean")]) + " FROM m GROUP BY 1, 2, 3")
def q_x02(spark, d):
    """All events as samples that arrive in four parts of time; every day's passes are closed once."""
    ev = b.table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % b.N_TOOLS).cast("string")).alias("tool"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("passe"), F.col("event_type").alias("channel"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("x"))
    lo, hi = ev.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts"))).first()
    path, step = _folder(spark, "passes"), (hi - lo) // 4 + 1
    for k in range(4):
        at = F.unix_timestamp("ts")
        ev.where((at >= lo + k * step) & (at < lo + (k + 1) * step)).write.mode("append").parquet(f"{path}/in")
    end = spark.createDataFrame([("", 0, "", hi + 10 * step, 0.0)], "tool string, passe int, channel string, at long, x double")
    end.select("tool", "passe", "channel", F.timestamp_seconds("at").alias("ts"), "x").write.mode("append").parquet(f"{path}/in")
    ps.use_rocksdb(spark)
    # files of one part may come in any order: samples may be a part's length late
    closed = ps.pass_moments(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), f"{2 * step} seconds", 86_400_000)
    ps.run_to_files(closed, f"{path}/out", f"{path}/checkpoint")
    out = spark.read.parquet(f"{path}/out").where("tool <> ''")
    return present(out.select("tool", "passe", "channel", "n", "mean", "std", "rms", "max", "p2p", "energy", "energy_mean"))
