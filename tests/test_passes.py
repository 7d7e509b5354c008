"""Passes in parts: merged states, files over several batches against the batch result, replays, late samples."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwear.operators.signal_stats import moment_stats
from flankwear.streaming import passes as ps


def test_merge_and_statistics():
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, size=500)
    parts = [ps.moments(p, float(k)) for k, p in enumerate(np.split(x, [3, 50, 51, 300]))]
    s = parts[0]
    for p in parts[1:]:
        s = ps.merge(s, p)
    assert s == pytest.approx(ps.moments(x, 4.0), rel=1e-9)
    got = dict(zip(ps.STATS, ps.statistics(s)))
    z = (x - x.mean()) / x.std()
    assert (got["skew"], got["kurt"], got["std"]) == pytest.approx(((z ** 3).mean(), (z ** 4).mean() - 3, x.std()))
    flat = dict(zip(ps.STATS, ps.statistics(ps.moments(np.zeros(4), 0.0))))
    assert flat["skew"] is None and flat["crest"] == 0.0


def test_parts_over_batches_equal_the_batch_result(spark, tmp_path):
    ps.use_rocksdb(spark)
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"c{t}", p, "ae", start + dt.timedelta(seconds=float(3600 * p + s)), None if s % 17 == 5 else float(rng.normal()))
            for t in (1, 2) for p in range(6) for s in range(60)]
    schema = "tool string, passe int, channel string, ts timestamp, x double"
    rows.sort(key=lambda r: r[3])
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    cuts = [0, 100, 101, 290, 500, len(rows)]                      # parts end inside passes
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(src)

    def work():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ps.run_to_files(ps.pass_moments(stream, "10 minutes", 600_000), out, ck)
        return spark.read.schema(f"tool string, passe int, channel string, n long, {', '.join(f'{c} double' for c in ps.STATS[1:])}").parquet(out)

    work()
    late = [("c1", 0, "ae", start, 1e6)]                           # long closed
    end = [("end", 0, "ae", start + dt.timedelta(days=9), 0.0)]
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(src)
    work()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    got = {(r.tool, r.passe): r.asDict() for r in work().collect()}
    want = moment_stats(spark.createDataFrame(rows, schema), ["tool", "passe", "channel"]).collect()
    assert len(got) == len(want) == 12
    for r in want:
        for c in ps.STATS:
            assert got[r.tool, r.passe][c] == pytest.approx(r[c], rel=1e-9), c
    n = spark.read.parquet(out).count()
    work()                                                         # nothing new: nothing changes
    assert spark.read.parquet(out).count() == n == 12
    assert spark.read.parquet(out).where(F.col("max") > 1e5).count() == 0
