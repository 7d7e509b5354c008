"""Passes that arrive in parts (X02): keyed state with event-time timers.

A pass's samples come in any number of files and micro-batches.  Per (tool, passe, channel) the state holds the
samples' moments (ten numbers, whatever the pass's length), merged with each batch's; a timer closes the pass
``gap`` after its last sample, emits its statistics once and drops the state.  Samples older than the watermark
are late: they neither reopen nor change a closed pass.  State and output are tied to the query's checkpoint, so
a replayed batch changes nothing.  The state store has to be RocksDB's (``use_rocksdb``).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = ("n", "mean", "m2", "m3", "m4", "sum_abs", "energy", "low", "high", "last")
STATS = ("n", "mean", "std", "rms", "max", "p2p", "skew", "kurt", "energy", "energy_mean", "crest", "shape")


def moments(x: np.ndarray, last: float) -> tuple:
    """State of some samples: count, mean, central sums to the fourth power, absolute and squared sums, extremes, last time."""
    d = x - x.mean()
    return (float(len(x)), float(x.mean()), float((d ** 2).sum()), float((d ** 3).sum()), float((d ** 4).sum()), float(np.abs(x).sum()),
            float((x * x).sum()), float(x.min()), float(x.max()), last)


def merge(a: tuple, b: tuple) -> tuple:
    """State of the samples of both."""
    na, nb = a[0], b[0]
    n, d = na + nb, b[1] - a[1]
    m2 = a[2] + b[2] + d ** 2 * na * nb / n
    m3 = a[3] + b[3] + d ** 3 * na * nb * (na - nb) / n ** 2 + 3 * d * (na * b[2] - nb * a[2]) / n
    m4 = (a[4] + b[4] + d ** 4 * na * nb * (na * na - na * nb + nb * nb) / n ** 3
          + 6 * d * d * (na * na * b[2] + nb * nb * a[2]) / n ** 2 + 4 * d * (na * b[3] - nb * a[3]) / n)
    return (n, a[1] + d * nb / n, m2, m3, m4, a[5] + b[5], a[6] + b[6], min(a[7], b[7]), max(a[8], b[8]), max(a[9], b[9]))


def statistics(s: tuple, eps: float = 1e-12) -> tuple:
    """``STATS`` of a state, as ``signal_stats.moment_stats`` defines them."""
    n, mean, m2, m3, m4, sum_abs, energy, low, high, _ = s
    rms, peak = (energy / n) ** 0.5, max(abs(low), abs(high))
    spread = m2 > 0
    return (int(n), mean, (m2 / n) ** 0.5, rms, peak, high - low, n ** 0.5 * m3 / m2 ** 1.5 if spread else None,
            n * m4 / m2 ** 2 - 3 if spread else None, energy, energy / n, peak / rms if rms > eps else 0.0, rms / (sum_abs / n + eps))


class PassMoments(StatefulProcessor):
    """Keeps a pass's moments and closes it ``gap_ms`` after its last sample."""

    def __init__(self, keys: Sequence[str], ts: str, x: str, gap_ms: int) -> None:
        self.keys, self.ts, self.x, self.gap_ms = list(keys), ts, x, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", ", ".join(f"{c} double" for c in STATE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = tuple(self.state.get()) if self.state.exists() else None
        for pdf in rows:
            keep = pdf[pdf[self.x].notna()]
            if len(keep):
                new = moments(keep[self.x].to_numpy(np.float64), float(keep[self.ts].max().timestamp() * 1000))
                state = new if state is None else merge(state, new)
        if state is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(state[9]) + self.gap_ms)
            self.state.update(state)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.state.exists():
            out = statistics(tuple(self.state.get()))
            self.state.clear()
            yield pd.DataFrame([(*key, *out)], columns=[*self.keys, *STATS])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def pass_moments(samples: DataFrame, delay: str, gap_ms: int, keys: Sequence[str] = ("tool", "passe", "channel"), ts: str = "ts", x: str = "x") -> DataFrame:
    """Closed passes of a stream of samples (keys, ts, x): keys and ``STATS``, each pass once.  ``delay`` is how late samples
    may come."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", *(f"{c} double" for c in STATS[1:])])
    own = samples.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.col(x).cast("double").alias(x)).withWatermark(ts, delay)
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=PassMoments(keys, ts, x, gap_ms), outputStructType=schema,
                                                         outputMode="Append", timeMode="EventTime")


def run_to_files(closed: DataFrame, out_path: str, checkpoint: str) -> None:
    """Work off what has arrived and write the closed passes; a second run goes on from the checkpoint."""
    q = (closed.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
