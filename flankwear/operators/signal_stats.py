"""Per-pass signal statistics.

Signals are kept long: ``(tool, passe, channel, i, x)``.  All 13 statistics
come from two scans: ONE grouped aggregation over ``(tool, passe, channel)``
(partial aggregation map-side, so a hot pass is pre-reduced in every task)
for the moments, and one scan that ranks the samples (of large groups only
those inside brackets, which a sketch of these groups sets); a pivot with an explicit channel list turns
the result wide at the very end.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.operators.ordering import ACCURACY, BROADCAST_GROUPS, _ns_join, approx_quantiles, bracket_aggs, quantiles_in
from flankwear.session import write_stage

# Channel names of a raw milling pass, sampling rate, statistic order.
CHANNELS = ["force_x", "force_y", "force_z", "vib_x", "vib_y", "vib_z", "ae"]
FS = 50_000
STATS = ["mean", "std", "rms", "max", "p2p", "skew", "kurt", "crest", "shape", "energy", "p25", "p75", "iqr"]
# Rounding digits of the pass-feature table.
STAT_DIGITS = {"mean": 8, "std": 8, "rms": 8, "max": 6, "p2p": 6, "skew": 8, "kurt": 8, "crest": 8,
               "shape": 8, "energy": 6, "p25": 6, "p75": 6, "iqr": 6}

KEYS = ["tool", "passe"]


def moment_stats(sig: DataFrame, keys: Sequence[str], x: str = "x", eps: float = 1e-12, also: Sequence[Column] = ()) -> DataFrame:
    """A01-A11 per group: one aggregation, NULL inputs skipped (all-NULL -> NULLs); ``also`` adds aggregates to it."""
    v = F.col(x)
    agg = sig.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.max(F.abs(v)).alias("max"),
        (F.max(v) - F.min(v)).alias("p2p"),
        F.skewness(v).alias("skew"),
        F.kurtosis(v).alias("kurt"),
        F.sum(v * v).alias("energy"),
        F.avg(v * v).alias("energy_mean"),
        F.avg(F.abs(v)).alias("_mabs"),
        *also,
    )
    return (agg
            .withColumn("crest", F.when(F.col("rms").isNull(), F.lit(None).cast("double"))
                        .when(F.col("rms") > eps, F.col("max") / F.col("rms")).otherwise(F.lit(0.0)))
            .withColumn("shape", F.col("rms") / (F.col("_mabs") + F.lit(eps)))
            .drop("_mabs"))


def channel_stats(sig: DataFrame, keys: Sequence[str] = ("tool", "passe", "channel"), x: str = "x",
                  eps: float = 1e-12, approx: bool = False) -> DataFrame:
    """Long pass-feature table: one row per (keys) with A01-A14 (+ energy_mean, n)."""
    keys = list(keys)
    probs = {"p25": 0.25, "p75": 0.75}
    if approx:
        m = moment_stats(sig, keys, x, eps)
        q = approx_quantiles(sig, keys, x, probs)
    else:
        # the first scan: moments; a sketch only of groups too large to be ranked whole; the last scan ranks
        n, nan, sketch = bracket_aggs(sig, x, list(probs.values()))
        m = write_stage(moment_stats(sig, keys, x, eps, [n, nan]))
        found = m.where("__n > 0").select(*keys, "__n", "__nan")
        large = m.where(F.col("__n") >= 2 * ACCURACY).select(*keys)
        if large.isEmpty():
            found = found.withColumn("__b", F.lit(None).cast(f"array<{sig.schema[x].dataType.simpleString()}>"))
        else:
            b = write_stage(_ns_join(sig, F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large, keys, "left_semi").groupBy(*keys).agg(sketch))
            found = write_stage(_ns_join(found, b, keys, "left"))
        q = quantiles_in(sig, keys, x, probs, found)
    out = _ns_join(m, q, keys, "left").withColumn("iqr", F.col("p75") - F.col("p25"))
    return out.select(*keys, "n", *STATS, "energy_mean")


def to_wide(long: DataFrame, keys: Sequence[str] = KEYS, channels: Sequence[str] = CHANNELS,
            stats: Sequence[str] = STATS, channel_col: str = "channel") -> DataFrame:
    """Pivot the long statistics to ``<channel>_<stat>`` columns (explicit value list)."""
    keys = list(keys)
    piv = long.groupBy(*keys).pivot(channel_col, list(channels)).agg(
        *[F.first(s).alias(s) for s in stats])
    if len(stats) == 1:
        piv = piv.select(*keys, *[F.col(c).alias(f"{c}_{stats[0]}") for c in channels])
    return piv.select(*keys, *[f"{c}_{s}" for c in channels for s in stats])


def extract_pass_features(sig: DataFrame, channels: Sequence[str] = CHANNELS,
                          keys: Sequence[str] = KEYS, eps: float = 1e-12,
                          approx: bool = False, rounded: bool = True) -> DataFrame:
    """Wide pass-feature table ``keys + <channel>_<stat>`` (13 x channels)."""
    long = channel_stats(sig, [*keys, "channel"], eps=eps, approx=approx)
    if rounded:
        long = long.select(*keys, "channel", *[F.bround(s, STAT_DIGITS[s]).alias(s) for s in STATS])
    return to_wide(long, keys, channels)


def window_head(sig: DataFrame, ms: float = 40.0, fs: float = FS, i: str = "i") -> DataFrame:
    """Keep samples of the first ``ms`` milliseconds."""
    return sig.where(F.col(i) < F.lit(int(ms * fs / 1000.0)))


def window_stats(sig: DataFrame, ms: float = 40.0, fs: float = FS,
                 keys: Sequence[str] = ("tool", "passe", "channel")) -> DataFrame:
    """RMS and peak-to-peak over the first ``ms`` milliseconds."""
    h = window_head(sig, ms, fs)
    return h.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
                                (F.max("x") - F.min("x")).alias("p2p"),
                                F.count("x").alias("n"))


def rms_ratio(sig: DataFrame, first: int | None = None, last: int | None = None, keys: Sequence[str] = ("tool", "channel"),
              group: str = "tool") -> DataFrame:
    """RMS of the last pass over RMS of the first per channel; without numbers the first and last pass of each
    ``group``.  One scan: passes are reduced to their mean square before any is chosen; a channel without samples in a
    chosen pass has a NULL there."""
    power = sig.where(F.col("passe").isNotNull()).groupBy(*keys, "passe").agg(F.avg(F.col("x") * F.col("x")).alias("ms"))
    ends = power.groupBy(F.col(group).alias("_g")).agg((F.min("passe") if first is None else F.lit(first)).alias("_first"),
                                                       (F.max("passe") if last is None else F.lit(last)).alias("_last"))
    at = lambda end: F.sqrt(F.max(F.when(F.col("passe") == F.col(end), F.col("ms"))))
    agg = (power.join(ends, F.col(group).eqNullSafe(F.col("_g"))).where((F.col("passe") == F.col("_first")) | (F.col("passe") == F.col("_last")))
           .groupBy(*keys).agg(at("_first").alias("rms_first"), at("_last").alias("rms_last")))
    return agg.withColumn("ratio", F.try_divide(F.col("rms_last"), F.col("rms_first")))
