"""Spectral operators.

Welch's PSD is computed per *segment*, not per pass: each sample is copied to
the (at most two) half-overlapping segments it belongs to, a segment is
gathered as one bounded array (``L`` values), a vectorised Arrow/pandas UDF
turns a batch of segments into periodograms, and the periodograms are
averaged per frequency bin with a grouped ``avg``.  A long or hot pass is thus
spread over many independent segments.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankwear.operators.signal_stats import CHANNELS, STATS, channel_stats

# Frequency bands (Hz), tooth-pass parameters and harmonic half-width.
BANDS = [(0, 200), (200, 600), (600, 1500), (1500, 4000), (4000, 10000)]
SPINDLE_RPM = 10400
FLUTES = 3
N_HARMONICS = 5
HARMONIC_HALF_WIDTH = 30.0


def tooth_pass_hz(rpm: float = SPINDLE_RPM, flutes: int = FLUTES) -> float:
    return rpm / 60.0 * flutes


#: Samples of a run, the unit in which segments are cut.
RUN = 65_536


def segments(sig: DataFrame, L: int, keys: Sequence[str] = ("tool", "passe", "channel")) -> DataFrame:
    """Full, half-overlapping segments of length ``L``: ``keys + (seg, L, x)`` with ``x`` the ordered sample array.

    Samples are shuffled once, to runs of about ``RUN`` samples of their signal; only the samples at the start of a run
    (one hop of ``L / 2``) are copied to the run before it, whose last segment they end.  Segments are then cut in
    place, so a hot pass is spread over its runs.  Sample indexes run from 0 without gaps (R1).  A signal shorter
    than ``L`` becomes one segment of its own length.
    """
    keys = list(keys)
    step = L - L // 2
    hops = max(1, RUN // step)                                    # of a run
    hop = F.floor(F.col("i") / F.lit(step)).cast("int")
    run = F.floor(hop / F.lit(hops)).cast("int")
    halo = (F.pmod(hop, F.lit(hops)) == 0) & (hop > 0)
    s = sig.select(*keys, "i", "x", F.explode(F.when(halo, F.array(run, run - 1)).otherwise(F.array(run))).alias("_run"))
    runs = (s.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_s"))
            .select(*keys, "_run", F.col("_s.x").alias("_x")))
    cut = F.filter(F.transform(F.sequence(F.lit(0), F.lit(hops - 1)), lambda k: F.struct(
        (F.col("_run") * hops + k).alias("seg"), F.slice("_x", k * step + 1, L).alias("x"))), lambda g: F.size(g["x"]) == L)
    short = (F.col("_run") == 0) & (F.size("_x") < L)             # the whole signal
    whole = F.array(F.struct(F.lit(0).alias("seg"), F.col("_x").alias("x")))
    return (runs.select(*keys, F.explode(F.when(short, whole).otherwise(cut)).alias("_g"))
            .select(*keys, F.col("_g.seg").alias("seg"), F.size("_g.x").alias("L"), F.col("_g.x").alias("x")))


def _by_length(seg: pd.Series, fs: float):
    """(row numbers, one-sided density) of the segments, batched by their length."""
    lens = seg.map(len).to_numpy()
    for L in np.unique(lens):
        idx = np.nonzero(lens == L)[0]
        x = np.vstack([np.asarray(seg.iloc[k], dtype=np.float64) for k in idx])
        x = x - x.mean(axis=1, keepdims=True)             # constant detrend
        w = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(L) / L)  # periodic Hann
        p = np.abs(np.fft.rfft(x * w, axis=1)) ** 2 / (fs * np.sum(w * w))
        p[:, 1:-1 if L % 2 == 0 else None] *= 2.0
        yield idx, int(L), p


def _periodogram_udf(fs: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def periodogram(seg: pd.Series) -> pd.Series:
        out = [None] * len(seg)
        for idx, _, p in _by_length(seg, fs):
            for r, k in enumerate(idx):
                out[k] = p[r].tolist()
        return pd.Series(out)
    return periodogram


def segment_energies(sig: DataFrame, fs: float, L: int, f0: float, keys: Sequence[str] = ("tool", "passe", "channel"),
                     bands=BANDS, n: int = N_HARMONICS, half: float = HARMONIC_HALF_WIDTH, eps: float = 1e-12) -> DataFrame:
    """G02-G05 for features: band powers, their shares and harmonic energies as rows ``keys + (stat, v)``.

    Sums over bins and the mean over segments commute, so a segment leaves its task as a dozen sums instead
    of its spectrum, and only those are shuffled and averaged."""
    keys = list(keys)
    ranges = [(lo, hi, False) for lo, hi in bands] + [(f0 * h - half, f0 * h + half, True) for h in range(1, n + 1)]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sums(seg: pd.Series) -> pd.Series:
        out = [None] * len(seg)
        for idx, size, p in _by_length(seg, float(fs)):
            freq = np.arange(p.shape[1]) * float(fs) / size
            pick = [(freq >= lo) & ((freq <= hi) if closed else (freq < hi)) for lo, hi, closed in ranges]
            rows = np.column_stack([p.sum(axis=1), *[p[:, m].sum(axis=1) for m in pick]])
            for r, k in enumerate(idx):
                out[k] = rows[r].tolist()
        return pd.Series(out)

    parts = segments(sig, L, keys).select(*keys, sums("x").alias("s"))
    mean = parts.groupBy(*keys).agg(*[F.avg(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(len(ranges) + 1)])
    names = [f"band_{lo}_{hi}" for lo, hi in bands] + [f"tpf_h{h}" for h in range(1, n + 1)]
    stats = [F.struct(F.lit(x).alias("stat"), F.col(f"s{i + 1}").alias("v")) for i, x in enumerate(names)]
    stats += [F.struct(F.lit(f"{x}_rel").alias("stat"), (F.col(f"s{i + 1}") / (F.col("s0") + F.lit(eps))).alias("v"))
              for i, x in enumerate(names[:len(bands)])]
    return mean.select(*keys, F.explode(F.array(*stats)).alias("t")).select(*keys, "t.stat", "t.v")


def welch(sig: DataFrame, fs: float, L: int, keys: Sequence[str] = ("tool", "passe", "channel")) -> DataFrame:
    """Welch PSD ``keys + (bin, freq, psd)``, one-sided density, mean over segments."""
    keys = list(keys)
    arr = segments(sig, L, keys)
    pg = arr.select(*keys, "L", F.posexplode(_periodogram_udf(float(fs))("x")).alias("bin", "p"))
    psd = pg.groupBy(*keys, "L", "bin").agg(F.avg("p").alias("psd"))
    return psd.select(*keys, "bin", (F.col("bin") * F.lit(float(fs)) / F.col("L")).alias("freq"), "psd")


def bands_table(spark, bands=BANDS) -> DataFrame:
    return spark.createDataFrame([(f"band_{lo}_{hi}", float(lo), float(hi)) for lo, hi in bands],
                                 "band string, lo double, hi double")


def band_join(psd: DataFrame, bands: DataFrame) -> DataFrame:
    """Bins x bands, ``lo <= f < hi`` (bands: a handful of constant rows, broadcast)."""
    return psd.join(F.broadcast(bands), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi")))


def band_power(psd: DataFrame, keys: Sequence[str] = ("tool", "passe", "channel"), bands=BANDS,
               eps: float = 1e-12) -> DataFrame:
    """G03 + G04: absolute (sum of bins) and relative band power, long form."""
    keys = list(keys)
    spark = psd.sparkSession
    bt = bands_table(spark, bands)
    j = band_join(psd, bt).groupBy(*keys, "band").agg(F.sum("psd").alias("power"))
    tot = psd.groupBy(*keys).agg(F.sum("psd").alias("_tot"))
    allb = tot.withColumn("band", F.explode(F.array(*[F.lit(f"band_{lo}_{hi}") for lo, hi in bands])))
    out = allb.join(j, [*keys, "band"], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
    return out.select(*keys, "band", "power", (F.col("power") / (F.col("_tot") + F.lit(eps))).alias("power_rel"))


def harmonics_table(spark, f0: float, n: int = N_HARMONICS, half: float = HARMONIC_HALF_WIDTH) -> DataFrame:
    return spark.createDataFrame([(f"tpf_h{h}", f0 * h - half, f0 * h + half) for h in range(1, n + 1)],
                                 "harmonic string, lo double, hi double")


def harmonic_join(psd: DataFrame, harmonics: DataFrame) -> DataFrame:
    """Bins within ``[h - w, h + w]`` (both ends closed)."""
    return psd.join(F.broadcast(harmonics), F.col("freq").between(F.col("lo"), F.col("hi")))


def tpf_energy(psd: DataFrame, f0: float, n: int = N_HARMONICS, half: float = HARMONIC_HALF_WIDTH,
               keys: Sequence[str] = ("tool", "passe", "channel")) -> DataFrame:
    """PSD summed around each tooth-pass harmonic (0 when no bin falls inside)."""
    keys = list(keys)
    ht = harmonics_table(psd.sparkSession, f0, n, half)
    j = harmonic_join(psd, ht).groupBy(*keys, "harmonic").agg(F.sum("psd").alias("energy"))
    allh = psd.select(*keys).distinct().withColumn(
        "harmonic", F.explode(F.array(*[F.lit(f"tpf_h{h}") for h in range(1, n + 1)])))
    return allh.join(j, [*keys, "harmonic"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def characteristic_freqs(spark, rpm: float = SPINDLE_RPM, flutes: int = FLUTES, fs: float = 50_000) -> DataFrame:
    """Spindle, tooth-pass and tooth-pass harmonics below Nyquist."""
    sp = rpm / 60.0
    tp = sp * flutes
    df = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.floor(F.lit(fs / 2.0 / tp)).cast("int"))).alias("k"))
    harm = df.select(F.concat(F.lit("tpf_h"), F.col("k").cast("string")).alias("name"), (F.col("k") * tp).alias("freq"))
    base = spark.createDataFrame([("spindle", sp), ("tooth_pass", tp)], "name string, freq double")
    return base.unionByName(harm)


def compare_psd(psd: DataFrame, a: dict, b: dict, fmax: float = 8000.0, on: Sequence[str] = ("channel", "bin", "freq")) -> DataFrame:
    """Two spectra side by side (up to ``fmax``) and their ratio."""
    def pick(sel, name):
        c = F.lit(True)
        for k, v in sel.items():
            c = c & (F.col(k) == F.lit(v))
        return psd.where(c & (F.col("freq") <= fmax)).select(*on, F.col("psd").alias(name))
    j = pick(a, "psd_a").join(pick(b, "psd_b"), list(on), "full_outer")
    return j.withColumn("ratio", F.try_divide(F.col("psd_b"), F.col("psd_a")))


def spectral_names() -> list[str]:
    """The 28 per-channel feature names of G08, in output order."""
    tstats = [s if s != "max" else "peak" for s in STATS]
    return tstats + [f"band_{lo}_{hi}" for lo, hi in BANDS] + [f"band_{lo}_{hi}_rel" for lo, hi in BANDS] \
        + [f"tpf_h{h}" for h in range(1, N_HARMONICS + 1)]


def extract_spectral_features(sig: DataFrame, wear: DataFrame, fs: float, L: int,
                              channels: Sequence[str] = CHANNELS, f0: float | None = None,
                              long_hook=None) -> DataFrame:
    """13 time + 5 band + 5 relative band + 5 harmonic features per channel,
    labeled passes only (inner join with the wear table).  ``long_hook`` may
    transform the long ``(tool, passe, channel, stat, v)`` table before the pivot."""
    keys = ["tool", "passe", "channel"]
    f0 = f0 if f0 is not None else tooth_pass_hz()
    tstat = (channel_stats(sig, keys).withColumnRenamed("max", "peak")
             .withColumn("energy", F.col("energy_mean"))
             .withColumn("crest", F.col("peak") / (F.col("rms") + F.lit(1e-12))))
    tstats = [s if s != "max" else "peak" for s in STATS]
    tl = tstat.unpivot(keys, tstats, "stat", "v")
    long = tl.unionByName(segment_energies(sig, fs, L, f0, keys))
    if long_hook is not None:
        long = long_hook(long)
    names = spectral_names()
    long = long.withColumn("col", F.concat_ws("_", "channel", "stat"))
    wide = long.groupBy("tool", "passe").pivot("col", [f"{c}_{s}" for c in channels for s in names]).agg(F.first("v"))
    return wide.join(wear.select("tool", "passe", F.col("vb_mean").alias("vb")), ["tool", "passe"], "inner")
