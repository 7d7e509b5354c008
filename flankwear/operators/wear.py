"""Wear labels and per-pass order operators (S05/S06 post-processing, F02-F07,
J01-J06, W01-W05, W09, A25, A36, A37)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.functions.scalar import (WEAR_CLASSES_RIGHT, cut_right, row_mean, scale_wear,
                                        wear_state)
from flankwear.operators.ordering import neighbourhood, with_position

KEYS = ["tool", "passe"]


def wear_table(raw: DataFrame, flutes: Sequence[str] = ("vb1", "vb2", "vb3"),
               limit: float = 10.0) -> DataFrame:
    """Raw per-pass flute readings -> ``(tool, passe, vb…, vb_mean)`` in mm.

    P03 all-empty rows dropped, F02 mean over present flutes, F03 per-tool unit
    rule, P04 rows without a pass number or a mean are dropped.
    """
    flutes = [f for f in flutes if f in raw.columns]
    w = raw.na.drop("all", subset=[*KEYS[1:], *flutes]).withColumn("_vb", row_mean(flutes))
    w = w.withColumn("vb_mean", scale_wear("_vb", ["tool"], limit)).drop("_vb")
    return w.na.drop(subset=["passe", "vb_mean"])


def label_passes(feats: DataFrame, wear: DataFrame, how: str = "left",
                 preset: str = "three_state", missing: str = "inconnu",
                 state_col: str = "etat") -> DataFrame:
    """J01 (left, unlabeled -> ``missing``) / J02 (inner): attach vb_mean and wear state.

    The wear side has one row per pass, so it is far smaller than the feature
    scan; Spark/AQE broadcasts it when its measured size is under the
    broadcast threshold and falls back to a shuffle join otherwise.
    """
    j = feats.join(wear.select(*KEYS, "vb_mean"), KEYS, how)
    return j.withColumn(state_col, wear_state("vb_mean", preset, missing=missing))


def unlabeled(feats: DataFrame, wear: DataFrame) -> DataFrame:
    """Passes with no wear measurement."""
    return feats.join(wear.select(*KEYS), KEYS, "left_anti")


def zip_by_row(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Align two tables on an explicit row id (never on position)."""
    return a.join(b, row_id, "inner")


def compare_passes(sig: DataFrame, tool: str, first: int, last: int) -> DataFrame:
    """Sample-by-sample comparison of two passes of one tool per channel."""
    s = sig.where((F.col("tool") == tool) & F.col("passe").isin(first, last))
    a = s.where(F.col("passe") == first).select("channel", "i", F.col("x").alias("x_first"))
    b = s.where(F.col("passe") == last).select("channel", "i", F.col("x").alias("x_last"))
    return a.join(b, ["channel", "i"], "full_outer").withColumn("diff", F.col("x_last") - F.col("x_first"))


def wear_rate(wear: DataFrame, value: str = "vb_mean", keys: Sequence[str] = ("tool",),
              order: str = "passe") -> DataFrame:
    """Numpy-style gradient along passes (central inside, one-sided at the ends).

    Positions are taken from the order, so gaps in pass numbers count as one step.
    """
    keys = list(keys)
    p = with_position(wear.select(*keys, order, value), keys, [order], name="_pos")
    nb = neighbourhood(p, keys, "_pos", [value, order], [-1, 1])
    prev, cur, nxt = (F.col(f"{value}_at_m1"), F.col(f"{value}_at_0"), F.col(f"{value}_at_1"))
    no_prev, no_next = F.col(f"_has_{value}_m1") == 0, F.col(f"_has_{value}_1") == 0
    rate = (F.when(no_prev & no_next, F.lit(None))
            .when(no_prev, nxt - cur)
            .when(no_next, cur - prev)
            .otherwise((nxt - prev) / 2.0))
    return nb.select(*keys, F.col(f"{order}_at_0").alias(order), cur.alias(value), rate.alias("rate"))


def rolling_mean(df: DataFrame, value: str, n: int = 5, keys: Sequence[str] = ("tool",),
                 order: str = "passe", out: str | None = None) -> DataFrame:
    """Centered rolling mean of ``n`` (odd) rows, NULL unless all ``n`` are present."""
    keys = list(keys)
    h = n // 2
    offs = list(range(-h, h + 1))
    p = with_position(df.select(*keys, order, value), keys, [order], name="_pos")
    nb = neighbourhood(p, keys, "_pos", [value, order], offs)

    def tag(o):
        return f"m{-o}" if o < 0 else str(o)
    full = F.lit(True)
    total = F.lit(0.0)
    for o in offs:
        full = full & (F.col(f"_has_{value}_{tag(o)}") == 1) & F.col(f"{value}_at_{tag(o)}").isNotNull()
        total = total + F.col(f"{value}_at_{tag(o)}")
    return nb.select(*keys, F.col(f"{order}_at_0").alias(order), F.col(f"{value}_at_0").alias(value),
                     F.when(full, total / n).alias(out or f"{value}_roll{n}"))


def first_last_pass(df: DataFrame, keys: Sequence[str] = ("tool",), order: str = "passe") -> DataFrame:
    """First and last pass per tool (partial aggregation)."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_passe"), F.max(order).alias("last_passe"))


def nth_pass(df: DataFrame, k: int, keys: Sequence[str] = ("tool",), order: str = "passe") -> DataFrame:
    """The k-th distinct pass by position (0-based), clamped to ``[0, n-1]``."""
    keys = list(keys)
    d = df.select(*keys, order).distinct()
    p = with_position(d, keys, [order], name="_pos", count_name="_n")
    want = F.least(F.greatest(F.lit(k), F.lit(0)), F.col("_n") - 1)
    return p.where(F.col("_pos") == want).select(*keys, order)


def with_seq(df: DataFrame, order: Sequence[str], name: str = "seq", stage_input: bool = True) -> DataFrame:
    """Global 0-based sequence number in ``order`` (skew-safe, no single-task window).
    The input is usually a grouped table, so it is staged once before slicing."""
    return with_position(df, [], list(order), name=name, stage_input=stage_input)


def feature_evolution(df: DataFrame, feature: str, keys: Sequence[str] = ("tool", "passe")) -> DataFrame:
    """One feature ordered along passes per tool."""
    return df.select(*keys, feature).orderBy(*keys)


def wear_distribution(wear: DataFrame, edges=None, labels=None, value: str = "vb_mean") -> DataFrame:
    """Cross-tab tool x right-closed wear class, zero filled, explicit class order."""
    if edges is None:
        edges, labels = WEAR_CLASSES_RIGHT
    t = wear.withColumn("_cls", cut_right(value, edges, labels))
    return t.groupBy("tool").pivot("_cls", list(labels)).count().na.fill(0)


def wear_inventory(wear: DataFrame, flutes: Sequence[str] = ("vb1", "vb2", "vb3")) -> DataFrame:
    """Per tool n passes, min / max over flutes, mean of the flute means."""
    flutes = [f for f in flutes if f in wear.columns]
    return wear.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n_passes"),
        F.least(*[F.min(f) for f in flutes]).alias("vb_min"),
        F.greatest(*[F.max(f) for f in flutes]).alias("vb_max"),
        (sum(F.coalesce(F.avg(f), F.lit(0.0)) for f in flutes)
         / sum(F.avg(f).isNotNull().cast("int") for f in flutes)).alias("vb_mean"))


def pass_inventory(sig: DataFrame, fs: float = 50_000) -> DataFrame:
    """Passes per tool, mean samples per pass and the mean pass duration in ms.  Sample indexes run from 0 without
    gaps, so a pass has one more sample than its largest index."""
    per_pass = sig.groupBy("tool", "passe").agg((F.max("i") + 1).alias("samples"))
    return per_pass.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n_passes"),
        F.avg("samples").alias("samples_per_pass"),
        (F.avg("samples") * 1000.0 / F.lit(float(fs))).alias("duration_ms"))
