"""Scalar projections F01-F21.  Every helper returns a Column or a DataFrame
built from built-in expressions, so they stay inside whole-stage codegen."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankwear.session import write_stage

# Wear-state presets (thresholds in mm, labels in order).
WEAR_PRESETS = {
    "three_state": ([0.1, 0.2], ["neuf", "intermediaire", "use"]),
    "four_state": ([0.1, 0.2, 0.3], ["new", "ok", "worn", "eol"]),
    "binary": ([0.2], ["unworn", "worn"]),
}
# Right-closed wear classes used for the per-tool distribution (the plot labels,
# with their line break written as a space because they become column names).
WEAR_CLASSES_RIGHT = ([0.1, 0.2, 0.3], ["New (<0.1)", "Acceptable (0.1-0.2)", "Worn (0.2-0.3)", "EOL (>0.3)"])
# Feature groups, by name prefix or by exact name.
GROUP_PREFIXES = {"pass_signals": ["force_", "vib_", "ae_"], "motor_signals": ["S1_", "X1_", "Y1_", "Z1_"]}
GROUP_NAMES = {"roughness": ["Ra", "Rz", "Rsk", "Rku", "RSm", "Rt"], "forces": ["Fx", "Fy", "Fz", "F"],
               "cutting_params": ["ap", "vc", "f"]}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """numeric coercion; unparsable text and NaN become NULL."""
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            x = F.expr(f"try_cast(`{f.name}` AS {to})")
            if to in ("double", "float"):
                x = F.nanvl(x, F.lit(None).cast(to))
            out.append(x.alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def row_mean(cols: Sequence[str | Column]) -> Column:
    """row-wise mean skipping NULLs; NULL when every input is NULL."""
    arr = F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, total / F.size(arr))


def scale_wear(vb: str | Column, by: Sequence[str] = ("tool",), limit: float = 10.0) -> Column:
    """µm -> mm when the maximum over the tool exceeds ``limit``."""
    w = Window.partitionBy(*by)
    return F.when(F.max(_c(vb)).over(w) > limit, _c(vb) / 1000.0).otherwise(_c(vb))


def wear_state(vb: str | Column, cuts: Sequence[float] | str = "three_state",
               labels: Sequence[str] | None = None, missing: str | None = None) -> Column:
    """left-closed bucketing ``[a, b)`` with configurable cuts and labels."""
    if isinstance(cuts, str):
        cuts, labels = WEAR_PRESETS[cuts]
    x = _c(vb)
    e = F.when(x.isNull(), F.lit(missing))
    for cut, lab in zip(cuts, labels):
        e = e.when(x < cut, F.lit(lab))
    return e.otherwise(F.lit(labels[len(cuts)]))


def worn_label(vb: str | Column, threshold: float = 0.2) -> Column:
    """``vb >= threshold`` -> worn, else unworn; NULL -> unknown."""
    x = _c(vb)
    return F.when(x.isNull(), "unknown").when(x >= threshold, "worn").otherwise("unworn")


def cut_right(vb: str | Column, edges: Sequence[float] | None = None,
              labels: Sequence[str] | None = None) -> Column:
    """right-closed bins ``(a, b]`` with open outer ends."""
    if edges is None:
        edges, labels = WEAR_CLASSES_RIGHT
    x = _c(vb)
    e = F.when(x.isNull(), F.lit(None))
    for edge, lab in zip(edges, labels):
        e = e.when(x <= edge, F.lit(lab))
    return e.otherwise(F.lit(labels[len(edges)]))


def harmonise_condition(df: DataFrame, col: str = "Condition", out: str = "tool_condition") -> DataFrame:
    """numeric condition > 0 -> worn, missing -> 0 -> unworn; no column -> unknown."""
    if col not in df.columns:
        return df.withColumn(out, F.lit("unknown"))
    v = F.coalesce(F.expr(f"try_cast(`{col}` AS double)"), F.lit(0.0))
    return df.withColumn(out, F.when(v > 0, "worn").otherwise("unworn"))


def ensure_columns(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """add absent columns as typed NULLs."""
    for c, t in cols.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def energy_name(col: str, stat: str, prefix: str = "haupt_") -> str:
    """``ENERGY|x`` + ``sum`` -> ``haupt_ENERGY_x_sum``."""
    return f"{prefix}{col.replace('|', '_')}_{stat}"


def short_name(c: str | Column) -> Column:
    """strip an ordinal prefix ``01_RandomForest`` -> ``RandomForest``."""
    x = _c(c)
    return F.when(x.contains("_"), F.regexp_replace(x, r"^[^_]*_", "")).otherwise(x)


def feature_group(name: str | Column, prefixes=GROUP_PREFIXES, names=GROUP_NAMES, other: str = "other") -> Column:
    """tag a feature name with its sensor group, by prefix or exact name."""
    x = _c(name)
    member = {g: reduce(lambda a, b: a | b, [x.startswith(p) for p in ps]) for g, ps in prefixes.items()}
    member |= {g: x.isin(*ns) for g, ns in names.items()}
    return F.coalesce(*[F.when(hit, F.lit(g)) for g, hit in member.items()], F.lit(other))


def with_time(df: DataFrame, fs: float, i: str = "i", out: str = "t_ms") -> DataFrame:
    """sample time axis in milliseconds."""
    return df.withColumn(out, F.col(i) / F.lit(float(fs)) * 1000.0)


def samples_in_window(ms: float, fs: float) -> int:
    """number of samples in a window of ``ms`` milliseconds."""
    return int(ms * fs / 1000.0)


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None,
            drop: bool = True) -> DataFrame:
    """``<col>_<value>`` 0/1 columns for an explicit value list (no data scan)."""
    p = prefix or col
    out = df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in values])
    return out.drop(col) if drop else out


def label_mapping(df: DataFrame, col: str, missing: str = "NA") -> DataFrame:
    """alphabetical label -> index table (distinct values only, so tiny)."""
    d = df.select(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("label")).distinct()
    return d.withColumn("label_idx", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


#: A label mapping is broadcast up to so many labels (an index and a short text each); beyond, the join goes by label.
BROADCAST_LABELS = 100_000


def label_encode(df: DataFrame, col: str, out: str = "label_idx", missing: str = "NA") -> DataFrame:
    """replace labels by their alphabetical index.

    The mapping is written first: where it is small the rows stay where they are, so that the rows of a common label
    don't gather in one task."""
    m = write_stage(label_mapping(df, col, missing)).withColumnRenamed("label", "_lbl")
    key = F.coalesce(F.col(col).cast("string"), F.lit(missing))
    return (df.withColumn("_lbl", key)
            .join(F.broadcast(m) if m.count() <= BROADCAST_LABELS else m, "_lbl", "left")
            .withColumnRenamed("label_idx", out).drop("_lbl"))


def label_decode(df: DataFrame, mapping: DataFrame, col: str, out: str) -> DataFrame:
    """index -> label through the mapping table."""
    m = mapping.select(F.col("label_idx").alias(col), F.col("label").alias(out))
    return df.join(m, col, "left")


def binary_target(c: str | Column, positive: str = "worn") -> Column:
    """F16: ``(label == positive)`` as int."""
    return (_c(c) == F.lit(positive)).cast("int")


def fill(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """replace NULLs by a constant."""
    return df.na.fill(value, subset=list(cols) if cols else None)


def round_cols(df: DataFrame, digits: int | dict[str, int], half_even: bool = True) -> DataFrame:
    """round double columns (half-even like Python by default)."""
    fn = F.bround if half_even else F.round
    out = []
    for f in df.schema.fields:
        d = digits.get(f.name) if isinstance(digits, dict) else digits
        if d is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(fn(F.col(f"`{f.name}`"), d).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None,
            var: str = "variable", val: str = "valeur") -> DataFrame:
    """wide -> long (melt)."""
    cols = list(cols) if cols else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, var, val)


def rel_deviation(y: str | Column, yhat: str | Column) -> Column:
    """``(y - ŷ) / y``; 0 when ``y == 0``."""
    return F.when(_c(y) == 0, F.lit(0.0)).otherwise((_c(y) - _c(yhat)) / _c(y))


def stars(p: str | Column) -> Column:
    """significance stars."""
    x = _c(p)
    return (F.when(x.isNull(), F.lit(None)).when(x < 0.001, "***").when(x < 0.01, "**")
            .when(x < 0.05, "*").otherwise("ns"))


def union_all(dfs: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """U01/U02 helper: stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


__all__ = [n for n in dir() if not n.startswith("_") and n not in (
    "annotations", "Sequence", "reduce", "Column", "DataFrame", "Window", "F", "T")]
