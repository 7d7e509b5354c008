"""Dataset profiling.

Every profile statistic for many columns is ONE aggregation over the table
(``agg(f(c1), f(c2), …)``) followed by an unpivot of the one-row result, so a
profile costs a single scan regardless of column count.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankwear.operators.ordering import exact_quantiles

# Target keywords in priority order (exact lower-case match), then meta
# keywords (substring match), as used by the profiler.
TARGET_KEYWORDS = ["etat", "tcond", "tool_cond", "tool_state", "wear", "vbb", "vb_mean",
                   "usure", "flank", "toolwear", "condition", "label", "class", "target",
                   "output", "state", "status"]
META_KEYWORDS = ["condition", "outil", "tool", "id", "index", "passe", "pass",
                 "cut", "exp", "run", "trial", "sample", "timestamp", "time"]
# The fused table's label column matches none of the keywords above; it is accepted too (quirk Q8).
EXTRA_TARGETS = ["tool_condition"]
LEAKAGE_THRESHOLD = 0.98
IMBALANCE_MAJORITY = 0.70
ZERO_VARIANCE_STD = 1e-9
TASK_MAX_CLASSES = 15
TASK_DISTINCT_RATIO = 0.05


def _q(c: str):
    return F.col(f"`{c}`")


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns from the schema (no job)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows complete over ``cols``."""
    return df.na.drop("any", subset=list(cols))


def complete_case_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows before / after dropping incomplete rows, one scan."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & _q(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count(F.when(ok, 1)).alias("n_after")) \
        .withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def zero_variance(df: DataFrame, cols: Sequence[str], tol: float = ZERO_VARIANCE_STD) -> DataFrame:
    """Sample std per column; flag ``std < tol`` (all-NULL column -> NULL std, kept)."""
    one = df.agg(*[F.stddev_samp(_q(c)).alias(c) for c in cols])
    long = one.unpivot([], list(cols), "column", "std")
    return long.withColumn("zero_variance", F.coalesce(F.col("std") < tol, F.lit(False)))


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column: position, column, kind (string, integer, number, other) and, for integer columns, the
    distinct count (from a sketch of 2^12 cells, exact in effect at the small counts that decide).  One bounded aggregation."""
    def kind(t: T.DataType) -> str:
        return ("string" if isinstance(t, T.StringType) else "integer" if isinstance(t, T.IntegralType)
                else "number" if isinstance(t, T.NumericType) else "other")

    fields = [(i, f.name, kind(f.dataType)) for i, f in enumerate(df.schema.fields)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_q(n).cast("bigint"), 12)), F.lit(0)).alias(f"d{i}")
                                                 for i, n, k in fields if k == "integer"])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(k).alias("kind"),
                     (F.col(f"d{i}") if k == "integer" else F.lit(None).cast("bigint")).alias("n_distinct")) for i, n, k in fields]
    return one.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def detect_target(schema: T.StructType, keywords: Sequence[str] = TARGET_KEYWORDS,
                  target: str | None = None) -> str | None:
    """Explicit target, else the best column by (rule, order): a keyword's place in the list, then the last
    string column, then the last numeric one."""
    place = {k: i for i, k in reversed(list(enumerate([*keywords, *EXTRA_TARGETS])))}
    kinds = ((0, lambda i, f: place.get(f.name.lower())), (1, lambda i, f: -i if isinstance(f.dataType, T.StringType) else None),
             (2, lambda i, f: -i if isinstance(f.dataType, T.NumericType) else None))
    ranked = [(rule, order, f.name) for i, f in enumerate(schema.fields) for rule, of in kinds if (order := of(i, f)) is not None]
    return target or min(ranked, default=(0, 0, None))[2]


def meta_columns(df: DataFrame, target: str, keywords: Sequence[str] = META_KEYWORDS, max_int_distinct: int = 20) -> DataFrame:
    """P13 as a table: the facts of the columns that hold meta data (keyword in the name, text, or an integer with
    few distinct values), the target left out."""
    named = F.lower("column").rlike("|".join(keywords))
    few = (F.col("kind") == "integer") & (F.col("n_distinct") < max_int_distinct)
    return column_facts(df).where((F.col("column") != target) & (named | (F.col("kind") == "string") | few))


def detect_meta(df: DataFrame, target: str, keywords: Sequence[str] = META_KEYWORDS,
                max_int_distinct: int = 20) -> list[str]:
    """Names of the meta columns in table order (at most one per column of the schema)."""
    return [r["column"] for r in meta_columns(df, target, keywords, max_int_distinct).orderBy("position").collect()]


#: Distinct cells that a task keeps before it hands them on, and characters above which a text counts by its hash.
DISTINCT_CELLS, LONG_CELL = 500_000, 64


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column (i, n_distinct): exact distinct counts of all columns from one scan and one shuffle.

    No row is copied per column: a task reduces each batch column by column to its distinct values and keeps merging
    them up to ``DISTINCT_CELLS``; only distinct cells (column, value as text) are shuffled, dealt by column and value,
    so neither a common value nor a column of unique ones makes a task large.  NULL counts for nothing; -0.0 is 0.0."""
    def cell(c: str) -> Column:
        kind, v = df.schema[c].dataType, _q(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return v + F.lit(0.0).cast(kind)
        if isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.BooleanType)):
            return v
        text = F.to_json(v) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.hex(v) if isinstance(kind, T.BinaryType) else v.cast("string")
        return F.when(F.length(text) > LONG_CELL, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = [[] for _ in cols]

        def out() -> Iterator[pa.RecordBatch]:
            for i, parts in enumerate(held):
                if parts:
                    values = pa.concat_arrays(parts).unique().cast(pa.string())
                    yield pa.record_batch([pa.array(np.full(len(values), i, np.int32)), values], ["i", "v"])
                    parts.clear()

        size = 0
        for batch in batches:
            for i, c in enumerate(batch.columns):
                held[i].append(c.drop_null().unique())
                size += len(held[i][-1])
            if size > DISTINCT_CELLS:
                for i, parts in enumerate(held):
                    held[i] = [pa.concat_arrays(parts).unique()]
                size = sum(len(p[0]) for p in held)
                if size > DISTINCT_CELLS // 2:
                    yield from out()
                    size = 0
        yield from out()

    cells = df.select(*[cell(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "i int, v string")
    return cells.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"))


def _distinct_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``distinct_counts`` as one row of columns ``_d_<i>`` (0 where a column has no value)."""
    at = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("n_distinct"))), F.lit(0)).alias(f"_d_{i}") for i in range(len(cols))]
    return distinct_counts(df, cols).agg(*at)


def task_stats(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Distinct count and rows per candidate target, and the resulting task."""
    from flankwear.operators.stats import with_scalars
    types = {f.name: f.dataType for f in df.schema.fields}
    one = with_scalars(df.agg(F.count(F.lit(1)).alias("_n")), _distinct_of(df, targets))
    rows = []
    for i, t in enumerate(targets):
        is_str = isinstance(types[t], T.StringType)
        rows.append(F.struct(F.lit(t).alias("target"), F.col(f"_d_{i}").alias("n_distinct"),
                             F.col("_n").alias("n_rows"), F.lit(is_str).alias("_is_str")))
    long = one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    task = (F.when(F.col("_is_str"), "classification")
            .when((F.col("n_distinct") <= TASK_MAX_CLASSES)
                  | (F.col("n_distinct") / F.col("n_rows") < TASK_DISTINCT_RATIO), "classification")
            .otherwise("regression"))
    return long.withColumn("task", task).drop("_is_str")


def detect_roles(schema: T.StructType, roles: dict[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Role -> columns by exact name first, then substring."""
    roles = roles or {"params": ["ap", "vc", "f"], "forces": ["Fx", "Fy", "Fz", "F"],
                      "roughness": ["Ra"], "wear": ["VBB"], "condition": ["TCond", "Condition"]}
    names = [f.name for f in schema.fields]
    out = {}
    for role, pats in roles.items():
        exact = [n for n in names if n in pats]
        out[role] = exact or [n for n in names if any(p.lower() in n.lower() for p in pats)]
    return out


def corr_pair(df: DataFrame, a: str, b: str, min_rows: int = 5) -> DataFrame:
    """Pearson r over pairwise-complete rows; NULL under ``min_rows``."""
    both = _q(a).isNotNull() & _q(b).isNotNull()
    return df.agg(F.count(F.when(both, 1)).alias("n"),
                  F.corr(F.when(both, _q(a)), F.when(both, _q(b))).alias("r")) \
        .withColumn("r", F.when(F.col("n") >= min_rows, F.col("r")))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str, digits: int = 5) -> DataFrame:
    """|r| of every feature with the (numeric) target; one scan, unpivoted."""
    one = df.agg(*[F.corr(_q(c).cast("double"), _q(target).cast("double")).alias(c) for c in features])
    long = one.unpivot([], list(features), "feature", "r")
    return long.withColumn("abs_r", F.round(F.abs(F.col("r")), digits))


#: Columns of a block of the cross-product matrix, and partial blocks that one task merges.
GRAM_BLOCK, GRAM_FAN = 32, 512


def _merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows together: n, both means, both squared deviations, co-deviation per pair."""
    n = a[0] + b[0]
    w = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    k = a[0] * w
    return np.stack([n, a[1] + dx * w, a[2] + dy * w, a[3] + b[3] + dx * dx * k, a[4] + b[4] + dy * dy * k, a[5] + b[5] + dx * dy * k])


def _block_moments(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Moments of all column pairs of two blocks of rows, over the rows where both columns are present (masks)."""
    cx = np.divide(x.sum(0), mx.sum(0), out=np.zeros(x.shape[1]), where=mx.any(0))
    cy = np.divide(y.sum(0), my.sum(0), out=np.zeros(y.shape[1]), where=my.any(0))
    x, y = np.where(mx, x - cx, 0.0), np.where(my, y - cy, 0.0)
    fx, fy = mx.astype(float), my.astype(float)
    n = fx.T @ fy
    sx, sy = x.T @ fy, fx.T @ y
    d = np.where(n > 0, n, 1.0)
    return np.stack([n, cx[:, None] + sx / d, cy[None, :] + sy / d, (x * x).T @ fy - sx * sx / d, fx.T @ (y * y) - sy * sy / d,
                     x.T @ y - sx * sy / d])


def corr_matrix(df: DataFrame, cols: Sequence[str], lower_only: bool = True) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (a, b, r); triangle by column order.

    One scan: every task turns its rows into masked cross-products, one matrix product per batch and pair of column
    blocks, as moments around the batch's own means; blocks of tasks are merged in a tree of ``GRAM_FAN`` a task.
    The plan is the same for any number of columns; a task holds 6 numbers per pair of columns.  r is NULL where
    fewer than two complete rows are left or a column does not vary on them; NaN values make r NaN."""
    cols = list(cols)
    p = len(cols)
    cuts = range(0, p, GRAM_BLOCK)
    wanted = [(i, j) for i in cuts for j in cuts if j <= i or not lower_only]
    shape = lambda i, j: (6, min(GRAM_BLOCK, p - i), min(GRAM_BLOCK, p - j))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            mask = np.column_stack([~np.asarray(c.is_null()) for c in batch.columns])
            rows = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            for i, j in wanted:
                u, v = slice(i, i + GRAM_BLOCK), slice(j, j + GRAM_BLOCK)
                new = _block_moments(rows[:, u], mask[:, u], rows[:, v], mask[:, v])
                total[i, j] = _merge_moments(total[i, j], new) if (i, j) in total else new
        k = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([x[0] for x in total], pa.int32()), pa.array([x[1] for x in total], pa.int32()),
                               pa.array([k // GRAM_FAN] * len(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())],
                              ["i", "j", "part", "m"])

    def merged(pdf: pd.DataFrame, i: int, j: int) -> np.ndarray:
        out = None
        for raw in pdf["m"]:
            m = np.frombuffer(raw).reshape(shape(i, j))
            out = m if out is None else _merge_moments(out, m)
        return out

    def partly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "m": [merged(pdf, int(key[0]), int(key[1])).tobytes()]})

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = map(int, key)
        n, mx, my, xx, yy, xy = merged(pdf, i, j)
        flat = (n < 2) | (xx <= 1e-28 * n * mx * mx) | (yy <= 1e-28 * n * my * my)      # rounding of a constant's mean
        with np.errstate(invalid="ignore", divide="ignore"):
            r = xy / np.sqrt(xx * yy)
        out = [(cols[i + u], cols[j + v], None if flat[u, v] else float(min(1.0, max(-1.0, r[u, v]))))
               for u in range(r.shape[0]) for v in range(r.shape[1]) if j + v < i + u or not lower_only]
        return pd.DataFrame(out, columns=["a", "b", "r"]).astype({"r": object})

    values = df.select(*[_q(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    blocks = values.mapInArrow(products, "i int, j int, part int, m binary")
    blocks = blocks.groupBy("i", "j", "part").applyInPandas(partly, "i int, j int, m binary")
    return blocks.groupBy("i", "j").applyInPandas(finish, "a string, b string, r double")


def class_balance(df: DataFrame, y: str, majority: float = IMBALANCE_MAJORITY) -> DataFrame:
    """Per class count and share, plus majority share, imbalance flag and ratio."""
    c = df.groupBy(_q(y).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the (tiny) per-class table
    return (c.withColumn("total", F.sum("count").over(w))
            .withColumn("pct", F.col("count") / F.col("total") * 100.0)
            .withColumn("majority_pct", F.max("count").over(w) / F.col("total") * 100.0)
            .withColumn("is_imbalanced", F.col("majority_pct") > majority * 100.0)
            .withColumn("imbalance_ratio", F.max("count").over(w) / F.min("count").over(w))
            .withColumn("n_classes", F.count(F.lit(1)).over(w)))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A23."""
    d = df.where(_q(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def label_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-key counts."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column NULL count and percent, plus rows left after dropping
    incomplete rows -- one scan."""
    cols = list(cols or df.columns)
    ok = F.lit(True)
    for c in cols:
        ok = ok & _q(c).isNotNull()
    one = df.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(ok, 1)).alias("rows_after_dropna"),
                 *[F.count(F.when(_q(c).isNull(), 1)).alias(c) for c in cols])
    long = one.unpivot(["_n", "rows_after_dropna"], [f"`{c}`" for c in cols], "column", "n_null")
    return long.select("column", "n_null", (F.col("n_null") / F.col("_n") * 100.0).alias("pct_null"),
                       F.col("_n").alias("n_rows"), "rows_after_dropna")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group (NULLs compare equal).  Groups are rows' 128-bit hashes with
    the places of their NULLs, so 32 bytes a distinct row are shuffled whatever the table's width."""
    nulls = F.concat(*[F.when(_q(c).isNull(), "1").otherwise("0") for c in df.columns])
    cells = [F.to_json(_q(f.name)) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else _q(f.name) for f in df.schema.fields]
    keys = [F.xxhash64(nulls, *cells).alias("_h"), F.xxhash64(F.lit(2), *cells[::-1], nulls).alias("_g")]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return g.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n_duplicates"),
                 F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 %, max per column (long)."""
    long = df.select([_q(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "v")
    m = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"),
                                   F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                   F.max("v").alias("max"))
    q = exact_quantiles(long, ["column"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return m.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def column_catalog(df: DataFrame) -> DataFrame:
    """Type, non-null count, distinct count and smallest value (as text) per column."""
    cols = df.columns
    from flankwear.operators.stats import with_scalars
    one = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.min(_q(c)).cast("string").alias(f"e{i}") for i, c in enumerate(cols)])
    one = with_scalars(one, _distinct_of(df, cols))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"n{i}").alias("non_null"), F.col(f"_d_{i}").alias("n_distinct"),
                     F.col(f"e{i}").alias("example")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def leaky(corr: DataFrame, threshold: float = LEAKAGE_THRESHOLD) -> DataFrame:
    """Flag features whose |r| with the target reaches the threshold."""
    return corr.withColumn("leaky", F.coalesce(F.abs(F.col("r")) >= threshold, F.lit(False)))


def sparsest(df: DataFrame, k: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` columns with most NULLs (ties by name)."""
    return null_profile(df, cols).orderBy(F.desc("n_null"), "column").limit(k)


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows under an explicit total order."""
    return df.orderBy(*order).limit(n)


def profile_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """One-row dataset profile (target, task, meta / feature / leaky / recommended
    columns, correlations, quality counts) from five aggregations: the target's distinct
    values and its encoding, the integer columns' distinct counts, everything else about columns, and duplicates."""
    tgt = detect_target(df.schema, target=target)
    task = task_stats(df, [tgt]).first().task
    meta = detect_meta(df, tgt)
    feats = [c for c in numeric_cols(df, exclude=[tgt]) if c not in meta]
    y = F.col(f"`{tgt}`")
    enc = df
    if task == "classification":
        from flankwear.functions.scalar import label_encode
        enc = label_encode(df, tgt, out="_y")
        y = F.col("_y")
    else:
        enc = df.withColumn("_y", y.cast("double"))
    cols, complete = df.columns, F.lit(True)
    for c in cols:
        complete = complete & _q(c).isNotNull()
    # one look at the rows: correlations, missing values and complete rows
    one = enc.agg(*[F.abs(F.corr(_q(c).cast("double"), F.col("_y").cast("double"))).alias(f"_r{i}") for i, c in enumerate(feats)],
                  F.count(F.lit(1)).alias("n_rows"), F.count(F.when(complete, 1)).alias("rows_after_dropna"),
                  *[F.count(F.when(_q(c).isNull(), 1)).alias(f"_n{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"_r{i}").alias("r")) for i, c in enumerate(feats)]) if feats else None
    kind = "array<struct<f:string,r:double>>"
    pairs = pairs if pairs is not None else F.array().cast(kind)
    one = one.select("n_rows", "rows_after_dropna", sum((F.col(f"_n{i}") for i in range(len(cols))), F.lit(0)).cast("long").alias("total_nan"),
                     F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["f"], F.round(p["r"], 5)))).alias("correlations"),
                     F.transform(F.filter(pairs, lambda p: F.coalesce(p["r"] >= LEAKAGE_THRESHOLD, F.lit(False))), lambda p: p["f"]).alias("features_leaky"))
    from flankwear.operators.stats import with_scalars
    out = with_scalars(one, duplicate_count(df).select("n_duplicates"))
    return out.select(
        F.lit(tgt).alias("target_column"), F.lit(task).alias("task"),
        F.array(*[F.lit(m) for m in meta]).cast("array<string>").alias("meta_columns"),
        F.array(*[F.lit(f) for f in feats]).cast("array<string>").alias("features"),
        "features_leaky",
        F.array_except(F.array(*[F.lit(f) for f in feats]).cast("array<string>"), F.col("features_leaky"))
        .alias("features_recommended"),
        "correlations", "n_rows", F.lit(len(feats)).alias("n_features"), "total_nan",
        (F.col("total_nan") / (F.col("n_rows") * F.lit(max(len(df.columns), 1))) * 100).alias("nan_pct"),
        "n_duplicates", "rows_after_dropna")


def profile_signals(wear_inv: DataFrame, pass_inv: DataFrame, fs: float = 50_000) -> DataFrame:
    """Raw-signal profile per tool: wear inventory beside pass inventory and constants."""
    return (pass_inv.join(wear_inv.withColumnRenamed("n_passes", "n_wear_rows"), "tool", "full_outer")
            .withColumn("sampling_rate_hz", F.lit(float(fs))))


def select_features(df: DataFrame, meta: Sequence[str], leaky_cols: Sequence[str], target: str,
                    recommended: Sequence[str] | None = None) -> list[str]:
    """P10: recommended features if given, else every numeric column that is
    neither meta, leaky nor the target (schema only, no job)."""
    if recommended:
        return [c for c in recommended if c in df.columns]
    drop = set(meta) | set(leaky_cols) | {target}
    return [c for c in numeric_cols(df) if c not in drop]
