"""Multi-source fusion (A16, A30-A32, A35, A38, A39, J03, P01, P05, P06, P17,
U01-U05, F07-F09, F13).  Sources are unioned by name; the per-source
summaries are single grouped aggregations over the fused table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankwear.functions.scalar import energy_name, ensure_columns, union_all
from flankwear.operators.signal_stats import channel_stats, to_wide

# The six active machining phases.
ACTIVE_PHASES = ["Layer 1 Up", "Layer 1 Down", "Layer 2 Up", "Layer 2 Down", "Layer 3 Up", "Layer 3 Down"]
# Meta columns of the fused table and their types.
META = {"source": "string", "condition_exp": "string", "passe": "int", "vb_mm": "double",
        "tool_condition": "string"}
ROUGHNESS = ["Ra", "Rz", "Rsk", "Rku", "RSm", "Rt"]


def active_only(df: DataFrame, phase: str = "Machining_Process", phases: Sequence[str] = ACTIVE_PHASES) -> DataFrame:
    """P01."""
    return df.where(F.col(phase).isin(list(phases)))


def labeled_only(df: DataFrame, col: str = "tool_condition", labels=("worn", "unworn")) -> DataFrame:
    """P05."""
    return df.where(F.col(col).isin(list(labels)))


def subset(df: DataFrame, **eq) -> DataFrame:
    """Equality subset."""
    cond = F.lit(True)
    for k, v in eq.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def experiment_features(exp: DataFrame, signals: Sequence[str], key: str = "exp_id",
                        phase: str | None = "Machining_Process", phases: Sequence[str] = ACTIVE_PHASES) -> DataFrame:
    """The 13 statistics of each motor signal over active phases, per experiment."""
    e = active_only(exp, phase, phases) if phase else exp
    long = e.select(key, *signals).unpivot([key], list(signals), "channel", "x")
    return channel_stats(long, [key, "channel"])


def experiment_features_wide(exp: DataFrame, signals: Sequence[str], key: str = "exp_id", **kw) -> DataFrame:
    return to_wide(experiment_features(exp, signals, key, **kw), [key], signals)


def label_experiments(feats: DataFrame, labels: DataFrame, key: str = "exp_id", no: str = "No") -> DataFrame:
    """Experiments ⋈ labels on ``exp_id = No`` (labels: one row per experiment)."""
    return feats.join(labels.withColumnRenamed(no, key), key, "inner")


def experiment_lengths(exp: DataFrame, key: str = "exp_id") -> DataFrame:
    """A38."""
    return exp.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def phase_spans(exp: DataFrame, key: str = "exp_id", phase: str = "Machining_Process", i: str = "i") -> DataFrame:
    """First and last sample index per (experiment, phase)."""
    return exp.groupBy(key, phase).agg(F.min(i).alias("first_i"), F.max(i).alias("last_i"))


def stats_by_label(df: DataFrame, label: str, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean and sample std of key signals per label, rounded."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_samp(c), digits).alias(f"{c}_std")]
    return df.groupBy(label).agg(*aggs)


def rollup_runs(df: DataFrame, means: Sequence[str], firsts: Sequence[str], order: Sequence[str],
                key: Sequence[str] = ("Run_ID",)) -> DataFrame:
    """Per run the mean of measured columns and the first non-missing value
    of constant columns, "first" taken by a unique order key (partial aggregation)."""
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.avg(c).alias(c) for c in means]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in firsts]
    return df.groupBy(*key).agg(*aggs)


def program_energy(df: DataFrame, program: str, energies: Sequence[str]) -> DataFrame:
    """A31 + F09: sum / mean / sample std of each energy column per program."""
    aggs = []
    for c in energies:
        aggs += [F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0.0)).alias(energy_name(c, "sum")),
                 F.avg(F.col(f"`{c}`")).alias(energy_name(c, "mean")),
                 F.stddev_samp(F.col(f"`{c}`")).alias(energy_name(c, "std"))]
    return df.groupBy(program).agg(*aggs)


def fuse(*parts: DataFrame, meta: dict[str, str] = META) -> DataFrame:
    """Union by name; absent columns become NULL; meta columns first."""
    parts = [ensure_columns(p, meta) for p in parts]
    u = union_all(parts, allow_missing=True)
    rest = [c for c in u.columns if c not in meta]
    return u.select(*meta.keys(), *rest)


def availability(df: DataFrame, groups: dict[str, Sequence[str]], by: str = "source") -> DataFrame:
    """Share of rows per source where every column of a group is present."""
    aggs = []
    for g, cols in groups.items():
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(f"`{c}`").isNotNull()
        aggs.append(F.avg(ok.cast("int")).alias(g))
    long = df.groupBy(by).agg(*aggs)
    return long.unpivot([by], list(groups), "feature_group", "availability")


def non_empty_counts(df: DataFrame, by: str = "source", cols: Sequence[str] | None = None) -> DataFrame:
    """Non-NULL count of each numeric column per source, long form (one aggregation)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != by]
    g = df.groupBy(by).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    return g.unpivot([by], [f"`{c}`" for c in cols], "feature", "n")


def common_features(df: DataFrame, by: str = "source", min_sources: int = 2) -> DataFrame:
    """Numeric columns non-empty in at least ``min_sources`` sources."""
    n = non_empty_counts(df, by)
    return (n.groupBy("feature").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_sources"))
            .where(F.col("n_sources") >= min_sources))


def shared_columns(mapping: DataFrame, concept: str = "feature", dataset: str = "source") -> DataFrame:
    """Concepts present in all / some / one dataset(s)."""
    g = mapping.groupBy(concept).agg(F.sort_array(F.collect_set(dataset)).alias("datasets"),
                                     F.count_distinct(dataset).alias("n_datasets"))
    # the mapping is column metadata (concepts x datasets), so one window over it is small
    total = F.size(F.collect_set(dataset).over(Window.partitionBy()))
    g = g.join(mapping.select(concept, total.alias("_t")).distinct(), concept)
    return (g.withColumn("sharing", F.when(F.col("n_datasets") == F.col("_t"), "all")
                        .when(F.col("n_datasets") > 1, "several").otherwise("unique")).drop("_t"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` not in ``b`` (set difference)."""
    return a.subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both (set intersection)."""
    return a.intersect(b)

