"""Ranking and report tables.

Metric tables hold one row per model, so the unpartitioned windows below run
over a handful of rows by construction."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flankwear.functions.scalar import short_name
from flankwear.operators.evaluate import regression_metrics

# Medal names for the top three.
MEDALS = ["gold", "silver", "bronze"]
ERROR_METRICS = ["mae", "rmse", "mae_std", "rmse_std"]


def ok_only(metrics: DataFrame) -> DataFrame:
    """P07."""
    return metrics.where(F.col("status") == "ok") if "status" in metrics.columns else metrics


def rank_models(metrics: DataFrame, metric: str) -> DataFrame:
    """1-based rank by the main metric, descending, ties by model name."""
    w = Window.orderBy(F.desc_nulls_last(metric), "model")
    return ok_only(metrics).withColumn("rank", F.row_number().over(w))


def leaderboard(metrics: DataFrame, metric: str) -> DataFrame:
    """Ranked models with a medal tag for the top three and the short name."""
    r = rank_models(metrics, metric)
    medal = F.when(F.col("rank") == 1, MEDALS[0]).when(F.col("rank") == 2, MEDALS[1]) \
        .when(F.col("rank") == 3, MEDALS[2])
    return r.withColumn("medal", medal).withColumn("short_name", short_name("model"))


def best_per_group(df: DataFrame, group: str, metric: str, item: str = "model") -> DataFrame:
    """Arg-max of ``metric`` per group (partial aggregation; ties to the smaller item)."""
    return df.groupBy(group).agg(F.min_by(F.col(item), F.struct(-F.col(metric), F.col(item))).alias(f"best_{item}"),
                                 F.max(metric).alias(f"best_{metric}"))


def radar_scores(metrics: DataFrame, cols: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """W08 + R02: min-max normalised score per metric (inverted for errors), long form."""
    long = metrics.select("model", *cols).unpivot(["model"], list(cols), "metric", "value")
    w = Window.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    s = (F.col("value") - lo) / (hi - lo + F.lit(eps))
    inv = F.col("metric").isin(ERROR_METRICS)
    return long.withColumn("score", F.when(inv, 1 - s).otherwise(s))


def score_vs_time(metrics: DataFrame, metric: str) -> DataFrame:
    """R03."""
    return metrics.select("model", metric, "fit_time_s")


def predicted_vs_actual(oof: DataFrame, task: str) -> DataFrame:
    """OOF rows with the model's pooled score beside them."""
    if task == "regression":
        s = regression_metrics(oof).select("model", "mae", "r2")
    else:
        s = oof.groupBy("model").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return oof.join(s, "model")  # one row per model


def per_group_errors(oof: DataFrame, group: str = "fold") -> DataFrame:
    """MAE / RMSE / R² per held-out group (leave-one-tool-out table)."""
    return regression_metrics(oof, ["model", group])


def wear_curve(oof: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Predicted and actual wear along passes with the end-of-life flag."""
    return oof.select("model", "tool", "passe", "y_true", "y_pred",
                      (F.col("y_true") >= threshold).alias("actual_eol"),
                      (F.col("y_pred") >= threshold).alias("predicted_eol"))


def top_k(df: DataFrame, k: int, by: str, name: str = "feature", absolute: bool = True) -> DataFrame:
    """Top ``k`` by (absolute) value, sign kept, ties by name."""
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(F.desc(key), name).limit(k)


def extremes(df: DataFrame, k: int, by: str = "r", name: str = "feature") -> DataFrame:
    """The ``k`` most positive and the ``k`` most negative values."""
    pos = df.where(F.col(by) > 0).orderBy(F.desc(by), name).limit(k).withColumn("side", F.lit("positive"))
    neg = df.where(F.col(by) < 0).orderBy(F.asc(by), name).limit(k).withColumn("side", F.lit("negative"))
    return pos.unionByName(neg)


def sort_metric(metrics: DataFrame, metric: str) -> DataFrame:
    """Ascending for error metrics, descending otherwise."""
    asc = metric in ERROR_METRICS
    return metrics.orderBy(F.col(metric).asc() if asc else F.col(metric).desc(), "model")


def error_table(oof_wide: DataFrame, source: DataFrame, outputs: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Absolute error of every output beside the source row, worst first."""
    j = source.join(oof_wide, row_id)
    for o in outputs:
        j = j.withColumn(f"abs_err_{o}", F.abs(F.col(f"{o}_true") - F.col(f"{o}_pred")))
    return j.orderBy(*[F.desc(f"abs_err_{o}") for o in outputs], row_id)


def importance_by_sensor(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Importance summed per sensor (name prefix before the first underscore)."""
    return imp.groupBy(F.regexp_extract(feature, r"^([^_]+)_", 1).alias("sensor")).agg(F.sum(value).alias(value))


def feature_counts(names: DataFrame, feature: str = "feature") -> DataFrame:
    """Number of features per kind (frequency domain by name pattern, else time domain)."""
    kind = F.when(F.col(feature).rlike("band_|tpf_"), "frequency").otherwise("time")
    return names.groupBy(kind.alias("kind")).agg(F.count_distinct(feature).alias("n_features"))
