"""Metrics from an out-of-fold prediction table.

OOF schema: ``model, row_id, fold, y_true, y_pred``.  Every metric is a
grouped aggregation over it (per class counts are tiny), so models and
metrics are added without refitting anything.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.functions.scalar import rel_deviation
from flankwear.operators.stats import box_stats


def _by(by):
    return list(by)


def accuracy(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """E01."""
    return oof.groupBy(*_by(by)).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def class_counts(oof: DataFrame, by: Sequence[str] = ("model",), rows: str | None = None) -> DataFrame:
    """tp / fp / fn / support per class (classes from y_true ∪ y_pred), one shuffle of a tiny table.  ``rows`` has the number
    of predictions that a row stands for."""
    by = _by(by)
    c = oof.groupBy(*by, "y_true", "y_pred").agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_c"))
    t = c.groupBy(*by, F.col("y_true").alias("cls")).agg(F.sum("_c").alias("support"),
                                                          F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("_c"))).alias("tp"))
    p = c.groupBy(*by, F.col("y_pred").alias("cls")).agg(F.sum("_c").alias("predicted"))
    j = t.join(p, [*by, "cls"], "full_outer").na.fill(0, ["support", "tp", "predicted"])
    return j.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))


def per_class_report(oof: DataFrame, by: Sequence[str] = ("model",), rows: str | None = None) -> DataFrame:
    """E14 rows: precision, recall, F1 (0 when undefined) and support per class."""
    c = class_counts(oof, by, rows)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return c.select(*_by(by), "cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support")


def f1_weighted(oof: DataFrame, by: Sequence[str] = ("model",), rows: str | None = None) -> DataFrame:
    """E04 alone."""
    r = per_class_report(oof, by, rows)
    return r.groupBy(*_by(by)).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def classification_metrics(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, balanced accuracy, F1 macro, F1 weighted."""
    by = _by(by)
    r = per_class_report(oof, by)
    m = r.groupBy(*by).agg(
        (F.sum(F.when(F.col("support") > 0, F.col("recall"))) / F.count(F.when(F.col("support") > 0, 1))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("_pw"))
    return accuracy(oof, by).join(m, by).drop("_pw")


def classification_report(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per-class rows plus ``macro avg`` and ``weighted avg`` rows."""
    by = _by(by)
    r = per_class_report(oof, by)
    macro = r.groupBy(*by).agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                               F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    wavg = r.groupBy(*by).agg(F.lit("weighted avg").alias("cls"),
                              *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                                for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return r.unionByName(macro).unionByName(wavg)


def regression_metrics(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, R² (1 − SSE/SST) and explained variance, one aggregation.
    A constant target has R² and explained variance 1 where it is met exactly, else 0."""
    e = F.col("y_true") - F.col("y_pred")
    g = oof.groupBy(*_by(by)).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                  F.sum(e * e).alias("_sse"), F.var_pop("y_true").alias("_vy"),
                                  F.count(F.lit(1)).alias("_n"), F.var_pop(e).alias("_ve"))
    def share(rest, whole):
        return F.when(whole == 0, (rest == 0).cast("double")).otherwise(1 - F.try_divide(rest, whole))

    return g.select(*_by(by), "mae", "rmse", share(F.col("_sse"), F.col("_vy") * F.col("_n")).alias("r2"),
                    share(F.col("_ve"), F.col("_vy")).alias("explained_variance"))


def fold_summary(oof: DataFrame, task: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population std over folds of the per-fold metrics."""
    by = _by(by)
    per = (classification_metrics(oof, [*by, "fold"]) if task == "classification"
           else regression_metrics(oof, [*by, "fold"]))
    ms = [c for c in per.columns if c not in (*by, "fold")]
    return per.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ms], *[F.stddev_pop(m).alias(f"{m}_std") for m in ms])


def deviation_metrics(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Total deviation %, mean relative deviation %, MAE relative to mean %."""
    return oof.groupBy(*_by(by)).agg(
        ((F.try_divide(F.sum("y_true"), F.sum("y_pred")) - 1) * 100).alias("total_dev_pct"),
        (F.avg(F.abs(rel_deviation("y_true", "y_pred"))) * 100).alias("mean_rel_dev_pct"),
        (F.try_divide(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), F.avg("y_true")) * 100).alias("mae_rel_pct"))


def confusion_matrix(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts for every (true, predicted) class pair, zero filled.  The class
    list is collected per model (bounded by the number of classes) and exploded."""
    by = _by(by)
    c = oof.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    classes = (oof.select(*by, F.col("y_true").alias("c")).unionByName(oof.select(*by, F.col("y_pred").alias("c")))
               .groupBy(*by).agg(F.collect_set("c").alias("_cs")))
    grid = (classes.select(*by, F.explode("_cs").alias("y_true"), "_cs")
            .select(*by, "y_true", F.explode("_cs").alias("y_pred")))
    return grid.join(c, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def residuals(oof: DataFrame) -> DataFrame:
    """E15 rows: y − ŷ per prediction."""
    return oof.select("model", "row_id", "fold", (F.col("y_true") - F.col("y_pred")).alias("residual"))


def residual_rmse(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """E15 summary."""
    e = F.col("y_true") - F.col("y_pred")
    return oof.groupBy(*_by(by)).agg(F.sqrt(F.avg(e * e)).alias("residual_rmse"), F.avg(e).alias("mean_residual"))


def error_distribution(oof: DataFrame, task: str) -> DataFrame:
    """Box statistics of |error| (regression) or the 0/1 miss (classification) per model."""
    err = (F.abs(F.col("y_true") - F.col("y_pred")) if task == "regression"
           else (F.col("y_true") != F.col("y_pred")).cast("double"))
    return box_stats(oof.withColumn("error", err), "error", ["model"])
