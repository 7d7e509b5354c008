"""The five analysis steps as plain functions over DataFrames.

profile -> features -> balance -> benchmark -> report.  Each step reads the
previous step's stage table and writes its own under ``out``, so resuming at
step n is reading step n-1's table.
"""
from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwear.functions.scalar import label_mapping
from flankwear.operators import balance as ba
from flankwear.operators import evaluate as ev
from flankwear.operators import kernel
from flankwear.operators import models as mo
from flankwear.operators import profile as pr
from flankwear.operators import report as rp
from flankwear.operators import signal_stats as ss
from flankwear.operators import trees
from flankwear.operators import wear as wr
from flankwear.sources import files as fs
from flankwear.session import write_stage
from flankwear.sources import sinks as sk

DEFAULT_MODELS = ("logistic_regression", "decision_tree", "random_forest", "knn")


def _p(out: str, name: str) -> str:
    return os.path.join(out, name)


def step_profile(spark: SparkSession, path: str, out: str, target: str | None = None) -> str:
    """Step 1: classify the source and profile it; returns the source kind."""
    kind = "table" if path.endswith(".parquet") else fs.probe_source(spark, path)
    if kind == "raw_signals":
        sig = fs.with_pass_key(fs.read_signals(spark, path))
        wear = wr.wear_table(fs.read_wear(spark, path))
        prof = pr.profile_signals(wr.wear_inventory(wear), wr.pass_inventory(sig))
    else:
        kind = "table"
        prof = pr.profile_table(fs.read_table(spark, path), target=target)
    sk.write_profile(prof.withColumn("kind", F.lit(kind)).withColumn("written_at", F.current_timestamp().cast("string")),
                     _p(out, "profile"), "profile")
    return kind


def step_features(spark: SparkSession, path: str, out: str, kind: str, target: str | None = None) -> DataFrame:
    """Step 2: pass features + wear labels (raw signals), or the table's recommended features (step 1's profile:
    neither meta nor leaky), complete cases only."""
    if kind == "raw_signals":
        sig = fs.with_pass_key(fs.read_signals(spark, path)).select("tool", "passe", "channel", "i", "x")
        feats = ss.extract_pass_features(sig)
        lab = wr.label_passes(feats, wr.wear_table(fs.read_wear(spark, path)), how="left")
        table = lab.where(F.col("etat") != "inconnu")  # unlabeled passes stay out of training (Q6)
        y = "etat"
        cols = [c for c in table.columns if c not in ("tool", "passe", "vb_mean", "etat")]
    else:
        df = fs.read_table(spark, path)
        prof = latest_profile(spark, out)
        y = target or prof["target_column"]
        cols = pr.select_features(df, prof["meta_columns"] or [], prof["features_leaky"] or [], y, prof["features_recommended"])
        table = pr.complete_cases(df, [*cols, y])
    # ids are unique, also of equal rows, and fixed by being written
    table = table.withColumn("row_id", F.monotonically_increasing_id())
    table = table.select("row_id", F.col(y).cast("string").alias("y"), *cols)
    sk.write_features(table, _p(out, "features"), partition_by=None)
    return spark.read.parquet(_p(out, "features"))


def step_balance(spark: SparkSession, feats: DataFrame, out: str) -> DataFrame:
    """Step 3: strategy and balanced class weights (resampling happens inside folds, Q10)."""
    w = ba.class_weights(feats, "y").select("class", "weight")
    strat = ba.strategy_table(feats, "y")
    sk.write_balanced(w, _p(out, "class_weights"))
    strat.write.mode("overwrite").json(_p(out, "strategy"))
    return w


#: Models that ``trees`` and ``kernel`` train, kernel, random cuts, missing directions and coupled classes included.
OWN = ("extra_trees", "gradient_boosting", "hist_gradient_boosting", "svm")


def _grid(models: Sequence[str], task: str, n_features: int, n_classes: int | None, weight_col: str | None, k: int,
          train: dict[int, DataFrame] | None = None) -> dict:
    def maker(name: str):
        if name == "knn":                # scaled on each training fold, like the other distance-based models
            return lambda df: mo.knn_oof_scaled(df, 5, range(k), task, train=train)
        if name in OWN:                  # learners of this library: all folds in lockstep
            def whole(df: DataFrame) -> DataFrame:
                out = (kernel.oof(df, range(k), n_classes, weight_col, train) if name == "svm"
                       else trees.oof(name, df, range(k), n_classes, weight_col, train))
                return out.select("model", "row_id", "fold", "y_true", "y_pred")
            whole.whole = True
            return whole
        if name == "mlp":                # Spark's network takes no weights
            return lambda: mo.make_model(name, task, n_features=n_features, n_classes=n_classes, scale=True)
        return lambda n_rows, sigma_y: mo.make_model(name, task, n_features=n_features, n_classes=n_classes, weight_col=weight_col,
                                                     n_rows=n_rows, sigma_y=sigma_y, scale=True)
    return {name: maker(name) for name in models}


def step_benchmark(spark: SparkSession, feats: DataFrame, out: str, cv: int = 5, models: Sequence[str] = DEFAULT_MODELS,
                   task: str = "classification") -> tuple[DataFrame, DataFrame]:
    """Step 4: encode, fold, fit every model once per fold with its scaling inside the fold and, in a classification,
    by step 3's strategy: training folds oversampled (smote), class weights or neither; keep the OOF table; metrics are means and deviations of the folds' scores."""
    cols = [c for c in feats.columns if c not in ("row_id", "y")]
    weight_col, n_classes, strategy = None, None, "none"
    if task == "classification":
        mapping = label_mapping(feats, "y")
        n_classes = mapping.count()
        enc = feats.join(mapping.withColumnRenamed("label", "y"), "y")
        strategy = spark.read.json(_p(out, "strategy")).first()["strategy"]
        if strategy == "class_weight":
            enc = ba.with_weights(enc, "y", spark.read.parquet(_p(out, "class_weights")))
            weight_col = "weight"
        k = ba.n_splits(enc, "y", cv).first()[0]
        enc = ba.stratified_folds(enc, "y", k).withColumn("label", F.col("label_idx").cast("double"))
    else:
        enc = feats.withColumn("label", F.expr("try_cast(y AS double)")).where("label IS NOT NULL")
        k = ba.n_splits(enc, None, cv).first()[0]
        enc = ba.kfolds(enc, k)
    enc = mo.assemble(enc, cols).withColumn("vec", F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    # read k x models times by the fits: written once (rule R6), not recomputed per fit
    enc = write_stage(enc)
    train = mo.smote_folds(enc, range(k)) if strategy == "smote" else None
    oof, status = mo.benchmark(enc, _grid(models, task, len(cols), n_classes, weight_col, k, train), range(k), task, train=train)
    oof = oof.select("model", "row_id", "fold", "y_true", "y_pred")
    if task == "classification":
        oof = oof.withColumns({c: F.col(c).cast("int").cast("string") for c in ("y_true", "y_pred")})
    metrics = ev.fold_summary(oof, task).join(mo.status_table(spark, status), "model", "right")
    sk.write_results(oof, metrics, spark.createDataFrame([(json.dumps({"cv": k, "task": task}),)], "meta string"),
                     _p(out, "results"))
    return oof, metrics


def step_report(spark: SparkSession, oof: DataFrame, metrics: DataFrame, out: str, task: str = "classification") -> None:
    """Step 5: leaderboard, radar and (classification) confusion or (regression) residual tables."""
    cls = task == "classification"
    rp.leaderboard(metrics, "f1_macro" if cls else "r2").write.mode("overwrite").parquet(_p(out, "leaderboard"))
    rp.radar_scores(rp.ok_only(metrics), ["accuracy", "balanced_accuracy", "f1_macro"] if cls else ["r2", "mae", "rmse"]) \
        .write.mode("overwrite").parquet(_p(out, "radar"))
    if cls:
        ev.confusion_matrix(oof).write.mode("overwrite").parquet(_p(out, "confusion"))
    else:
        ev.residual_rmse(oof).write.mode("overwrite").parquet(_p(out, "residuals"))


def latest_profile(spark: SparkSession, out: str):
    """The profile document written last (profiles are appended, one per run)."""
    return spark.read.json(_p(out, "profile")).orderBy(F.desc("written_at")).first()


def run(spark: SparkSession, path: str, out: str, cv: int = 5, target: str | None = None,
        models: Sequence[str] = DEFAULT_MODELS, from_step: int = 1) -> None:
    """Run steps ``from_step``..5; earlier steps are read back from ``out``."""
    kind = step_profile(spark, path, out, target) if from_step <= 1 else latest_profile(spark, out)["kind"]
    task = "classification" if kind == "raw_signals" else latest_profile(spark, out)["task"]
    feats = step_features(spark, path, out, kind, target) if from_step <= 2 else spark.read.parquet(_p(out, "features"))
    if from_step <= 3 and task == "classification":
        step_balance(spark, feats, out)
    if from_step <= 4:
        oof, metrics = step_benchmark(spark, feats, out, cv, models, task)
    else:
        oof = spark.read.parquet(_p(out, "results", ) + "/oof")
        metrics = spark.read.parquet(_p(out, "results") + "/metrics")
    step_report(spark, oof, metrics, out, task)
