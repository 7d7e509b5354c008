"""Queries: the benchmark model grid on the labeled pass-feature table
(M02-M10, M13, M15-M17 via V07 in-sample refits; R05 leave-one-tool-out).

Model outputs have no SQL twin, so these are rows-only checks; invariants
live in ``tests/``.  The table is the library's real use case: pass
features (A15) joined with wear (J02), one row per labeled pass.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import balance as ba
from flankwear.operators import evaluate as ev
from flankwear.operators import kernel, trees
from flankwear.operators import models as mo
from flankwear.operators import report as rp
from flankwear.operators import wear as wr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.q_signals import pass_features
from flankwear.session import write_stage


def ml_table(spark, d):
    """Labeled passes: features (NULL -> 0), vb_mean target, 3-state label index, binary worn label."""
    feats = pass_features(spark, d)
    lab = wr.label_passes(feats, wr.wear_table(b.raw_wear(spark, d)), how="inner", missing=None)
    cols = [c for c in feats.columns if c not in ("tool", "passe")]
    lab = fx.fill(lab, 0.0, cols)
    lab = fx.label_encode(lab, "etat", out="etat_idx").withColumn("label_cls", F.col("etat_idx").cast("double"))
    lab = lab.withColumn("label_bin", fx.binary_target(fx.worn_label("vb_mean")).cast("double"))
    lab = lab.withColumn("row_id", F.xxhash64("tool", "passe"))
    return write_stage(mo.assemble(lab, cols)), cols


def _refit(spark, d, name, task, label):
    t, cols = ml_table(spark, d)
    if name == "svm":
        # RBF kernel approximated by random Fourier features on standardised inputs
        z = mo.standard_scale(t.drop("features"), cols)
        t = write_stage(mo.rbf_features(z, [f"{c}_z" for c in cols], n=100)
                        .select("tool", "passe", "vb_mean", "label_cls", "label_bin", "features"))
    n_cls = t.select(label).distinct().count() if task == "classification" else None
    sigma = t.agg(F.stddev_pop(label)).first()[0] if name == "ridge" else None
    est = mo.make_model(name, task, label=label, n_features=len(cols), n_classes=n_cls, n_rows=t.count(),
                        sigma_y=sigma)
    p = mo.refit_predict(t, lambda: est, label)
    return p.select(F.lit(name).alias("model"), "tool", "passe", F.col(label).alias("y_true"),
                    F.col("prediction").alias("y_pred"), "in_sample")


REG = [("m03_random_forest_regressor", "random_forest"), ("m04_extra_trees_regressor", "extra_trees"),
       ("m06_gradient_boosting_regressor", "gradient_boosting"), ("m07_hist_gradient_boosting_regressor",
                                                                  "hist_gradient_boosting"),
       ("m08_bagging_regressor", "bagging"), ("m10_rbf_svr", "svm"), ("m13_decision_tree_regressor", "decision_tree"),
       ("m15_ridge", "ridge"), ("m16_linear_regression", "linear_regression")]
CLS = [("m02_random_forest_classifier", "random_forest", "label_cls"),
       ("m04_extra_trees_classifier", "extra_trees", "label_cls"),
       ("m05_gradient_boosting_classifier", "gradient_boosting", "label_bin"),
       ("m08_bagging_classifier", "bagging", "label_cls"), ("m09_rbf_svc", "svm", "label_cls"),
       ("m13_decision_tree_classifier", "decision_tree", "label_cls"),
       ("m17_mlp_classifier", "mlp", "label_cls")]

for qname, model in REG:
    register(f"v07_{qname}")(lambda spark, d, model=model: _refit(spark, d, model, "regression", "vb_mean"))
for qname, model, label in CLS:
    register(f"v07_{qname}")(lambda spark, d, model=model, label=label: _refit(spark, d, model, "classification", label))


def _oof(spark, d, name, task, **more):
    """Out-of-fold rows of a learner of this library on the labeled passes, three folds."""
    t, cols = ml_table(spark, d)
    label = "label_cls" if task == "classification" else "vb_mean"
    t = ba.kfolds(t.withColumn("vec", F.array(*[F.col(c).cast("double") for c in cols])), 3)
    n = t.select(label).distinct().count() if task == "classification" else None
    out = kernel.oof(t, range(3), n, label=label) if name == "svm" else trees.oof(name, t, range(3), n, label=label, **more)
    return out.select("model", "row_id", "fold", "y_true", "y_pred")


# The boosted learners run fewer rounds and the forests fewer trees than in the benchmark, all else alike.
for qname, model, task, more in [("m04_extra_trees_classifier", "extra_trees", "classification", dict(n_trees=30)),
                                 ("m04_extra_trees_regressor", "extra_trees", "regression", dict(n_trees=30)),
                                 ("m05_gradient_boosting_classifier", "gradient_boosting", "classification", dict(n_iter=10)),
                                 ("m06_gradient_boosting_regressor", "gradient_boosting", "regression", dict(n_iter=10)),
                                 ("m07_hist_gradient_boosting_regressor", "hist_gradient_boosting", "regression", dict(n_iter=5)),
                                 ("m09_rbf_svc", "svm", "classification", {}), ("m10_rbf_svr", "svm", "regression", {})]:
    register(f"v05_{qname}_oof")(lambda spark, d, model=model, task=task, more=more: _oof(spark, d, model, task, **more))


def _oof_estimator(spark, d, name, task, **less):
    """Out-of-fold rows of a pyspark.ml estimator of the grid on the labeled passes, three folds; ``less`` lowers its size."""
    t, cols = ml_table(spark, d)
    label = "label_cls" if task == "classification" else "vb_mean"
    n = t.select(label).distinct().count() if task == "classification" else None
    est = mo.make_model(name, task, label=label, n_features=len(cols), n_classes=n, scale=True)
    est = est.copy({est.getParam(p): v for p, v in less.items()})
    return mo.oof_predict(ba.kfolds(t, 3), lambda: est, range(3), name, label=label)


# 30 trees in place of 300 and 100, all else as in the grid.
for qname, model, task, more in [("m02_random_forest_classifier", "random_forest", "classification", dict(numTrees=30)),
                                 ("m03_random_forest_regressor", "random_forest", "regression", dict(numTrees=30)),
                                 ("m08_bagging_classifier", "bagging", "classification", dict(numTrees=30)),
                                 ("m08_bagging_regressor", "bagging", "regression", dict(numTrees=30)),
                                 ("m13_decision_tree_regressor", "decision_tree", "regression", {}),
                                 ("m16_linear_regression", "linear_regression", "regression", {}),
                                 ("m17_mlp_classifier", "mlp", "classification", {})]:
    register(f"v05_{qname}_oof")(lambda spark, d, model=model, task=task, more=more: _oof_estimator(spark, d, model, task, **more))


@register("r05_v03_leave_one_tool_out")
def q_r05_loto(spark, d):
    t, _ = ml_table(spark, d)
    t = ba.group_folds(t, "tool")
    n = t.select("fold").distinct().count()
    oof = mo.oof_predict(t, lambda: mo.make_model("decision_tree", "regression", label="vb_mean"), range(n),
                         "decision_tree", label="vb_mean")
    return rp.per_group_errors(oof.withColumn("fold", F.col("fold")), "fold").join(
        t.select("fold", "tool").distinct(), "fold")


@register("e20_e21_benchmark_status")
def q_e20(spark, d):
    t, _ = ml_table(spark, d)
    t = ba.kfolds(t, 3)
    grid = {"decision_tree": lambda: mo.make_model("decision_tree", "regression", label="vb_mean"),
            "broken_model": lambda: mo.make_model("no_such_model", "regression")}
    oof, status = mo.benchmark(t, grid, range(3), "regression", label="vb_mean")
    metrics = ev.regression_metrics(oof)
    return mo.status_table(spark, status).join(metrics, "model", "left").select("model", "status", "error", "mae",
                                                                               "rmse", "r2")


@register("e17_e18_forest_importance_spread")
def q_e18(spark, d):
    t, cols = ml_table(spark, d)
    m = mo.make_model("random_forest", "classification", label="label_cls").fit(t)
    spread = mo.importance_spread(spark, m, cols)
    return mo.feature_importances(spark, m, cols).join(spread, "feature")


@register("r03_score_vs_time")
def q_r03(spark, d):
    t, _ = ml_table(spark, d)
    t = ba.kfolds(t, 3)
    grid = {"decision_tree": lambda: mo.make_model("decision_tree", "regression", label="vb_mean"),
            "linear_regression": lambda: mo.make_model("linear_regression", "regression", label="vb_mean")}
    oof, status = mo.benchmark(t, grid, range(3), "regression", label="vb_mean")
    metrics = ev.regression_metrics(oof).join(mo.status_table(spark, status), "model")
    return rp.score_vs_time(metrics, "r2")
