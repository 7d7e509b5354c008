"""Queries: scaling, imputation, nearest neighbours, SMOTE and model OOF tables
(M01, M11, M12, M14, M19, J09, J10, B03, V05, V07, E17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.operators import balance as ba
from flankwear.operators import models as mo
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.q_profile import PROF_SQL, prof
from flankwear.plans.sqlgen import present, r, with_ctes


@register("m01_standard_scale", """SELECT l_orderkey, l_linenumber, l_partkey, """ + ", ".join(
    r(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END", f"{c}_z")
    for c in ("l_quantity", "l_discount")) + " FROM lineitem")
def q_m01(spark, d):
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return present(mo.standard_scale(li, ["l_quantity", "l_discount"]).drop("l_quantity", "l_discount"))


@register("m19_impute_median", with_ctes(PROF_SQL) + """, med AS (SELECT quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt FROM prof)
SELECT l_returnflag, """ + r("sum(coalesce(l_discount, md))", "s_discount") + ", " + r("sum(coalesce(l_tax, mt))", "s_tax")
          + ", count(*) AS n FROM prof, med GROUP BY 1")
def q_m19(spark, d):
    p = mo.impute_median(prof(spark, d), ["l_discount", "l_tax"])
    return present(p.groupBy("l_returnflag").agg(F.sum("l_discount").alias("s_discount"), F.sum("l_tax").alias("s_tax"),
                                                 F.count(F.lit(1)).alias("n")))


def emb(spark, d):
    e = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"),
                                               F.col("label").cast("double").alias("label"))
    return ba.kfolds(e, 5, 42)


KNN_SQL = """f AS (SELECT vec_id, label, CAST((row_number() OVER (ORDER BY md5('42|' || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold
       FROM embeddings),
dims AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS j FROM embeddings),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS rr, sum((a.v - b.v) * (a.v - b.v)) AS d2
          FROM dims a JOIN dims b ON a.j = b.j JOIN f fa ON fa.vec_id = a.vec_id JOIN f fb ON fb.vec_id = b.vec_id
          WHERE fa.fold <> fb.fold GROUP BY 1, 2),
nn AS (SELECT q, rr, row_number() OVER (PARTITION BY q ORDER BY d2, rr) AS rk FROM pairs QUALIFY rk <= 5),
lab AS (SELECT q, f.label AS y FROM nn JOIN f ON f.vec_id = nn.rr)"""


@register("m11_j10_knn_classifier", with_ctes(KNN_SQL) + """, votes AS (SELECT q, y, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT 'knn' AS model, v.q AS row_id, f.fold, CAST(f.label AS DOUBLE) AS y_true, CAST(arg_min(v.y, (-v.n, v.y)) AS DOUBLE) AS y_pred
FROM votes v JOIN f ON f.vec_id = v.q GROUP BY v.q, f.fold, f.label""")
def q_m11(spark, d):
    return mo.knn_oof(emb(spark, d), 5, "classification")


@register("m12_knn_regressor", with_ctes(KNN_SQL) + """SELECT 'knn' AS model, l.q AS row_id, f.fold, CAST(f.label AS DOUBLE) AS y_true, """
          + r("avg(l.y)", "y_pred") + " FROM lab l JOIN f ON f.vec_id = l.q GROUP BY l.q, f.fold, f.label")
def q_m12(spark, d):
    return present(mo.knn_oof(emb(spark, d), 5, "regression"))


@register("b03_j09_smote")
def q_b03(spark, d):
    e = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label",
                                               F.col("embedding").cast("array<double>").alias("vec"))
    return mo.smote(e, "label", "vec", "row_id", k=5, seed=42)


CLASS_NN_SQL = """dims AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS j FROM embeddings),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS rid, a.label, sum((a.v - b.v) * (a.v - b.v)) AS dist2
          FROM dims a JOIN dims b ON a.j = b.j AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
nn AS (SELECT q, rid, label, dist2, row_number() OVER (PARTITION BY q ORDER BY dist2, rid) AS rank FROM pairs QUALIFY rank <= 5)"""


@register("j09_class_neighbours", with_ctes(CLASS_NN_SQL) + "SELECT q AS row_id, CAST(rank AS INTEGER) AS rank, rid, " + r("dist2", "dist2") + " FROM nn")
def q_j09(spark, d):
    """The five nearest vectors of every vector's own class."""
    e = b.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    nn = mo.knn(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "rid"), 5, within="label", exclude_self=True)
    return present(nn.select(F.col("qid").alias("row_id"), F.col("rank").cast("int").alias("rank"), "rid", "dist2"))


@register("b03_smote_points", with_ctes(CLASS_NN_SQL) + """, sized AS (
  SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS nc,
         row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(vec_id AS VARCHAR))) - 1 AS p FROM embeddings),
want AS (SELECT vec_id, unnest(generate_series(0, CAST(ceil((max(nc) OVER () - nc - p) / nc) AS BIGINT) - 1)) AS copy FROM sized),
kk AS (SELECT q, count(*) AS k FROM nn GROUP BY q),
drawn AS (SELECT vec_id, copy, k, md5('42|' || CAST(vec_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS h FROM want JOIN kk ON kk.q = vec_id),
pick AS (SELECT vec_id, copy, CAST(floor(('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0 * k) + 1 AS INTEGER) AS rank,
         ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 AS lam FROM drawn),
syn AS (SELECT pick.vec_id, copy, a.label, a.j, a.v + lam * (n.v - a.v) AS v FROM pick JOIN nn ON nn.q = pick.vec_id AND nn.rank = pick.rank
        JOIN dims a ON a.vec_id = pick.vec_id JOIN dims n ON n.vec_id = nn.rid AND n.j = a.j),
points AS (SELECT label, true AS is_synthetic, vec_id, copy, j, v FROM syn UNION ALL SELECT label, false, vec_id, -1, j, v FROM dims)
SELECT label, is_synthetic, """ + ", ".join([r("max(CASE WHEN j = 1 THEN v END)", "first"), r("sum(v * v)", "square"), r("sum(v * j)", "moment")])
          + " FROM points GROUP BY label, is_synthetic, vec_id, copy")
def q_b03_points(spark, d):
    """Every original and synthetic point by its first component, squared length and first moment over its components."""
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return present(q_b03(spark, d).select("label", "is_synthetic", F.get("vec", F.lit(0)).alias("first"), total(F.transform("vec", lambda x: x * x)).alias("square"),
                                          total(F.transform("vec", lambda x, i: x * (i + 1))).alias("moment")))


def _ml_table(spark, d):
    from pyspark.ml.functions import array_to_vector
    return emb(spark, d).withColumn("features", array_to_vector("vec"))


@register("v05_m14_logistic_oof")
def q_v05(spark, d):
    t = _ml_table(spark, d)
    return mo.oof_predict(t, lambda n_rows, sigma_y: mo.make_model("logistic_regression", "classification", n_rows=n_rows, scale=True),
                          range(5), "logistic_regression")


@register("v05_m15_ridge_oof")
def q_v05r(spark, d):
    t = _ml_table(spark, d)
    return mo.oof_predict(t, lambda n_rows, sigma_y: mo.make_model("ridge", "regression", n_rows=n_rows, sigma_y=sigma_y, scale=True),
                          range(5), "ridge")


def _linear_sql(alpha: float) -> str:
    """Two-feature least squares with an L2 penalty, fitted on the other folds' centred sums."""
    return f"""WITH f AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS DOUBLE) AS a, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b, o_totalprice AS y,
    CAST((row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM orders),
s AS (SELECT k.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + {alpha} AS aa, var_pop(b) * count(*) + {alpha} AS bb,
      covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bo
      FROM (SELECT unnest(generate_series(0, 4)) AS fold) k JOIN f ON f.fold <> k.fold GROUP BY k.fold)
SELECT row_id, f.fold, """ + r("y", "y_true") + ", " + r(
        "my + (ay * bb - bo * ab) / (aa * bb - ab * ab) * (a - ma) + (bo * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb)", "y_pred") + " FROM f JOIN s USING (fold)"


def _linear_oof(spark, d, make, name):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("double").alias("a"),
                                           F.substring("o_orderpriority", 1, 1).cast("double").alias("b"), F.col("o_totalprice").alias("label"))
    t = mo.assemble(ba.kfolds(o, 5, 42), ["a", "b"])
    return present(mo.oof_predict(t, make, range(5), name).select("row_id", "fold", "y_true", "y_pred"))


@register("v05_m16_linear_regression_orders", _linear_sql(0.0))
def q_m16_orders(spark, d):
    """Order totals from customer key and priority, out of fold."""
    return _linear_oof(spark, d, lambda: mo.make_model("linear_regression", "regression"), "linear_regression")


@register("v05_m15_ridge_orders", _linear_sql(1.0))
def q_m15_orders(spark, d):
    return _linear_oof(spark, d, lambda n_rows, sigma_y: mo.make_model("ridge", "regression", n_rows=n_rows, sigma_y=sigma_y), "ridge")


@register("v05_m09_svc_oof")
def q_v05s(spark, d):
    """Two classes: label 0 against the rest."""
    t = _ml_table(spark, d).withColumn("label", (F.col("label") == 0).cast("double"))
    return mo.oof_predict(t, lambda n_rows, sigma_y: mo.make_model("svm", "classification", n_rows=n_rows, scale=True), range(5), "svm")


@register("e19_permutation_importance")
def q_e19(spark, d):
    """Drop of the weighted F1 of a decision tree when a line item's column is permuted (target: return flag)."""
    from flankwear.functions import scalar as fx
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_returnflag",
                                              *[F.col(c).cast("double").alias(c) for c in cols])
    t = fx.label_encode(li, "l_returnflag", out="label").withColumn("label", F.col("label").cast("double"))
    tree = mo.make_model("decision_tree", "classification")
    m = mo.fit_tree(tree, t, cols)
    return mo.permutation_importance(m, t, cols, repeats=10)


@register("v05_m13_tree_oof")
def q_v05t(spark, d):
    t = _ml_table(spark, d)
    return mo.oof_predict(t, lambda: mo.make_model("decision_tree", "classification"), range(5), "decision_tree")


OOF_MODELS = ("bagging", "decision_tree", "extra_trees", "gradient_boosting", "hist_gradient_boosting", "knn", "linear_regression",
              "logistic_regression", "mlp", "random_forest", "ridge", "svm")


@register("v05_oof_tables", with_ctes(KNN_SQL) + f""", m AS (SELECT unnest({list(OOF_MODELS)}) AS model)
SELECT model, fold, count(*) AS n, count(DISTINCT vec_id) AS n_ids, sum(vec_id)::BIGINT AS id_sum, sum((label = 0)::INT)::DOUBLE AS y_sum,
       0 AS n_missing FROM f, m GROUP BY model, fold""")
def q_v05_tables(spark, d):
    """Every model predicts every row once, in the row's own fold (label 0 against the rest; small models)."""
    from flankwear.operators import kernel, trees
    t = _ml_table(spark, d).withColumn("label", (F.col("label") == 0).cast("double"))
    few = {"extra_trees": dict(n_trees=3), "gradient_boosting": dict(n_iter=1), "hist_gradient_boosting": dict(n_iter=1, max_leaves=4)}
    parts = [trees.oof(n, t, range(5), 2, **more) for n, more in few.items()] + [kernel.oof(t, range(5), 2, landmarks=20)]
    parts += [mo.oof_predict(t, lambda n=n: mo.make_model(n, "regression" if n == "linear_regression" else "classification"), range(5), n) for n in ("decision_tree", "linear_regression")]
    small = {"random_forest": dict(numTrees=3, maxDepth=5), "bagging": dict(numTrees=3, maxDepth=5), "mlp": dict(maxIter=5)}
    for n, less in small.items():
        est = mo.make_model(n, "classification", n_features=64)
        parts.append(mo.oof_predict(t, lambda est=est, less=less: est.copy({est.getParam(p): v for p, v in less.items()}), range(5), n))
    parts.append(mo.oof_predict(t, lambda n_rows, sigma_y: mo.make_model("logistic_regression", "classification", n_rows=n_rows, scale=True), range(5), "logistic_regression"))
    parts.append(mo.oof_predict(t, lambda n_rows, sigma_y: mo.make_model("ridge", "regression", n_rows=n_rows, sigma_y=sigma_y, scale=True), range(5), "ridge"))
    parts.append(mo.knn_oof(t, 5, "classification"))
    out = None
    for p in parts:
        p = p.select("model", "row_id", "fold", "y_true", "y_pred")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids"),
                                            F.sum("row_id").cast("bigint").alias("id_sum"), F.sum("y_true").alias("y_sum"),
                                            F.count(F.when(F.col("y_pred").isNull(), 1)).cast("int").alias("n_missing"))


@register("v07_e17_tree_importances")
def q_e17(spark, d):
    t = _ml_table(spark, d)
    tree = mo.make_model("decision_tree", "classification")
    m = tree.fit(mo.deal_to_trees(tree, t))
    return mo.feature_importances(spark, m, [f"dim_{i}" for i in range(m.numFeatures)])


@register("m18_multi_output_tree")
def q_m18(spark, d):
    """Five energy targets from command, program and feed stand-ins, out of fold; no target is a feature."""
    from flankwear.functions import scalar as fx
    from flankwear.session import write_stage
    li = b.table(spark, d, "lineitem")
    targets = {"E_x": "l_quantity", "E_y": "l_extendedprice", "E_z": "l_discount", "E_S": "l_tax", "E_T": "l_linenumber"}
    p = li.select(F.monotonically_increasing_id().alias("row_id"), F.col("l_returnflag").alias("Commands"),
                  (F.col("l_linestatus") == "F").cast("int").alias("is_F"), (F.col("l_suppkey") % 100).cast("double").alias("F_val"),
                  (F.col("l_partkey") % 100).cast("double").alias("delta_X"),
                  *[F.col(c).cast("double").alias(t) for t, c in targets.items()])
    # the ids are fixed by being written, before the folds are dealt
    p = write_stage(ba.kfolds(write_stage(fx.one_hot(p, "Commands", ["A", "N", "R"])), 3))
    feats = ["Commands_A", "Commands_N", "Commands_R", "is_F", "F_val", "delta_X"]
    return mo.multi_output_predict(p, feats, list(targets), lambda t: mo.make_model("decision_tree", "regression", label=t), folds=range(3))


@register("m20_source_feature", """SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_idx
FROM (SELECT DISTINCT 'phm' AS source FROM events UNION SELECT DISTINCT 'exp' FROM orders
      UNION SELECT DISTINCT 'turning' FROM lineitem)""")
def q_m20(spark, d):
    from flankwear.plans.q_fusion import fused
    f = fused(spark, d).select("source").distinct()
    return mo.with_source_feature(f).select("source", "source_idx")
