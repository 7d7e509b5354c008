"""Queries: tests, balance, folds, metrics and report tables
(A33, A34, T01, T02, W10, F21, B01, B02, B05, V01-V04, V06, E01-E16, W06-W08, O01-O04, O07, R01, R02, R04-R06, F10, A40)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import balance as ba
from flankwear.operators import evaluate as ev
from flankwear.operators import profile as pr
from flankwear.operators import report as rp
from flankwear.operators import stats as st
from flankwear.operators import wear as wr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.operators.ordering import neighbourhood, with_position
from flankwear.plans.sqlgen import present, r, with_ctes

C, R = b.OOF_CLASS_SQL, b.OOF_REG_SQL


# ------------------------------------------------------------------ distributions and tests
@register("a33_histogram", """WITH rng AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
                  FROM lineitem GROUP BY 1),
h AS (SELECT l.l_returnflag, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
             lo, hi FROM lineitem l JOIN rng USING (l_returnflag) WHERE l_extendedprice IS NOT NULL)
SELECT l_returnflag, bin, """ + r("lo + bin * (hi - lo) / 20", "bin_lo") + ", " + r("lo + (bin + 1) * (hi - lo) / 20", "bin_hi")
          + ", count(*) AS count FROM h GROUP BY l_returnflag, bin, lo, hi")
def q_a33(spark, d):
    return present(st.histogram(b.table(spark, d, "lineitem"), "l_extendedprice", 20, ["l_returnflag"]))


@register("a34_box_stats", """WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT l.l_returnflag, l.l_quantity AS v, q1, median, q3, q3 - q1 AS iqr FROM lineitem l JOIN q USING (l_returnflag))
SELECT l_returnflag, """ + ", ".join(r(c, c) for c in ("q1", "median", "q3", "iqr")) + """,
  """ + r("min(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END)", "whisker_lo") + """,
  """ + r("max(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END)", "whisker_hi") + """,
  """ + r("avg(v)", "mean") + """, count(*) AS n,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr)) AS n_outliers
FROM j GROUP BY l_returnflag, q1, median, q3, iqr""")
def q_a34(spark, d):
    return present(st.box_stats(b.table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))


@register("w10_avg_rank", """SELECT l_quantity, """ + r("rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0", "avg_rank")
          + ", count(*) OVER (PARTITION BY l_quantity) AS ties FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_quantity) = 1")
def q_w10(spark, d):
    return present(st.avg_rank(b.table(spark, d, "lineitem"), "l_quantity"))


def _kw_sql(col):
    return f"""SELECT '{col}' AS "column", k, n, H, p FROM (
  SELECT k, n, Hraw / (1 - T / (CAST(n AS DOUBLE) * n * n - n)) AS H, exp(-(Hraw / (1 - T / (CAST(n AS DOUBLE) * n * n - n))) / 2) AS p
  FROM (SELECT count(*) AS k, CAST(sum(n_g) AS BIGINT) AS n,
               12.0 / (sum(n_g) * (sum(n_g) + 1.0)) * sum(R * R / n_g) - 3 * (sum(n_g) + 1.0) AS Hraw
        FROM (SELECT g, sum(rk) AS R, count(*) AS n_g FROM (
                SELECT l_returnflag AS g, rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0 AS rk
                FROM lineitem WHERE {col} IS NOT NULL) GROUP BY g)),
       (SELECT sum(power(t, 3) - t) AS T FROM (SELECT count(*) AS t FROM lineitem WHERE {col} IS NOT NULL GROUP BY {col})))"""


KW_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("t01_f21_kruskal", "SELECT \"column\", k, n, " + r("H", "H") + ", " + r("p", "p") + """,
  CASE WHEN p IS NULL THEN NULL WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
FROM (""" + " UNION ALL ".join(_kw_sql(c) for c in KW_COLS) + ")")
def q_t01(spark, d):
    li = b.table(spark, d, "lineitem")
    return present(st.kruskal(li, KW_COLS, "l_returnflag").withColumn("stars", fx.stars("p")))


@register("t02_linreg", """SELECT l_returnflag, """ + r("regr_slope(l_extendedprice, l_quantity)", "slope") + ", "
          + r("regr_intercept(l_extendedprice, l_quantity)", "intercept") + ", "
          + r("corr(l_quantity, l_extendedprice)", "r") + ", CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def q_t02(spark, d):
    return present(st.linreg(b.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("p"))


#: Student-t tails by Simpson's rule over the angle atan(t / sqrt(df)) in 4,000 steps.
T_TAIL_SQL = """reg AS (SELECT l_returnflag, regr_slope(l_tax, l_discount) AS slope, regr_intercept(l_tax, l_discount) AS intercept,
  corr(l_discount, l_tax) AS r, CAST(regr_count(l_tax, l_discount) AS BIGINT) AS n FROM lineitem GROUP BY 1),
arc AS (SELECT *, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS w FROM reg),
inner_mass AS (SELECT l_returnflag, 2 * exp(lgamma((any_value(n) - 1) / 2.0) - lgamma((any_value(n) - 2) / 2.0)) / sqrt(pi())
  * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(cos(w * k / 4000.0), n - 3)) * any_value(w) / 4000 / 3 AS m
  FROM arc, generate_series(0, 4000) s(k) GROUP BY 1),
tail AS (SELECT arc.*, 1 - m AS p FROM arc JOIN inner_mass USING (l_returnflag))"""


@register("t02_linreg_pvalue", with_ctes(T_TAIL_SQL) + "SELECT l_returnflag, " + ", ".join(r(c, c) for c in ("slope", "intercept", "r", "p"))
          + """, n, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM tail""")
def q_t02p(spark, d):
    return present(st.linreg(b.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"]).withColumn(
        "stars", fx.stars("p")))


# ------------------------------------------------------------------ balance and folds
@register("b01_class_weights", """SELECT toxic AS class, count(*) AS n_c, CAST(sum(count(*)) OVER () AS BIGINT) AS n, count(*) OVER () AS k,
  """ + r("round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 4)", "weight") + " FROM labels GROUP BY toxic")
def q_b01(spark, d):
    return present(ba.class_weights(b.table(spark, d, "labels"), "toxic"))


def _strat_sql(tab, col, name):
    return f"""SELECT '{name}' AS target, max(n_c) / min(n_c) AS imbalance_ratio, CAST(sum(n_c) AS BIGINT) AS n FROM
  (SELECT count(*) AS n_c FROM {tab} GROUP BY {col})"""


@register("b02_strategy", "SELECT target, " + r("imbalance_ratio", "imbalance_ratio") + """, n,
  CASE WHEN imbalance_ratio < 1.5 THEN 'none' WHEN imbalance_ratio < 5 THEN 'class_weight' WHEN n < 500 THEN 'class_weight'
       ELSE 'smote' END AS strategy FROM (""" + " UNION ALL ".join(
    [_strat_sql("labels", "toxic", "toxic"), _strat_sql("labels", "quality", "quality"),
     _strat_sql("events", "event_type", "event_type"), _strat_sql("lineitem", "l_linestatus", "l_linestatus")]) + ")")
def q_b02(spark, d):
    parts = []
    for tab, col in [("labels", "toxic"), ("labels", "quality"), ("events", "event_type"), ("lineitem", "l_linestatus")]:
        parts.append(ba.strategy_table(b.table(spark, d, tab), col).withColumn("target", F.lit(col)))
    return present(fx.union_all(parts).select("target", "imbalance_ratio", F.col("n").cast("bigint"), "strategy"))


@register("b05_encode_weights", """WITH w AS (SELECT c_mktsegment AS class, """
          + "round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 4) AS weight FROM customer GROUP BY 1)"
          + ", m AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx "
          + "FROM (SELECT DISTINCT coalesce(c_mktsegment, 'NA') AS label FROM customer)) "
          + "SELECT label_idx, class, " + r("weight", "weight") + " FROM w JOIN m ON w.class = m.label")
def q_b05(spark, d):
    cu = b.table(spark, d, "customer")
    return present(ba.encode_weights(ba.class_weights(cu, "c_mktsegment"), fx.label_mapping(cu, "c_mktsegment")))


@register("v01_stratified_folds", """SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def q_v01(spark, d):
    lab = b.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    return ba.stratified_folds(lab, "toxic", 5, 42).withColumnRenamed("row_id", "doc_id")


@register("v02_kfolds", """SELECT vec_id, CAST((row_number() OVER (ORDER BY md5('42|' || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold
FROM embeddings""")
def q_v02(spark, d):
    e = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return ba.kfolds(e, 5, 42).withColumnRenamed("row_id", "vec_id")


@register("v03_group_folds", with_ctes(b.SIGNALS_SQL) + """SELECT s.tool, s.passe, CAST(g.fold AS INTEGER) AS fold FROM (SELECT DISTINCT tool, passe FROM signals) s
JOIN (SELECT tool, row_number() OVER (ORDER BY tool) - 1 AS fold FROM (SELECT DISTINCT tool FROM signals)) g USING (tool)""")
def q_v03(spark, d):
    return ba.group_folds(b.signals(spark, d, index=False).select("tool", "passe").distinct(), "tool")



@register("v04_n_splits", """SELECT 'toxic' AS target, greatest(2, least(5, min(n_c))) AS n_splits FROM (SELECT count(*) AS n_c FROM labels GROUP BY toxic)
UNION ALL SELECT 'label', greatest(2, least(5, min(n_c))) FROM (SELECT count(*) AS n_c FROM embeddings GROUP BY label)""")
def q_v04(spark, d):
    a = ba.n_splits(b.table(spark, d, "labels"), "toxic").select(F.lit("toxic").alias("target"), "n_splits")
    c = ba.n_splits(b.table(spark, d, "embeddings"), "label").select(F.lit("label").alias("target"), "n_splits")
    return a.unionByName(c).select("target", F.col("n_splits").cast("bigint"))


@register("v06_holdout", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) - 1
  < ceil(count(*) OVER () * 0.15) AS is_test FROM orders""")
def q_v06(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return ba.holdout(o, 0.15, 42).withColumnRenamed("row_id", "o_orderkey")


# ------------------------------------------------------------------ metrics
PCR = """pc AS (
  SELECT model, cls, CAST(sum(support) AS BIGINT) AS support, sum(tp) AS tp, sum(pred) AS pred FROM (
    SELECT model, y_true AS cls, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp, 0 AS pred FROM oof GROUP BY 1, 2
    UNION ALL SELECT model, y_pred, 0, 0, count(*) FROM oof GROUP BY 1, 2) GROUP BY 1, 2),
rep AS (SELECT model, cls,
  CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
  CASE WHEN support + pred > 0 THEN 2.0 * tp / (support + pred) ELSE 0.0 END AS f1, support FROM pc)"""


@register("e01_e04_classification_metrics", with_ctes(C, PCR) + """SELECT a.model, """ + r("a.accuracy", "accuracy") + ", "
          + r("m.balanced_accuracy", "balanced_accuracy") + ", " + r("m.f1_macro", "f1_macro") + ", " + r("m.f1_weighted", "f1_weighted") + """
FROM (SELECT model, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM oof GROUP BY 1) a
JOIN (SELECT model, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(f1) AS f1_macro,
             sum(f1 * support) / sum(support) AS f1_weighted FROM rep GROUP BY 1) m USING (model)""")
def q_e01(spark, d):
    return present(ev.classification_metrics(b.oof_classification(spark, d)))


@register("e14_classification_report", with_ctes(C, PCR) + """SELECT model, cls, """ + ", ".join(
    r(c, c) for c in ("precision", "recall", "f1")) + """, support FROM (
  SELECT model, cls, precision, recall, f1, support FROM rep
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rep GROUP BY 1
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rep GROUP BY 1)""")
def q_e14(spark, d):
    return present(ev.classification_report(b.oof_classification(spark, d)))


REGM = """SELECT {k}, """ + r("avg(abs(y_true - y_pred))", "mae") + ", " + r("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))", "rmse") \
    + ", " + r("1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))", "r2") + ", " \
    + r("1 - var_pop(y_true - y_pred) / var_pop(y_true)", "explained_variance") + " FROM oof GROUP BY {k}"


@register("e05_e08_regression_metrics", with_ctes(R) + REGM.format(k="model"))
def q_e05(spark, d):
    return present(ev.regression_metrics(b.oof_regression(spark, d)))


@register("r05_per_fold_errors", with_ctes(R) + REGM.format(k="model, fold"))
def q_r05(spark, d):
    return present(rp.per_group_errors(b.oof_regression(spark, d), "fold"))


@register("e09_fold_summary", with_ctes(C, """f AS (SELECT model, fold, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc
                       FROM oof GROUP BY 1, 2)""") + "SELECT model, " + r("avg(acc)", "accuracy") + ", "
          + r("stddev_pop(acc)", "accuracy_std") + " FROM f GROUP BY 1")
def q_e09(spark, d):
    s = ev.fold_summary(b.oof_classification(spark, d), "classification")
    return present(s.select("model", "accuracy", "accuracy_std"))


@register("e10_e12_deviation", with_ctes(R) + "SELECT model, " + r("(sum(y_true) / nullif(sum(y_pred), 0) - 1) * 100", "total_dev_pct")
          + ", " + r("avg(abs(CASE WHEN y_true = 0 THEN 0.0 ELSE (y_true - y_pred) / y_true END)) * 100", "mean_rel_dev_pct")
          + ", " + r("avg(abs(y_true - y_pred)) / nullif(avg(y_true), 0) * 100", "mae_rel_pct") + " FROM oof GROUP BY 1")
def q_e10(spark, d):
    return present(ev.deviation_metrics(b.oof_regression(spark, d)))


@register("e13_confusion_matrix", with_ctes(C) + """, cls AS (SELECT DISTINCT model, y_true AS c FROM oof UNION SELECT DISTINCT model, y_pred FROM oof)
SELECT a.model, a.c AS y_true, p.c AS y_pred, coalesce(n.n, 0) AS n
FROM cls a JOIN cls p ON a.model = p.model
LEFT JOIN (SELECT model, y_true, y_pred, count(*) AS n FROM oof GROUP BY 1, 2, 3) n
  ON n.model = a.model AND n.y_true = a.c AND n.y_pred = p.c""")
def q_e13(spark, d):
    return ev.confusion_matrix(b.oof_classification(spark, d))


@register("e15_residuals", with_ctes(R) + "SELECT model, row_id, fold, " + r("y_true - y_pred", "residual") + " FROM oof")
def q_e15(spark, d):
    return present(ev.residuals(b.oof_regression(spark, d)))


@register("e15_residual_rmse", with_ctes(R) + "SELECT model, " + r("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))", "residual_rmse")
          + ", " + r("avg(y_true - y_pred)", "mean_residual") + " FROM oof GROUP BY 1")
def q_e15b(spark, d):
    return present(ev.residual_rmse(b.oof_regression(spark, d)))


@register("e16_error_distribution", with_ctes(C) + """, e AS (SELECT model, CASE WHEN y_true <> y_pred THEN 1.0 ELSE 0.0 END AS v FROM oof),
q AS (SELECT model, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1),
j AS (SELECT e.model, v, q1, median, q3, q3 - q1 AS iqr FROM e JOIN q USING (model))
SELECT model, """ + ", ".join(r(c, c) for c in ("q1", "median", "q3", "iqr")) + """,
  """ + r("min(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END)", "whisker_lo") + """,
  """ + r("max(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END)", "whisker_hi") + """,
  """ + r("avg(v)", "mean") + """, count(*) AS n,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr)) AS n_outliers
FROM j GROUP BY model, q1, median, q3, iqr""")
def q_e16(spark, d):
    return present(ev.error_distribution(b.oof_classification(spark, d), "classification"))


# ------------------------------------------------------------------ report tables
REG_METRICS_CTE = "m AS (" + REGM.format(k="model").replace(" AS ", " AS ") + ")"


@register("r01_w06_f10_leaderboard", with_ctes(R, "mm AS (SELECT model, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2, avg(abs(y_true - y_pred)) AS mae FROM oof GROUP BY 1)")
          + """SELECT model, """ + r("r2", "r2") + ", " + r("mae", "mae") + """, CAST(row_number() OVER (ORDER BY r2 DESC NULLS LAST, model) AS INTEGER) AS rank,
  CASE row_number() OVER (ORDER BY r2 DESC NULLS LAST, model) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal,
  CASE WHEN contains(model, '_') THEN regexp_replace(model, '^[^_]*_', '') ELSE model END AS short_name FROM mm""")
def q_r01(spark, d):
    m = ev.regression_metrics(b.oof_regression(spark, d)).select("model", "r2", "mae")
    return present(rp.leaderboard(m, "r2").withColumn("rank", F.col("rank").cast("int")))


@register("r02_w08_radar", with_ctes(R, "mm AS (SELECT model, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2 FROM oof GROUP BY 1)")
          + """, lg AS (SELECT model, metric, value FROM mm UNPIVOT (value FOR metric IN (mae, r2)))
SELECT model, metric, """ + r("value", "value") + ", " + r("""CASE WHEN metric IN ('mae', 'rmse', 'mae_std', 'rmse_std')
  THEN 1 - (value - min(value) OVER (PARTITION BY metric)) / (max(value) OVER (PARTITION BY metric) - min(value) OVER (PARTITION BY metric) + 1e-9)
  ELSE (value - min(value) OVER (PARTITION BY metric)) / (max(value) OVER (PARTITION BY metric) - min(value) OVER (PARTITION BY metric) + 1e-9) END""", "score")
          + " FROM lg")
def q_r02(spark, d):
    m = ev.regression_metrics(b.oof_regression(spark, d))
    return present(rp.radar_scores(m, ["mae", "r2"]))


@register("r04_predicted_vs_actual", with_ctes(C) + """, s AS (SELECT model, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM oof GROUP BY 1)
SELECT oof.model, row_id, fold, y_true, y_pred, """ + r("accuracy", "accuracy") + " FROM oof JOIN s USING (model)")
def q_r04(spark, d):
    return present(rp.predicted_vs_actual(b.oof_classification(spark, d), "classification"))


WEAR_OOF_SQL = """woof AS (SELECT 'LagRule' AS model, tool, passe, vb_mean AS y_true,
  coalesce(lag(vb_mean) OVER (PARTITION BY tool ORDER BY passe), vb_mean) AS y_pred FROM wear)"""


@register("r06_wear_curve", with_ctes(b.WEAR_SQL, WEAR_OOF_SQL) + "SELECT model, tool, passe, " + r("y_true", "y_true") + ", "
          + r("y_pred", "y_pred") + ", y_true >= 0.3 AS actual_eol, y_pred >= 0.3 AS predicted_eol FROM woof")
def q_r06(spark, d):
    # prediction stand-in: the previous pass's wear (first pass: its own)
    w = wr.wear_table(b.raw_wear(spark, d))
    p = with_position(w.select("tool", "passe", "vb_mean"), ["tool"], ["passe"], name="_pos")
    n = neighbourhood(p, ["tool"], "_pos", ["vb_mean", "passe"], [-1])
    oof = n.select(F.lit("LagRule").alias("model"), "tool", F.col("passe_at_0").alias("passe"),
                   F.col("vb_mean_at_0").alias("y_true"),
                   F.coalesce(F.col("vb_mean_at_m1"), F.col("vb_mean_at_0")).alias("y_pred"))
    return present(rp.wear_curve(oof))


@register("w07_best_per_group", with_ctes(R, "mm AS (SELECT model, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2 FROM oof GROUP BY model, fold)")
          + """SELECT 'r2' AS metric, arg_min(model, (-r2, model)) AS best_model, """ + r("max(r2)", "best_value") + " FROM mm")
def q_w07(spark, d):
    m = ev.regression_metrics(b.oof_regression(spark, d), ["model", "fold"]).withColumn("metric", F.lit("r2"))
    return present(rp.best_per_group(m, "metric", "r2").withColumnRenamed("best_r2", "best_value"))


CORR_SQL = """cr AS (SELECT feature, r FROM (SELECT corr(l_quantity, y) AS l_quantity, corr(l_extendedprice, y) AS l_extendedprice,
             corr(l_discount, y) AS l_discount, corr(l_tax, y) AS l_tax FROM
             (SELECT *, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'NA')) - 1 AS y FROM lineitem))
             UNPIVOT (r FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""


def _corr(spark, d):
    li = fx.label_encode(b.table(spark, d, "lineitem"), "l_returnflag", out="y")
    return pr.corr_with_target(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y").select("feature", "r")


@register("o01_o03_top_corr", with_ctes(CORR_SQL) + "SELECT feature, " + r("r", "r") + " FROM cr ORDER BY abs(r) DESC, feature LIMIT 2")
def q_o01(spark, d):
    return present(rp.top_k(_corr(spark, d), 2, "r"))


@register("o02_extremes", with_ctes(CORR_SQL) + """SELECT feature, """ + r("r", "r") + """, side FROM (
  (SELECT feature, r, 'positive' AS side FROM cr WHERE r > 0 ORDER BY r DESC, feature LIMIT 1)
  UNION ALL (SELECT feature, r, 'negative' AS side FROM cr WHERE r < 0 ORDER BY r ASC, feature LIMIT 1))""")
def q_o02(spark, d):
    return present(rp.extremes(_corr(spark, d), 1))


@register("o04_sort_metric", with_ctes(R) + "SELECT * FROM (" + REGM.format(k="model") + ") ORDER BY mae, model")
def q_o04(spark, d):
    return present(rp.sort_metric(ev.regression_metrics(b.oof_regression(spark, d)), "mae"))


@register("o07_j05_error_table", with_ctes(R) + """, w AS (SELECT row_id, max(CASE WHEN model = '01_NetLines' THEN y_true END) AS net_true,
  max(CASE WHEN model = '01_NetLines' THEN y_pred END) AS net_pred, max(CASE WHEN model = '02_GrossLines' THEN y_true END) AS gross_true,
  max(CASE WHEN model = '02_GrossLines' THEN y_pred END) AS gross_pred FROM oof GROUP BY row_id)
SELECT o_orderkey AS row_id, o_orderstatus, """ + ", ".join(r(c, c) for c in ("net_true", "net_pred", "gross_true", "gross_pred")) + ", "
          + r("abs(net_true - net_pred)", "abs_err_net") + ", " + r("abs(gross_true - gross_pred)", "abs_err_gross") + """
FROM orders JOIN w ON o_orderkey = w.row_id""")
def q_o07(spark, d):
    oof = b.oof_regression(spark, d)
    wide = oof.groupBy("row_id").pivot("model", ["01_NetLines", "02_GrossLines"]).agg(F.first("y_true").alias("t"), F.first("y_pred").alias("p"))
    wide = wide.select("row_id", F.col("01_NetLines_t").alias("net_true"), F.col("01_NetLines_p").alias("net_pred"),
                       F.col("02_GrossLines_t").alias("gross_true"), F.col("02_GrossLines_p").alias("gross_pred"))
    src = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return present(rp.error_table(wide, src, ["net", "gross"]))


@register("a40_importance_by_sensor", with_ctes(b.SIGNALS_SQL, b.WEAR_SQL) + """, f AS (
  SELECT s.tool, s.passe, s.channel, sqrt(avg(x * x)) AS rms, avg(x) AS mean FROM signals s GROUP BY 1, 2, 3),
j AS (SELECT f.*, w.vb_mean FROM f JOIN wear w USING (tool, passe)),
imp AS (SELECT channel || '_rms' AS feature, abs(corr(rms, vb_mean)) AS importance FROM j GROUP BY channel
        UNION ALL SELECT channel || '_mean', abs(corr(mean, vb_mean)) FROM j GROUP BY channel)
SELECT regexp_extract(feature, '^([^_]+)_', 1) AS sensor, """ + r("sum(importance)", "importance") + " FROM imp GROUP BY 1")
def q_a40(spark, d):
    from flankwear.operators import signal_stats as ss
    long = ss.channel_stats(b.signals(spark, d, index=False)).select("tool", "passe", "channel", "rms", "mean")
    j = long.join(wr.wear_table(b.raw_wear(spark, d)).select("tool", "passe", "vb_mean"), ["tool", "passe"])
    imp = (j.groupBy("channel").agg(F.abs(F.corr("rms", "vb_mean")).alias("i_rms"), F.abs(F.corr("mean", "vb_mean")).alias("i_mean"))
           .select(F.explode(F.array(F.struct(F.concat("channel", F.lit("_rms")).alias("feature"), F.col("i_rms").alias("importance")),
                                     F.struct(F.concat("channel", F.lit("_mean")).alias("feature"), F.col("i_mean").alias("importance")))).alias("s"))
           .select("s.*"))
    return present(rp.importance_by_sensor(imp))
