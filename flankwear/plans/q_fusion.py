"""Queries: experiments, turning runs, programs and the three-source fusion
(P01, P05, P06, P17, A16, A30-A32, A35, A38, A39, J03, U01, U03-U05, W05, F07, F09, F11, F13)."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import fusion as fu
from flankwear.operators import signal_stats as ss
from flankwear.operators import wear as wr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.q_signals import CH, pass_features
from flankwear.plans.sqlgen import moments_sql, present, r, with_ctes

SIG = b.EXP_SIGNALS
ACTIVE = ", ".join(f"'{p}'" for p in fu.ACTIVE_PHASES)
EXL_SQL = f"""exl AS (
  SELECT exp_id, ch.channel, ch.x FROM exps,
  LATERAL (VALUES ('S1_OutputPower', S1_OutputPower), ('X1_OutputCurrent', X1_OutputCurrent)) ch(channel, x)
  WHERE Machining_Process IN ({ACTIVE}))"""


@register("p01_active_only", with_ctes(b.EXPERIMENTS_SQL) + f"""SELECT Machining_Process, count(*) AS n
FROM exps WHERE Machining_Process IN ({ACTIVE}) GROUP BY 1""")
def q_p01(spark, d):
    return fu.active_only(b.experiments(spark, d, index=False)).groupBy("Machining_Process").agg(F.count(F.lit(1)).alias("n"))


@register("a16_experiment_features", with_ctes(b.EXPERIMENTS_SQL, EXL_SQL, moments_sql("exl", ["exp_id", "channel"]))
          + "SELECT exp_id, channel, n, " + ", ".join(r(s, s) for s in ss.STATS) + " FROM feat")
def q_a16(spark, d):
    return present(fu.experiment_features(b.experiments(spark, d, index=False), SIG).drop("energy_mean"))


def exp_wide(spark, d):
    long = present(fu.experiment_features(b.experiments(spark, d, index=False), SIG))
    return ss.to_wide(long, ["exp_id"], SIG)


EXP_WIDE_SQL = "expw AS (SELECT exp_id, " + ", ".join(
    r(f"max(CASE WHEN channel = '{c}' THEN {s} END)", f"{c}_{s}") for c in SIG for s in ss.STATS) \
    + " FROM expf GROUP BY exp_id)"


@register("j03_label_experiments", with_ctes(b.EXPERIMENTS_SQL, b.EXP_LABELS_SQL, EXL_SQL,
                                             moments_sql("exl", ["exp_id", "channel"], name="expf"), EXP_WIDE_SQL)
          + "SELECT expw.*, tool_condition, " + r("feedrate", "feedrate") + ", " + r("clamp_pressure", "clamp_pressure")
          + " FROM expw JOIN labs ON expw.exp_id = labs.No")
def q_j03(spark, d):
    return present(fu.label_experiments(exp_wide(spark, d), b.exp_labels(spark, d)), ["feedrate", "clamp_pressure"])


@register("a38_experiment_lengths", with_ctes(b.EXPERIMENTS_SQL) + "SELECT exp_id, count(*) AS n_rows FROM exps GROUP BY 1")
def q_a38(spark, d):
    return fu.experiment_lengths(b.experiments(spark, d, index=False))


@register("a39_phase_spans", with_ctes(b.EXPERIMENTS_SQL)
          + "SELECT exp_id, Machining_Process, min(i) AS first_i, max(i) AS last_i FROM exps GROUP BY 1, 2")
def q_a39(spark, d):
    return fu.phase_spans(b.experiments(spark, d))


@register("a32_stats_by_label", with_ctes(b.EXPERIMENTS_SQL, b.EXP_LABELS_SQL) + "SELECT tool_condition, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std" for c in SIG)
          + " FROM exps JOIN labs ON exps.exp_id = labs.No GROUP BY 1")
def q_a32(spark, d):
    e = b.experiments(spark, d, index=False).join(b.exp_labels(spark, d).withColumnRenamed("No", "exp_id"), "exp_id")
    return fu.stats_by_label(e, "tool_condition", SIG)


RUN_MEANS = ["Ra", "Rz", "Rsk", "Rku"]
RUN_FIRSTS = ["Condition", "Tool_ID", "Experiment"]


def run_rollup(spark, d):
    ru = fu.rollup_runs(b.runs(spark, d), RUN_MEANS, RUN_FIRSTS, b.RUN_ORDER)
    return fx.harmonise_condition(ru, "Condition")


ORD_SQL = "{" + ", ".join(f"'k{i}': {c}" for i, c in enumerate(b.RUN_ORDER)) + "}"
ROLL_SQL = "roll AS (SELECT Run_ID, " + ", ".join(f"avg({c}) AS {c}" for c in RUN_MEANS) + ", " + ", ".join(
    f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN {ORD_SQL} END) AS {c}" for c in RUN_FIRSTS) \
    + """ FROM runs GROUP BY Run_ID),
rollh AS (SELECT *, CASE WHEN coalesce(TRY_CAST(Condition AS DOUBLE), 0.0) > 0 THEN 'worn' ELSE 'unworn' END AS tool_condition,
                 CAST(row_number() OVER (ORDER BY Run_ID) - 1 AS BIGINT) AS seq FROM roll)"""


@register("a30_w05_f07_rollup_runs", with_ctes(b.RUNS_SQL, ROLL_SQL) + "SELECT Run_ID, " + ", ".join(
    r(c, c) for c in [*RUN_MEANS, "Condition"]) + ", Tool_ID, Experiment, tool_condition, seq FROM rollh")
def q_a30(spark, d):
    ru = wr.with_seq(run_rollup(spark, d), ["Run_ID"], name="seq")
    return present(ru)


@register("a31_program_energy", "SELECT l_linestatus AS program, " + ", ".join(
    f"{r(f'coalesce(sum({c}), 0.0)', f'haupt_ENERGY_{n}_sum')}, {r(f'avg({c})', f'haupt_ENERGY_{n}_mean')}, "
    f"{r(f'stddev_samp({c})', f'haupt_ENERGY_{n}_std')}"
    for c, n in [("l_quantity", "x"), ("l_extendedprice", "y"), ("l_discount", "z"), ("l_tax", "S")])
          + " FROM lineitem GROUP BY 1")
def q_a31(spark, d):
    return present(fu.program_energy(b.programs(spark, d), "program", b.ENERGIES))


@register("f13_one_hot", "SELECT l_linestatus AS program, " + ", ".join(
    f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS Commands_{v}" for v in "ANR")
          + " FROM lineitem GROUP BY 1")
def q_f13(spark, d):
    oh = fx.one_hot(b.programs(spark, d), "Commands", ["A", "N", "R"])
    return oh.groupBy("program").agg(*[F.sum(f"Commands_{v}").cast("bigint").alias(f"Commands_{v}") for v in "ANR"])


# ------------------------------------------------------------------ fused table
def fused(spark, d):
    def phm_part():
        phm = wr.label_passes(pass_features(spark, d, checked=True), wr.wear_table(b.raw_wear(spark, d)), how="left")
        return present(phm.select(F.lit("phm").alias("source"), F.col("tool").alias("condition_exp"), "passe",
                                  F.col("vb_mean").alias("vb_mm"), fx.worn_label("vb_mean").alias("tool_condition"),
                                  *[f"{c}_{s}" for c in CH for s in ss.STATS]), ["vb_mm"])

    def exp_part():
        return fu.label_experiments(exp_wide(spark, d), b.exp_labels(spark, d)).select(
            F.lit("exp").alias("source"), F.col("exp_id").cast("string").alias("condition_exp"), "tool_condition",
            *[f"{c}_{s}" for c in SIG for s in ss.STATS])

    def run_part():
        ru = present(wr.with_seq(run_rollup(spark, d), ["Run_ID"], name="seq"))
        return ru.select(F.lit("turning").alias("source"), F.col("Run_ID").alias("condition_exp"),
                         F.col("seq").cast("int").alias("passe"), "tool_condition", *RUN_MEANS, "Tool_ID", "Experiment")

    # the three sources are independent; their staging jobs are submitted side by side
    with ThreadPoolExecutor(max_workers=3) as pool:
        parts = [f.result() for f in [pool.submit(phm_part), pool.submit(exp_part), pool.submit(run_part)]]
    return fu.fuse(*parts)


PHM_FEATS = ", ".join(f"{c}_{s}" for c in CH for s in ss.STATS)
FUSED_SQL = with_ctes(
    b.SIGNALS_SQL, b.WEAR_SQL, moments_sql("signals", ["tool", "passe", "channel"]),
    "phmw AS (SELECT tool, passe, " + ", ".join(r(f"max(CASE WHEN channel = '{c}' THEN {s} END)", f"{c}_{s}")
                                               for c in CH for s in ss.STATS) + " FROM feat GROUP BY tool, passe)",
    b.EXPERIMENTS_SQL, b.EXP_LABELS_SQL, EXL_SQL, moments_sql("exl", ["exp_id", "channel"], name="expf"), EXP_WIDE_SQL,
    b.RUNS_SQL, ROLL_SQL,
    "fused AS (SELECT 'phm' AS source, p.tool AS condition_exp, p.passe, " + r("w.vb_mean", "vb_mm")
    + ", CASE WHEN w.vb_mean IS NULL THEN 'unknown' WHEN w.vb_mean >= 0.2 THEN 'worn' ELSE 'unworn' END AS tool_condition, "
    + PHM_FEATS + " FROM phmw p LEFT JOIN wear w USING (tool, passe) "
    "UNION ALL BY NAME SELECT 'exp' AS source, CAST(expw.exp_id AS VARCHAR) AS condition_exp, tool_condition, "
    + ", ".join(f"{c}_{s}" for c in SIG for s in ss.STATS) + " FROM expw JOIN labs ON expw.exp_id = labs.No "
    "UNION ALL BY NAME SELECT 'turning' AS source, Run_ID AS condition_exp, CAST(seq AS INTEGER) AS passe, tool_condition, "
    + ", ".join(r(c, c) for c in RUN_MEANS) + ", Tool_ID, Experiment FROM rollh)")


@register("u01_fuse", FUSED_SQL + "SELECT * FROM fused")
def q_u01(spark, d):
    return fused(spark, d)


GROUPS = {"phm_click": ["click_mean", "click_rms"], "exp_power": ["S1_OutputPower_mean", "S1_OutputPower_rms"],
          "turning_roughness": ["Ra", "Rz"], "wear": ["vb_mm"]}


@register("a35_availability", FUSED_SQL + "SELECT source, feature_group, " + r("availability", "availability")
          + " FROM (SELECT source, " + ", ".join(
              f"avg(CAST(({' AND '.join(c + ' IS NOT NULL' for c in cols)}) AS INTEGER)) AS {g}"
              for g, cols in GROUPS.items()) + " FROM fused GROUP BY source) UNPIVOT (availability FOR feature_group IN ("
          + ", ".join(GROUPS) + "))")
def q_a35(spark, d):
    return present(fu.availability(fused(spark, d), GROUPS))


def _num_cols():
    return ["passe", "vb_mm", *[f"{c}_{s}" for c in CH for s in ss.STATS], *[f"{c}_{s}" for c in SIG for s in ss.STATS],
            *RUN_MEANS]


NONEMPTY_SQL = ", nonempty AS (SELECT source, feature, n FROM (SELECT source, " + ", ".join(
    f"count({c}) AS {c}" for c in _num_cols()) + " FROM fused GROUP BY source) UNPIVOT (n FOR feature IN (" + ", ".join(
    _num_cols()) + ")))\n"


@register("p17_common_features", FUSED_SQL + NONEMPTY_SQL + """SELECT feature, count(*) FILTER (WHERE n > 0) AS n_sources
FROM nonempty GROUP BY feature HAVING count(*) FILTER (WHERE n > 0) >= 2""")
def q_p17(spark, d):
    return fu.common_features(fused(spark, d))


@register("p05_p06_labeled_counts", FUSED_SQL + """SELECT source, tool_condition, count(*) AS n FROM fused
WHERE tool_condition IN ('worn', 'unworn') GROUP BY 1, 2""")
def q_p05(spark, d):
    f = fu.labeled_only(fused(spark, d))
    parts = [fu.subset(f, source=s) for s in ("phm", "exp", "turning")]
    return fx.union_all(parts).groupBy("source", "tool_condition").agg(F.count(F.lit(1)).alias("n"))


@register("u03_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_u03(spark, d):
    return b.table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@register("u04_shared_columns", FUSED_SQL + NONEMPTY_SQL + """, m AS (SELECT feature, source FROM nonempty WHERE n > 0),
t AS (SELECT count(DISTINCT source) AS tot FROM m)
SELECT feature, list_sort(list(DISTINCT source)) AS datasets, count(DISTINCT source) AS n_datasets,
  CASE WHEN count(DISTINCT source) = max(tot) THEN 'all' WHEN count(DISTINCT source) > 1 THEN 'several'
       ELSE 'unique' END AS sharing
FROM m, t GROUP BY feature""")
def q_u04(spark, d):
    m = fu.non_empty_counts(fused(spark, d)).where(F.col("n") > 0).select("feature", "source")
    return fu.shared_columns(m)


@register("u05_only_in_in_both", FUSED_SQL + NONEMPTY_SQL + """, m AS (SELECT feature, source FROM nonempty WHERE n > 0)
SELECT feature, 'only_phm' AS relation FROM (SELECT feature FROM m WHERE source = 'phm'
                                             EXCEPT SELECT feature FROM m WHERE source = 'turning')
UNION ALL
SELECT feature, 'both' AS relation FROM (SELECT feature FROM m WHERE source = 'phm'
                                         INTERSECT SELECT feature FROM m WHERE source = 'turning')""")
def q_u05(spark, d):
    m = fu.non_empty_counts(fused(spark, d)).where(F.col("n") > 0)
    a = m.where(F.col("source") == "phm").select("feature")
    t = m.where(F.col("source") == "turning").select("feature")
    return (fu.only_in(a, t).withColumn("relation", F.lit("only_phm"))
            .unionByName(fu.in_both(a, t).withColumn("relation", F.lit("both"))))


FG_SQL = """CASE WHEN left(feature, 6) = 'force_' OR left(feature, 4) = 'vib_' OR left(feature, 3) = 'ae_' THEN 'pass_signals'
  WHEN left(feature, 3) IN ('S1_', 'X1_', 'Y1_', 'Z1_') THEN 'motor_signals'
  WHEN feature IN ('Ra', 'Rz', 'Rsk', 'Rku', 'RSm', 'Rt') THEN 'roughness'
  WHEN feature IN ('Fx', 'Fy', 'Fz', 'F') THEN 'forces' WHEN feature IN ('ap', 'vc', 'f') THEN 'cutting_params'
  ELSE 'other' END"""


@register("f11_feature_group", FUSED_SQL + NONEMPTY_SQL + "SELECT " + FG_SQL
          + " AS feature_group, count(DISTINCT feature) AS n_features FROM nonempty WHERE n > 0 GROUP BY 1")
def q_f11(spark, d):
    m = fu.non_empty_counts(fused(spark, d)).where(F.col("n") > 0)
    return (m.select(fx.feature_group("feature").alias("feature_group"), "feature")
            .groupBy("feature_group").agg(F.count_distinct("feature").alias("n_features")))



@register("a43_feature_counts", FUSED_SQL + NONEMPTY_SQL + """SELECT CASE WHEN regexp_matches(feature, 'band_|tpf_') THEN 'frequency'
  ELSE 'time' END AS kind, count(DISTINCT feature) AS n_features FROM nonempty WHERE n > 0 GROUP BY 1""")
def q_a43(spark, d):
    from flankwear.operators import report as rp
    m = fu.non_empty_counts(fused(spark, d)).where(F.col("n") > 0)
    return rp.feature_counts(m.select("feature"))
