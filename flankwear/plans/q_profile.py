"""Queries: profile, correlations, class balance and scalar helpers
(P02, P11, P14, P16, A19-A24, A26-A29, O05, O06, F01, F14-F20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import profile as pr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.sqlgen import present, r, with_ctes

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROF_SQL = """prof AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""


def prof(spark, d):
    """``lineitem`` with zero discount / tax read as missing (injected NULLs)."""
    li = b.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"), "l_returnflag", "l_linestatus")


@register("p02_complete_cases", with_ctes(PROF_SQL) + """SELECT count(*) AS n_before,
  count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL) AS n_after,
  count(*) - count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL) AS n_dropped
FROM prof""")
def q_p02(spark, d):
    return pr.complete_case_counts(prof(spark, d), ["l_quantity", "l_discount", "l_tax"])


@register("p11_zero_variance", with_ctes(PROF_SQL) + """, s AS (
  SELECT stddev_samp(l_quantity) AS l_quantity, stddev_samp(l_extendedprice) AS l_extendedprice,
         stddev_samp(l_discount) AS l_discount, stddev_samp(l_tax) AS l_tax,
         stddev_samp(l_quantity * 0) AS l_zero FROM prof)
SELECT "column", """ + r("std", "std") + """, coalesce(std < 1e-9, false) AS zero_variance
FROM s UNPIVOT (std FOR "column" IN (l_quantity, l_extendedprice, l_discount, l_tax, l_zero))""")
def q_p11(spark, d):
    p = prof(spark, d).withColumn("l_zero", F.col("l_quantity") * 0)
    return present(pr.zero_variance(p, [*NUM, "l_zero"]))


@register("p14_detect_task", """WITH s AS (SELECT count(*) AS n,
  count(DISTINCT l_returnflag) AS d0, count(DISTINCT l_quantity) AS d1,
  count(DISTINCT l_extendedprice) AS d2, count(DISTINCT l_linenumber) AS d3 FROM lineitem),
t AS (
  SELECT 'l_returnflag' AS target, d0 AS n_distinct, n AS n_rows, true AS is_str FROM s UNION ALL
  SELECT 'l_quantity', d1, n, false FROM s UNION ALL
  SELECT 'l_extendedprice', d2, n, false FROM s UNION ALL
  SELECT 'l_linenumber', d3, n, false FROM s)
SELECT target, n_distinct, n_rows,
  CASE WHEN is_str THEN 'classification'
       WHEN n_distinct <= 15 OR n_distinct / n_rows < 0.05 THEN 'classification' ELSE 'regression' END AS task
FROM t""")
def q_p14(spark, d):
    return pr.task_stats(b.table(spark, d, "lineitem"), ["l_returnflag", "l_quantity", "l_extendedprice",
                                                         "l_linenumber"])


LEAK_SQL = """SELECT feature, """ + r("r", "r") + """, """ + r("round(abs(r), 5)", "abs_r") + """,
  coalesce(abs(r) >= 0.98, false) AS leaky
FROM (SELECT corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount,
             corr(l_tax, l_extendedprice) AS l_tax,
             corr(l_extendedprice * 1.01 + l_tax, l_extendedprice) AS price_copy FROM lineitem)
UNPIVOT (r FOR feature IN (l_quantity, l_discount, l_tax, price_copy))"""


@register("p16_leaky", LEAK_SQL)
def q_p16(spark, d):
    li = b.table(spark, d, "lineitem").withColumn("price_copy", F.col("l_extendedprice") * 1.01 + F.col("l_tax"))
    c = pr.corr_with_target(li, ["l_quantity", "l_discount", "l_tax", "price_copy"], "l_extendedprice")
    return present(pr.leaky(c))


@register("a19_corr_pair", with_ctes(PROF_SQL) + """SELECT count(*) FILTER (WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) AS n,
  """ + r("CASE WHEN count(*) FILTER (WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) >= 5 THEN corr(l_discount, l_tax) END", "r")
          + " FROM prof")
def q_a19(spark, d):
    return present(pr.corr_pair(prof(spark, d), "l_discount", "l_tax"))


@register("a20_corr_with_target", """WITH e AS (
  SELECT *, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'NA')) - 1 AS y FROM lineitem)
SELECT feature, """ + r("r", "r") + ", " + r("round(abs(r), 5)", "abs_r") + """
FROM (SELECT corr(l_quantity, y) AS l_quantity, corr(l_extendedprice, y) AS l_extendedprice,
             corr(l_discount, y) AS l_discount, corr(l_tax, y) AS l_tax FROM e)
UNPIVOT (r FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def q_a20(spark, d):
    li = fx.label_encode(b.table(spark, d, "lineitem"), "l_returnflag", out="y")
    return present(pr.corr_with_target(li, NUM, "y"))


def _pairs_sql():
    rows = []
    for i, a in enumerate(NUM):
        for j, c in enumerate(NUM):
            if j < i:
                rows.append(f"SELECT '{a}' AS a, '{c}' AS b, corr({a}, {c}) AS r FROM prof")
    return " UNION ALL ".join(rows)


@register("a21_corr_matrix", with_ctes(PROF_SQL) + "SELECT a, b, " + r("r", "r") + " FROM (" + _pairs_sql() + ")")
def q_a21(spark, d):
    return present(pr.corr_matrix(prof(spark, d), NUM))


@register("a21_corr_matrix_wide", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings)
SELECT 'dim_' || a.j AS a, 'dim_' || b.j AS b, """ + r("corr(a.v, b.v)", "r") + """ FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.j < a.j
GROUP BY a.j, b.j""")
def q_a21_wide(spark, d):
    """All pairs of the dimensions of the vectors."""
    e = b.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = e.select(*[F.get("embedding", F.lit(k)).cast("double").alias(f"dim_{k}") for k in range(n)])
    return present(pr.corr_matrix(wide, wide.columns))


@register("a22_class_balance", """WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count FROM labels GROUP BY 1)
SELECT class, count, CAST(sum(count) OVER () AS BIGINT) AS total, """ + r("count / sum(count) OVER () * 100.0", "pct") + ", "
          + r("max(count) OVER () / sum(count) OVER () * 100.0", "majority_pct") + """,
  max(count) OVER () / sum(count) OVER () * 100.0 > 70.0 AS is_imbalanced, """
          + r("max(count) OVER () / min(count) OVER ()", "imbalance_ratio") + """, count(*) OVER () AS n_classes
FROM c""")
def q_a22(spark, d):
    return present(pr.class_balance(b.table(spark, d, "labels"), "toxic"))


@register("a23_value_counts", "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def q_a23(spark, d):
    return pr.value_counts(b.table(spark, d, "events"), "event_type")


@register("a24_label_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def q_a24(spark, d):
    return pr.label_counts(b.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


PCOLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
         "l_linestatus"]
NULLS_SQL = with_ctes(PROF_SQL) + """, s AS (
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in PCOLS) + """) AS rows_after_dropna,
  """ + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in PCOLS) + """ FROM prof),
u AS (SELECT n_rows, rows_after_dropna, "column", n_null FROM s
      UNPIVOT (n_null FOR "column" IN (""" + ", ".join(PCOLS) + """)))
"""


@register("a26_null_profile", NULLS_SQL + "SELECT \"column\", n_null, " + r("n_null / n_rows * 100.0", "pct_null")
          + ", n_rows, rows_after_dropna FROM u")
def q_a26(spark, d):
    return present(pr.null_profile(prof(spark, d)))


@register("o06_sparsest", NULLS_SQL + "SELECT \"column\", n_null, " + r("n_null / n_rows * 100.0", "pct_null")
          + ", n_rows, rows_after_dropna FROM u ORDER BY n_null DESC, \"column\" LIMIT 3")
def q_o06(spark, d):
    return present(pr.sparsest(prof(spark, d), 3))


@register("a27_duplicate_count", """SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS n_duplicates,
  CAST(coalesce(sum(k), 0) AS BIGINT) AS n_rows
FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)""")
def q_a27(spark, d):
    return pr.duplicate_count(b.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity",
                                                                  "l_discount"))


@register("a28_describe", """SELECT "column", count(v) AS count, """ + ", ".join([
    r("avg(v)", "mean"), r("stddev_samp(v)", "std"), r("min(v)", "min"), r("quantile_cont(v, 0.25)", "p25"),
    r("quantile_cont(v, 0.5)", "p50"), r("quantile_cont(v, 0.75)", "p75"), r("max(v)", "max")]) + """
FROM (SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
      UNPIVOT (v FOR "column" IN (l_quantity, l_extendedprice, l_discount, l_tax)))
GROUP BY "column\"""")
def q_a28(spark, d):
    return present(pr.describe(b.table(spark, d, "lineitem"), NUM))


@register("a29_column_catalog", """SELECT * FROM (VALUES
  ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_orderpriority', 'string')) t("column", dtype)
JOIN (SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null, count(DISTINCT o_orderkey) AS n_distinct,
             CAST(min(o_orderkey) AS VARCHAR) AS example FROM orders
      UNION ALL SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR) FROM orders
      UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus) FROM orders
      UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(DISTINCT o_orderpriority), min(o_orderpriority) FROM orders
) s USING ("column")""")
def q_a29(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return pr.column_catalog(o)


@register("o05_head", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + r("l_extendedprice", "l_extendedprice") + """
FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount,
  l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 10""")
def q_o05(spark, d):
    li = b.table(spark, d, "lineitem")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return present(pr.head(li, 10, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_extendedprice"))


@register("f01_coerce", """SELECT event_id, TRY_CAST(props AS DOUBLE) AS props_num,
  TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events""")
def q_f01(spark, d):
    ev = b.table(spark, d, "events").select("event_id", F.col("props").alias("props_num"),
                                            F.regexp_extract("props", r"(\d+)", 1).alias("k"))
    return fx.coerce(ev, ["props_num", "k"])


@register("f14_f15_label_codec", """WITH m AS (
  SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
  FROM (SELECT DISTINCT coalesce(c_mktsegment, 'NA') AS label FROM customer))
SELECT m.label_idx, m.label AS decoded, count(*) AS n
FROM customer c JOIN m ON coalesce(c.c_mktsegment, 'NA') = m.label GROUP BY 1, 2""")
def q_f14(spark, d):
    cu = b.table(spark, d, "customer")
    m = fx.label_mapping(cu, "c_mktsegment")
    enc = fx.label_encode(cu, "c_mktsegment")
    dec = fx.label_decode(enc, m, "label_idx", "decoded")
    return dec.groupBy("label_idx", "decoded").agg(F.count(F.lit(1)).alias("n"))


@register("f16_binary_target", with_ctes(b.WEAR_SQL) + """SELECT tool,
  CAST(sum(CASE WHEN CASE WHEN vb_mean >= 0.2 THEN 'worn' ELSE 'unworn' END = 'worn' THEN 1 ELSE 0 END) AS BIGINT) AS n_worn
FROM wear GROUP BY tool""")
def q_f16(spark, d):
    from flankwear.operators import wear as wr
    w = wr.wear_table(b.raw_wear(spark, d)).withColumn("lab", fx.worn_label("vb_mean"))
    return w.groupBy("tool").agg(F.sum(fx.binary_target("lab")).cast("bigint").alias("n_worn"))


@register("f17_fill", with_ctes(PROF_SQL) + "SELECT l_returnflag, " + r("sum(coalesce(l_discount, 0.0))", "s_disc")
          + ", count(*) AS n FROM prof GROUP BY 1")
def q_f17(spark, d):
    p = fx.fill(prof(spark, d), 0.0, ["l_discount"])
    return present(p.groupBy("l_returnflag").agg(F.sum("l_discount").alias("s_disc"), F.count(F.lit(1)).alias("n")))


@register("f18_round_cols", """SELECT o_orderkey, round_even(o_totalprice / 7.0, 2) AS half_even,
  round(o_totalprice / 7.0, 2) AS half_up FROM orders""")
def q_f18(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 7.0).alias("half_even"),
                                           (F.col("o_totalprice") / 7.0).alias("half_up"))
    o = fx.round_cols(o, {"half_even": 2}, half_even=True)
    return fx.round_cols(o, {"half_up": 2}, half_even=False)


@register("f19_to_long", """SELECT o_orderkey, variable, valeur FROM (
  SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)
UNPIVOT (valeur FOR variable IN (o_totalprice, o_custkey))""")
def q_f19(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    return fx.to_long(o, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@register("f20_rel_deviation", "SELECT l_orderkey, l_linenumber, l_partkey, " + r(
    "CASE WHEN l_tax = 0 THEN 0.0 ELSE (l_tax - l_discount / 2) / l_tax END", "rel_dev") + " FROM lineitem")
def q_f20(spark, d):
    li = b.table(spark, d, "lineitem")
    return present(li.select("l_orderkey", "l_linenumber", "l_partkey",
                             fx.rel_deviation("l_tax", F.col("l_discount") / 2).alias("rel_dev")))


@register("a41_profile_table")
def q_a41(spark, d):
    return pr.profile_table(prof(spark, d), target="l_returnflag")


#: Columns of the profiled table with their types, kinds and (integers) distinct counts, as DuckDB sees them.
PROF_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
KINDS_SQL = "typed AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", any_value(typeof({c})) AS t, count(DISTINCT {c}) AS n_distinct FROM prof"
    for i, c in enumerate(PROF_COLS)) + """),
kinds AS (SELECT *, CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer'
  WHEN t IN ('FLOAT', 'DOUBLE') OR t LIKE 'DECIMAL%' THEN 'number' ELSE 'other' END AS kind FROM typed)"""


def _meta_sql(target: str) -> str:
    words = "|".join(pr.META_KEYWORDS)
    return f"""("column" <> {target} AND (kind = 'string' OR (kind = 'integer' AND n_distinct < 20)
    OR regexp_matches(lower("column"), '{words}')))"""


A41_SQL = with_ctes(PROF_SQL, KINDS_SQL) + f""", roles AS (
  SELECT position, "column", {_meta_sql("'l_returnflag'")} AS is_meta, kind IN ('integer', 'number') AS numeric FROM kinds),
coded AS (SELECT prof.*, (SELECT count(DISTINCT o.l_returnflag) FROM lineitem o WHERE o.l_returnflag < prof.l_returnflag) AS y FROM prof),
corrs AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs(corr({c}, y)) AS r FROM coded" for c in PROF_COLS[:6]) + """),
q AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in PROF_COLS) + """) AS rows_after_dropna,
  """ + " + ".join(f"count(*) - count({c})" for c in PROF_COLS) + """ AS total_nan FROM prof),
dup AS (SELECT CAST(sum(k - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS k FROM prof GROUP BY """ + ", ".join(PROF_COLS) + """))
SELECT 'l_returnflag' AS target_column, 'classification' AS task, "column", is_meta, numeric AND NOT is_meta AS is_feature,
  numeric AND NOT is_meta AND coalesce(r >= 0.98, false) AS is_leaky, numeric AND NOT is_meta AND NOT coalesce(r >= 0.98, false) AS is_recommended,
  CASE WHEN numeric AND NOT is_meta THEN round(r, 5) END AS correlation, n_rows, rows_after_dropna, total_nan,
  """ + r("total_nan / (n_rows * 8) * 100", "nan_pct") + """, n_duplicates
FROM roles LEFT JOIN corrs USING ("column"), q, dup"""


@register("a41_profile_columns", A41_SQL)
def q_a41_columns(spark, d):
    """The profile document spread over the columns it speaks of."""
    df = prof(spark, d)
    held = lambda kind: F.array_contains(kind, F.col("column"))
    p = pr.profile_table(df, target="l_returnflag").withColumn("column", F.explode(F.array(*[F.lit(c) for c in df.columns])))
    return present(p.select("target_column", "task", "column", held("meta_columns").alias("is_meta"), held("features").alias("is_feature"),
                            held("features_leaky").alias("is_leaky"), held("features_recommended").alias("is_recommended"),
                            F.try_element_at("correlations", F.col("column")).alias("correlation"), "n_rows", "rows_after_dropna",
                            "total_nan", "nan_pct", "n_duplicates"), ["nan_pct"])


@register("a42_profile_signals", with_ctes(b.SIGNALS_SQL, b.WEAR_SQL) + """, pp AS (
  SELECT tool, passe, count(DISTINCT i) AS samples FROM signals GROUP BY tool, passe),
pi AS (SELECT tool, count(*) AS n_passes, avg(samples) AS s FROM pp GROUP BY tool),
wi AS (SELECT tool, count(*) AS n_wear_rows, least(min(vb1), min(vb2), min(vb3)) AS lo, greatest(max(vb1), max(vb2), max(vb3)) AS hi,
       (avg(vb1) + avg(vb2) + avg(vb3)) / 3 AS mid FROM wear GROUP BY tool)
SELECT tool, n_passes, """ + r("s", "samples_per_pass") + ", " + r("s * 1000.0 / 50000.0", "duration_ms") + ", n_wear_rows, "
          + r("lo", "vb_min") + ", " + r("hi", "vb_max") + ", " + r("mid", "vb_mean") + """, 50000.0::DOUBLE AS sampling_rate_hz
FROM pi FULL OUTER JOIN wi USING (tool)""")
def q_a42(spark, d):
    from flankwear.operators import wear as wr
    return present(pr.profile_signals(wr.wear_inventory(wr.wear_table(b.raw_wear(spark, d))),
                                      wr.pass_inventory(b.signals(spark, d))))


ROLES_SQL = with_ctes(PROF_SQL, KINDS_SQL) + """, ranked AS (
  SELECT "column", 0 AS rule, list_position([""" + ", ".join(f"'{k}'" for k in [*pr.TARGET_KEYWORDS, *pr.EXTRA_TARGETS]) + """], lower("column")) AS o FROM kinds
  UNION ALL SELECT "column", 1, CASE WHEN kind = 'string' THEN -position END FROM kinds
  UNION ALL SELECT "column", 2, CASE WHEN kind IN ('integer', 'number') THEN -position END FROM kinds),
tgt AS (SELECT arg_min("column", (rule, o)) AS target FROM ranked WHERE o IS NOT NULL AND (rule > 0 OR o > 0)),
marked AS (SELECT kinds.*, target, """ + _meta_sql("target") + """ AS is_meta, kind IN ('integer', 'number') AS is_numeric FROM kinds, tgt)
SELECT "column", is_numeric, "column" = target AS is_target, is_meta, is_numeric AND NOT is_meta AND "column" <> target AS selected,
  CASE WHEN "column" = 'l_extendedprice' THEN 'price' WHEN "column" IN ('l_discount', 'l_tax') THEN 'rates'
       WHEN contains("column", 'flag') OR contains("column", 'status') THEN 'flags' END AS role FROM marked"""


@register("p09_p10_p12_p13_p15_column_roles", ROLES_SQL)
def q_roles(spark, d):
    """Schema rules on the profiled table: numeric columns, target, meta, selected features, roles."""
    df = prof(spark, d)
    tgt = pr.detect_target(df.schema)
    meta = pr.detect_meta(df, tgt)
    num = pr.numeric_cols(df)
    sel = pr.select_features(df, meta, [], tgt)
    roles = pr.detect_roles(df.schema, {"price": ["l_extendedprice"], "rates": ["l_discount", "l_tax"],
                                        "flags": ["flag", "status"]})
    role_of = {c: r for r, cs in roles.items() for c in cs}
    rows = [(c, c in num, c == tgt, c in meta, c in sel, role_of.get(c)) for c in df.columns]
    return spark.createDataFrame(rows, "column string, is_numeric boolean, is_target boolean, is_meta boolean, "
                                       "selected boolean, role string")
