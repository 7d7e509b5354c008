"""Bindings of the library's inputs to the driver's test tables.

Each binding is given twice: as a DataFrame builder (what the library reads)
and as a DuckDB CTE (what the oracle reads), so every registered query is
checked on the same derived data.  All bindings read whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flankwear.operators.ordering import with_position

# The five event types act as signal channels.
EVENT_CHANNELS = ["click", "error", "purchase", "signup", "view"]
# Event types read as the three flute measurements of the wear table.
FLUTE_TYPES = ["click", "view"]
N_TOOLS = 6


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- signals
def signals(spark: SparkSession, d: str, index: bool = True) -> DataFrame:
    """Long signals ``(tool, passe, channel, i, x)`` from ``events``.

    ``index=False`` skips the sample index for order-free statistics (no staging job)."""
    ev = table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % N_TOOLS).cast("string")).alias("tool"),
        F.dayofmonth("ts").cast("int").alias("passe"),
        F.col("event_type").alias("channel"),
        "event_id",
        F.col("value").alias("x"))
    if not index:
        return ev.drop("event_id")
    return with_position(ev, ["tool", "passe"], ["event_id"], name="i").drop("event_id")


SIGNALS_SQL = """signals AS (
  SELECT 'c' || CAST(user_id % 6 AS VARCHAR) AS tool, CAST(day(ts) AS INTEGER) AS passe,
         event_type AS channel,
         row_number() OVER (PARTITION BY user_id % 6, day(ts) ORDER BY event_id) - 1 AS i,
         value AS x
  FROM events)"""


SPECTRAL_FS = 25_000.0
SPECTRAL_L = 64


def spectral_signals(spark: SparkSession, d: str) -> DataFrame:
    """Longer series per (tool, channel): passe = ten-day block, i = order of event_id."""
    ev = table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % N_TOOLS).cast("string")).alias("tool"),
        (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("int").alias("passe"),
        F.col("event_type").alias("channel"), "event_id", F.col("value").alias("x"))
    return with_position(ev, ["tool", "passe", "channel"], ["event_id"], name="i").drop("event_id")


SPECTRAL_SIGNALS_SQL = """signals AS (
  SELECT 'c' || CAST(user_id % 6 AS VARCHAR) AS tool, CAST(floor((day(ts) - 1) / 10) + 1 AS INTEGER) AS passe,
         event_type AS channel,
         row_number() OVER (PARTITION BY user_id % 6, floor((day(ts) - 1) / 10), event_type ORDER BY event_id) - 1 AS i,
         value AS x
  FROM events)"""


def wide_signals(spark: SparkSession, d: str) -> DataFrame:
    """Wide pass rows from ``lineitem``: 4 channels, tool = returnflag, passe = suppkey."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("tool"), F.col("l_suppkey").cast("int").alias("passe"),
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")


WIDE_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE_SIGNALS_SQL = """signals AS (
  SELECT l_returnflag AS tool, CAST(l_suppkey AS INTEGER) AS passe, ch.channel, ch.x
  FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice),
                                 ('l_discount', l_discount), ('l_tax', l_tax)) AS ch(channel, x))"""


# ---------------------------------------------------------------- wear
def raw_wear(spark: SparkSession, d: str) -> DataFrame:
    """Raw wear file stand-in ``(tool, passe, vb1, vb2, vb3)`` in µm.

    Flute k is the running sum over passes of the day's mean value of one
    kind of event (the third: all kinds but the first two), divided by 10;
    flute 2 is missing every tenth pass.
    """
    ev = table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % N_TOOLS).cast("string")).alias("tool"),
        F.dayofmonth("ts").cast("int").alias("passe"), "event_type", "value")
    kinds = [F.col("event_type") == t for t in FLUTE_TYPES]
    daily = ev.groupBy("tool", "passe").agg(
        *[F.avg(F.when(k, F.col("value"))).alias(f"d{i + 1}") for i, k in enumerate([*kinds, ~F.col("event_type").isin(FLUTE_TYPES)])])
    w = Window.partitionBy("tool").orderBy("passe").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select("tool", "passe", *[(F.sum(f"d{k}").over(w) / 10.0).alias(f"vb{k}") for k in (1, 2, 3)])
    return out.withColumn("vb2", F.when(F.col("passe") % 10 != 0, F.col("vb2")))


RAW_WEAR_SQL = """daily AS (
  SELECT 'c' || CAST(user_id % 6 AS VARCHAR) AS tool, CAST(day(ts) AS INTEGER) AS passe,
         avg(CASE WHEN event_type = 'click' THEN value END) AS d1,
         avg(CASE WHEN event_type = 'view' THEN value END) AS d2,
         avg(CASE WHEN event_type NOT IN ('click', 'view') THEN value END) AS d3
  FROM events GROUP BY 1, 2),
raw_wear AS (
  SELECT tool, passe,
         sum(d1) OVER w / 10.0 AS vb1,
         CASE WHEN passe % 10 <> 0 THEN sum(d2) OVER w / 10.0 END AS vb2,
         sum(d3) OVER w / 10.0 AS vb3
  FROM daily WINDOW w AS (PARTITION BY tool ORDER BY passe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# Wear table after mean + per-tool unit rule (the library's ``wear_table``).
WEAR_SQL = RAW_WEAR_SQL + """,
wear0 AS (
  SELECT tool, passe, vb1, vb2, vb3,
         (coalesce(vb1, 0) + coalesce(vb2, 0) + coalesce(vb3, 0))
           / nullif((vb1 IS NOT NULL)::INT + (vb2 IS NOT NULL)::INT + (vb3 IS NOT NULL)::INT, 0) AS vb_raw
  FROM raw_wear),
wear AS (
  SELECT tool, passe, vb1, vb2, vb3,
         CASE WHEN max(vb_raw) OVER (PARTITION BY tool) > 10 THEN vb_raw / 1000.0 ELSE vb_raw END AS vb_mean
  FROM wear0)"""


def channel_signals(spark: SparkSession, d: str) -> DataFrame:
    """Long signals with the sample index counted per channel (for sample-wise joins)."""
    ev = table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % N_TOOLS).cast("string")).alias("tool"),
        F.dayofmonth("ts").cast("int").alias("passe"),
        F.col("event_type").alias("channel"), "event_id", F.col("value").alias("x"))
    return with_position(ev, ["tool", "passe", "channel"], ["event_id"], name="i").drop("event_id")


CHANNEL_SIGNALS_SQL = """signals AS (
  SELECT 'c' || CAST(user_id % 6 AS VARCHAR) AS tool, CAST(day(ts) AS INTEGER) AS passe,
         event_type AS channel,
         row_number() OVER (PARTITION BY user_id % 6, day(ts), event_type ORDER BY event_id) - 1 AS i,
         value AS x
  FROM events)"""


# ---------------------------------------------------------------- experiments, labels, runs, programs
# Order status read as the machining phase of an experiment sample.
PHASE_OF_STATUS = {"F": "Layer 1 Up", "O": "Layer 2 Down", "P": "Prep"}
EXP_SIGNALS = ["S1_OutputPower", "X1_OutputCurrent"]


def experiments(spark: SparkSession, d: str, index: bool = True) -> DataFrame:
    """Experiment time series from ``orders``: one experiment per customer (``i`` optional)."""
    o = table(spark, d, "orders")
    phase = F.when(F.col("o_orderstatus") == "F", PHASE_OF_STATUS["F"]) \
        .when(F.col("o_orderstatus") == "O", PHASE_OF_STATUS["O"]).otherwise(PHASE_OF_STATUS["P"])
    e = o.select(F.col("o_custkey").cast("int").alias("exp_id"), "o_orderkey",
                 phase.alias("Machining_Process"),
                 F.col("o_totalprice").alias("S1_OutputPower"),
                 F.substring("o_orderpriority", 1, 1).cast("double").alias("X1_OutputCurrent"))
    if not index:
        return e.drop("o_orderkey")
    return with_position(e, ["exp_id"], ["o_orderkey"], name="i").drop("o_orderkey")


EXPERIMENTS_SQL = """exps AS (
  SELECT CAST(o_custkey AS INTEGER) AS exp_id,
         CASE o_orderstatus WHEN 'F' THEN 'Layer 1 Up' WHEN 'O' THEN 'Layer 2 Down' ELSE 'Prep' END AS Machining_Process,
         o_totalprice AS S1_OutputPower, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS X1_OutputCurrent,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i
  FROM orders)"""


def exp_labels(spark: SparkSession, d: str) -> DataFrame:
    """``train.csv`` stand-in from ``customer``."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("int").alias("No"),
                    F.when(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE"), "worn")
                    .otherwise("unworn").alias("tool_condition"),
                    F.col("c_acctbal").alias("feedrate"), F.col("c_nationkey").cast("double").alias("clamp_pressure"))


EXP_LABELS_SQL = """labs AS (
  SELECT CAST(c_custkey AS INTEGER) AS No,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'worn' ELSE 'unworn' END AS tool_condition,
         c_acctbal AS feedrate, CAST(c_nationkey AS DOUBLE) AS clamp_pressure
  FROM customer)"""

RUN_ORDER = ["R_measurement", "l_partkey", "l_suppkey", "Ra", "Rz", "Rsk", "Rku", "l_shipdate"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Turning measurements from ``lineitem``: one run per order, one measurement per line."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("Run_ID"),
                     F.col("l_linenumber").alias("R_measurement"), "l_partkey", "l_suppkey", "l_shipdate",
                     F.col("l_quantity").alias("Ra"), F.col("l_extendedprice").alias("Rz"),
                     F.col("l_discount").alias("Rsk"), F.col("l_tax").alias("Rku"),
                     (F.col("l_discount") * 100 - 4).alias("Condition"),
                     F.col("l_returnflag").alias("Tool_ID"), F.col("l_linestatus").alias("Experiment"))


RUNS_SQL = """runs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS Run_ID, l_linenumber AS R_measurement, l_partkey, l_suppkey, l_shipdate,
         l_quantity AS Ra, l_extendedprice AS Rz, l_discount AS Rsk, l_tax AS Rku,
         l_discount * 100 - 4 AS Condition, l_returnflag AS Tool_ID, l_linestatus AS Experiment
  FROM lineitem)"""

ENERGIES = ["ENERGY|x", "ENERGY|y", "ENERGY|z", "ENERGY|S"]


def programs(spark: SparkSession, d: str) -> DataFrame:
    """Parsed-program rows from ``lineitem``: program = line status, four energy columns."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linestatus").alias("program"), F.col("l_returnflag").alias("Commands"),
                     F.col("l_quantity").alias("ENERGY|x"), F.col("l_extendedprice").alias("ENERGY|y"),
                     F.col("l_discount").alias("ENERGY|z"), F.col("l_tax").alias("ENERGY|S"))


# ---------------------------------------------------------------- out-of-fold prediction stand-ins
def oof_classification(spark: SparkSession, d: str) -> DataFrame:
    """Two deterministic rule 'models' predicting the order status."""
    o = table(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"),
                    F.col("o_orderstatus").alias("y_true"), "o_totalprice", "o_orderpriority")
    m1 = base.select(F.lit("01_PriceRule").alias("model"), "row_id", "fold", "y_true",
                     F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_totalprice") > 100000, "O")
                     .otherwise("P").alias("y_pred"))
    m2 = base.select(F.lit("02_PriorityRule").alias("model"), "row_id", "fold", "y_true",
                     F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F")
                     .when(F.col("o_orderpriority") == "3-MEDIUM", "O").otherwise("P").alias("y_pred"))
    return m1.unionByName(m2)


OOF_CLASS_SQL = """oof AS (
  SELECT '01_PriceRule' AS model, o_orderkey AS row_id, CAST(o_orderkey % 5 AS INTEGER) AS fold, o_orderstatus AS y_true,
         CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS y_pred FROM orders
  UNION ALL
  SELECT '02_PriorityRule', o_orderkey, CAST(o_orderkey % 5 AS INTEGER), o_orderstatus,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END
  FROM orders)"""


def oof_regression(spark: SparkSession, d: str) -> DataFrame:
    """Two 'models' predicting the order total from its line items."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net"),
        F.sum("l_extendedprice").alias("gross"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    base = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"),
                    F.col("o_totalprice").alias("y_true"), "net", "gross")
    return (base.select(F.lit("01_NetLines").alias("model"), "row_id", "fold", "y_true", F.col("net").alias("y_pred"))
            .unionByName(base.select(F.lit("02_GrossLines").alias("model"), "row_id", "fold", "y_true",
                                     F.col("gross").alias("y_pred"))))


OOF_REG_SQL = """li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS net,
                       sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1),
oof AS (
  SELECT '01_NetLines' AS model, o_orderkey AS row_id, CAST(o_orderkey % 5 AS INTEGER) AS fold, o_totalprice AS y_true,
         net AS y_pred FROM orders JOIN li ON o_orderkey = l_orderkey
  UNION ALL
  SELECT '02_GrossLines', o_orderkey, CAST(o_orderkey % 5 AS INTEGER), o_totalprice, gross
  FROM orders JOIN li ON o_orderkey = l_orderkey)"""
