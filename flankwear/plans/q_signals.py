"""Queries: signal statistics, wear labels and pass order."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import signal_stats as ss
from flankwear.operators import wear as wr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.sqlgen import moments_sql, present, r, with_ctes

CH = b.EVENT_CHANNELS
STATS = ss.STATS


def _wide_sql(src: str, keys: list[str], channels: list[str], stats: list[str]) -> str:
    cols = ", ".join(r(f"max(CASE WHEN channel = '{c}' THEN {s} END)", f"{c}_{s}")
                     for c in channels for s in stats)
    k = ", ".join(keys)
    return f"SELECT {k}, {cols} FROM {src} GROUP BY {k}"


# ------------------------------------------------------------------ A15 / J01
def pass_features(spark, d, checked=False):
    """A15 on the event-signal binding; ``checked`` rounds the long statistics
    for the oracle before the pivot (keeps the wide projection small)."""
    sig = b.signals(spark, d, index=False)
    if not checked:
        return ss.extract_pass_features(sig, channels=CH, rounded=False)
    long = present(ss.channel_stats(sig, ["tool", "passe", "channel"]))
    return ss.to_wide(long, ["tool", "passe"], CH)


register("a15_pass_features", with_ctes(b.SIGNALS_SQL, moments_sql("signals", ["tool", "passe", "channel"]))
         + _wide_sql("feat", ["tool", "passe"], CH, STATS))(
    lambda spark, d: pass_features(spark, d, checked=True))


def labeled_features(spark, d, checked=True):
    feats = pass_features(spark, d, checked=checked)
    wear = wr.wear_table(b.raw_wear(spark, d))
    return wr.label_passes(feats, wear, how="left", preset="three_state", missing="inconnu")


FLAGSHIP_SQL = (with_ctes(b.SIGNALS_SQL, b.WEAR_SQL, moments_sql("signals", ["tool", "passe", "channel"]),
                          "wide AS (" + _wide_sql("feat", ["tool", "passe"], CH, STATS).replace(" AS ", " AS ", ) + ")")
                + """SELECT wide.*, """ + r("w.vb_mean", "vb_mean") + """,
  CASE WHEN w.vb_mean IS NULL THEN 'inconnu' WHEN w.vb_mean < 0.1 THEN 'neuf'
       WHEN w.vb_mean < 0.2 THEN 'intermediaire' ELSE 'use' END AS etat
FROM wide LEFT JOIN wear w USING (tool, passe)""")
register("j01_label_passes", FLAGSHIP_SQL)(lambda spark, d: present(labeled_features(spark, d), ["vb_mean"]))


# ------------------------------------------------------------------ wear table
def _wear(spark, d):
    return wr.wear_table(b.raw_wear(spark, d))


register("f02_f03_wear_table", with_ctes(b.WEAR_SQL) + "SELECT tool, passe, " + ", ".join(
    [r("vb1", "vb1"), r("vb2", "vb2"), r("vb3", "vb3"), r("vb_mean", "vb_mean")]) + " FROM wear")(
    lambda spark, d: present(_wear(spark, d)))

STATE3 = "CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0.1 THEN 'neuf' WHEN {v} < 0.2 THEN 'intermediaire' ELSE 'use' END"
STATE4 = "CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0.1 THEN 'new' WHEN {v} < 0.2 THEN 'ok' WHEN {v} < 0.3 THEN 'worn' ELSE 'eol' END"
STATE2 = "CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0.2 THEN 'unworn' ELSE 'worn' END"


@register("f04_wear_state", with_ctes(b.WEAR_SQL) + "SELECT tool, passe, "
          + STATE3.format(v="vb_mean") + " AS state3, " + STATE4.format(v="vb_mean") + " AS state4, "
          + STATE2.format(v="vb_mean") + " AS state2 FROM wear")
def q_f04(spark, d):
    w = _wear(spark, d)
    return w.select("tool", "passe", fx.wear_state("vb_mean", "three_state").alias("state3"),
                    fx.wear_state("vb_mean", "four_state").alias("state4"),
                    fx.wear_state("vb_mean", "binary").alias("state2"))


@register("f05_worn_label", with_ctes(b.WEAR_SQL) + """SELECT tool, passe,
  CASE WHEN vb2 / 1000.0 IS NULL THEN 'unknown' WHEN vb2 / 1000.0 >= 0.2 THEN 'worn' ELSE 'unworn' END AS label
FROM wear""")
def q_f05(spark, d):
    return _wear(spark, d).select("tool", "passe", fx.worn_label(F.col("vb2") / 1000.0).alias("label"))


RIGHT = ("CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 0.1 THEN 'New (<0.1)' WHEN {v} <= 0.2 THEN 'Acceptable (0.1-0.2)' "
         "WHEN {v} <= 0.3 THEN 'Worn (0.2-0.3)' ELSE 'EOL (>0.3)' END")


@register("f06_cut_right", with_ctes(b.WEAR_SQL) + "SELECT tool, passe, " + RIGHT.format(v="vb_mean")
          + " AS wear_class FROM wear")
def q_f06(spark, d):
    return _wear(spark, d).select("tool", "passe", fx.cut_right("vb_mean").alias("wear_class"))


@register("a25_wear_distribution", with_ctes(b.WEAR_SQL, "cls AS (SELECT tool, " + RIGHT.format(v="vb_mean")
                                             + " AS c FROM wear)") + """SELECT tool,
  count(*) FILTER (WHERE c = 'New (<0.1)') AS "New (<0.1)",
  count(*) FILTER (WHERE c = 'Acceptable (0.1-0.2)') AS "Acceptable (0.1-0.2)",
  count(*) FILTER (WHERE c = 'Worn (0.2-0.3)') AS "Worn (0.2-0.3)",
  count(*) FILTER (WHERE c = 'EOL (>0.3)') AS "EOL (>0.3)"
FROM cls GROUP BY tool""")
def q_a25(spark, d):
    return wr.wear_distribution(_wear(spark, d))


@register("a36_wear_inventory", with_ctes(b.WEAR_SQL) + """SELECT tool, count(*) AS n_passes,
  """ + r("least(min(vb1), min(vb2), min(vb3))", "vb_min") + ", " + r("greatest(max(vb1), max(vb2), max(vb3))", "vb_max") + """,
  """ + r("(avg(vb1) + avg(vb2) + avg(vb3)) / 3", "vb_mean") + " FROM wear GROUP BY tool")
def q_a36(spark, d):
    return present(wr.wear_inventory(_wear(spark, d)))


@register("a37_pass_inventory", with_ctes(b.SIGNALS_SQL) + """, pp AS (
  SELECT tool, passe, count(DISTINCT i) AS samples FROM signals GROUP BY tool, passe)
SELECT tool, count(*) AS n_passes, """ + r("avg(samples)", "samples_per_pass") + ", "
          + r("avg(samples) * 1000.0 / 50000.0", "duration_ms") + " FROM pp GROUP BY tool")
def q_a37(spark, d):
    return present(wr.pass_inventory(b.signals(spark, d), fs=50_000))


GRAD_SQL = """grad AS (
  SELECT tool, passe, vb_mean,
    CASE WHEN lag(vb_mean) OVER w IS NULL AND lead(vb_mean) OVER w IS NULL THEN NULL
         WHEN lag(vb_mean) OVER w IS NULL THEN lead(vb_mean) OVER w - vb_mean
         WHEN lead(vb_mean) OVER w IS NULL THEN vb_mean - lag(vb_mean) OVER w
         ELSE (lead(vb_mean) OVER w - lag(vb_mean) OVER w) / 2.0 END AS rate
  FROM wear WINDOW w AS (PARTITION BY tool ORDER BY passe))"""


@register("w01_wear_rate", with_ctes(b.WEAR_SQL, GRAD_SQL) + "SELECT tool, passe, "
          + r("vb_mean", "vb_mean") + ", " + r("rate", "rate") + " FROM grad")
def q_w01(spark, d):
    return present(wr.wear_rate(_wear(spark, d)))


@register("w02_rolling_mean", with_ctes(b.WEAR_SQL, GRAD_SQL) + """SELECT tool, passe, """ + r("rate", "rate")
          + ", " + r("""CASE WHEN count(rate) OVER w5 = 5 THEN avg(rate) OVER w5 END""", "rate_roll5") + """
FROM grad WINDOW w5 AS (PARTITION BY tool ORDER BY passe ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_w02(spark, d):
    return present(wr.rolling_mean(wr.wear_rate(_wear(spark, d)), "rate", 5))


@register("w03_first_last_pass", with_ctes(b.WEAR_SQL)
          + "SELECT tool, min(passe) AS first_passe, max(passe) AS last_passe FROM wear GROUP BY tool")
def q_w03(spark, d):
    return wr.first_last_pass(_wear(spark, d))


@register("w04_nth_pass", with_ctes(b.SIGNALS_SQL) + """, p AS (
  SELECT tool, passe, row_number() OVER (PARTITION BY tool ORDER BY passe) - 1 AS pos,
         count(*) OVER (PARTITION BY tool) AS n FROM (SELECT DISTINCT tool, passe FROM signals))
SELECT tool, passe FROM p WHERE pos = least(greatest(10, 0), n - 1)""")
def q_w04(spark, d):
    return wr.nth_pass(b.signals(spark, d, index=False), 10)


@register("w09_feature_evolution", with_ctes(b.SIGNALS_SQL, moments_sql("signals", ["tool", "passe", "channel"]))
          + "SELECT tool, passe, " + r("max(CASE WHEN channel = 'click' THEN rms END)", "click_rms")
          + " FROM feat GROUP BY tool, passe")
def q_w09(spark, d):
    return present(wr.feature_evolution(pass_features(spark, d), "click_rms"))


@register("j02_label_inner", with_ctes(b.SIGNALS_SQL, b.WEAR_SQL, moments_sql("signals", ["tool", "passe", "channel"]))
          + """SELECT f.tool, f.passe, """ + r("max(CASE WHEN channel = 'view' THEN f.rms END)", "view_rms") + ", "
          + r("w.vb_mean", "vb_mean") + ", " + STATE4.format(v="w.vb_mean") + """ AS etat
FROM feat f JOIN wear w USING (tool, passe) GROUP BY f.tool, f.passe, w.vb_mean""")
def q_j02(spark, d):
    long = ss.channel_stats(b.signals(spark, d, index=False))
    wide = ss.to_wide(long, channels=["view"], stats=["rms"])
    return present(wr.label_passes(wide, _wear(spark, d), how="inner", preset="four_state", missing=None))


@register("j04_unlabeled", with_ctes(b.SIGNALS_SQL, b.WEAR_SQL) + """SELECT DISTINCT s.tool, s.passe FROM signals s
WHERE NOT EXISTS (SELECT 1 FROM wear w WHERE w.tool = s.tool AND w.passe = s.passe)""")
def q_j04(spark, d):
    return wr.unlabeled(b.signals(spark, d, index=False).select("tool", "passe").distinct(), _wear(spark, d))


@register("j04_without_worn_label", with_ctes(b.SIGNALS_SQL, b.WEAR_SQL) + """SELECT DISTINCT s.tool, s.passe FROM signals s
WHERE NOT EXISTS (SELECT 1 FROM wear w WHERE w.tool = s.tool AND w.passe = s.passe AND w.vb_mean >= 0.1)""")
def q_j04_worn(spark, d):
    """Passes for which no wear beyond the new state was measured."""
    return wr.unlabeled(b.signals(spark, d, index=False).select("tool", "passe").distinct(), _wear(spark, d).where("vb_mean >= 0.1"))


@register("j06_compare_passes", with_ctes(b.CHANNEL_SIGNALS_SQL) + """, a AS (
  SELECT channel, i, x AS x_first FROM signals WHERE tool = 'c1' AND passe = 1),
bb AS (SELECT channel, i, x AS x_last FROM signals WHERE tool = 'c1' AND passe = 30)
SELECT coalesce(a.channel, bb.channel) AS channel, coalesce(a.i, bb.i) AS i, """
          + r("x_first", "x_first") + ", " + r("x_last", "x_last") + ", " + r("x_last - x_first", "diff") + """
FROM a FULL OUTER JOIN bb ON a.channel = bb.channel AND a.i = bb.i""")
def q_j06(spark, d):
    return present(wr.compare_passes(b.channel_signals(spark, d), "c1", 1, 30))


@register("a17_window_stats", with_ctes(b.CHANNEL_SIGNALS_SQL) + """SELECT tool, passe, channel, """
          + r("sqrt(avg(x * x))", "rms") + ", " + r("max(x) - min(x)", "p2p") + """, count(x) AS n
FROM signals WHERE i < 5 GROUP BY tool, passe, channel""")
def q_a17(spark, d):
    # 40 ms at a 125 Hz stand-in sampling rate = the first 5 samples of each channel
    return present(ss.window_stats(b.channel_signals(spark, d), ms=40.0, fs=125.0))


@register("a18_rms_ratio", with_ctes(b.SIGNALS_SQL) + """, ends AS (SELECT tool, min(passe) AS a, max(passe) AS b FROM signals GROUP BY tool),
power AS (SELECT tool, channel, sqrt(avg(CASE WHEN passe = a THEN x * x END)) AS first, sqrt(avg(CASE WHEN passe = b THEN x * x END)) AS last
          FROM signals JOIN ends USING (tool) WHERE passe IN (a, b) GROUP BY tool, channel)
SELECT tool, channel, """ + r("first", "rms_first") + ", " + r("last", "rms_last") + ", " + r("last / nullif(first, 0)", "ratio") + " FROM power")
def q_a18(spark, d):
    return present(ss.rms_ratio(b.signals(spark, d, index=False)))


@register("f12_p08_time_axis", with_ctes(b.CHANNEL_SIGNALS_SQL) + """SELECT tool, passe, channel, i, """
          + r("i / 125.0 * 1000.0", "t_ms") + " FROM signals WHERE i < 5")
def q_f12(spark, d):
    h = ss.window_head(b.channel_signals(spark, d), ms=40.0, fs=125.0)
    return present(fx.with_time(h, 125.0).select("tool", "passe", "channel", "i", "t_ms"))


@register("a11_energy_mean", with_ctes(b.SIGNALS_SQL, moments_sql("signals", ["tool", "passe", "channel"]))
          + "SELECT tool, passe, channel, n, " + r("energy", "energy") + ", " + r("energy_mean", "energy_mean")
          + " FROM feat")
def q_a11(spark, d):
    return present(ss.channel_stats(b.signals(spark, d, index=False)).select("tool", "passe", "channel", "n", "energy",
                                                                "energy_mean"))


@register("a15_wide_signals", with_ctes(b.WIDE_SIGNALS_SQL, moments_sql("signals", ["tool", "passe", "channel"]))
          + _wide_sql("feat", ["tool", "passe"], b.WIDE_CHANNELS, STATS))
def q_a15_wide(spark, d):
    long = b.wide_signals(spark, d).unpivot(["tool", "passe"], b.WIDE_CHANNELS, "channel", "x")
    return ss.to_wide(present(ss.channel_stats(long)), ["tool", "passe"], b.WIDE_CHANNELS)


# ------------------------------------------------------------------ file-name keys (S03, S04) on derived paths
def _paths(spark, d):
    ev = b.table(spark, d, "events")
    t = (F.col("user_id") % 6).cast("string")
    day = F.lpad(F.dayofmonth("ts").cast("string"), 3, "0")
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("c"), t, F.lit("_wear.csv"))) \
        .otherwise(F.concat(F.lit("c_"), t, F.lit("_"), day, F.lit(".csv")))
    return ev.select(F.concat(F.lit("/data/c"), t, F.lit("/"), name).alias("file"))


@register("s03_s04_file_keys", """WITH p AS (SELECT '/data/c' || CAST(user_id % 6 AS VARCHAR) || '/' ||
  CASE WHEN event_type = 'error' THEN 'c' || CAST(user_id % 6 AS VARCHAR) || '_wear.csv'
       ELSE 'c_' || CAST(user_id % 6 AS VARCHAR) || '_' || lpad(CAST(day(ts) AS VARCHAR), 3, '0') || '.csv' END AS file FROM events),
k AS (SELECT 'c' || regexp_extract(file, 'c_(\\d+)_(\\d+)\\.csv$', 1) AS tool,
             TRY_CAST(regexp_extract(file, 'c_(\\d+)_(\\d+)\\.csv$', 2) AS INTEGER) AS passe,
             split(file, '/')[-2] AS tool_dir, regexp_extract(file, 'c_(\\d+)_(\\d+)\\.csv$', 1) AS t FROM p)
SELECT tool, passe, tool_dir, count(*) AS n FROM k WHERE t <> '' AND passe IS NOT NULL GROUP BY 1, 2, 3""")
def q_s03(spark, d):
    from flankwear.sources.files import with_pass_key, with_tool_dir
    k = with_tool_dir(with_pass_key(_paths(spark, d)))
    return k.groupBy("tool", "passe", "tool_dir").agg(F.count(F.lit(1)).alias("n"))


@register("x01_tumbling_window_stats", """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type AS channel, """
          + r("sqrt(avg(value * value))", "rms") + ", " + r("max(value) - min(value)", "p2p") + """, count(value) AS n
FROM events GROUP BY 1, 2, 3""")
def q_x01(spark, d):
    from flankwear.streaming.windows import tumbling_stats
    ev = b.table(spark, d, "events").select("ts", F.col("event_type").alias("channel"), F.col("value").alias("x"))
    return present(tumbling_stats(ev, "ts", "6 hours", ["channel"]))
