"""Benchmark: headline plans at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each plan is forced with the ``noop`` writer (full evaluation, no column
pruning by ``count``).  Spark UI is off; an event log can be enabled with
``BENCH_EVENT_LOG=<dir>``.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flankwear.operators import evaluate as ev  # noqa: E402
from flankwear.operators import models as mo  # noqa: E402
from flankwear.operators import profile as pr  # noqa: E402
from flankwear.operators import signal_stats as ss  # noqa: E402
from flankwear.operators import spectral as sp  # noqa: E402
from flankwear.operators import stats as st  # noqa: E402
from flankwear.operators import wear as wr  # noqa: E402
from flankwear.plans import bindings as b  # noqa: E402
from flankwear.plans import q_fusion, q_models, q_spectral  # noqa: E402
from flankwear.session import checkpoint_dir, get_spark, write_stage  # noqa: E402


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def plans(spark, d):
    staged = {}

    def ingest():
        # S01 + rule R1: long signals with their sample index, written once as a stage table
        staged["sig"] = write_stage(b.signals(spark, d))
        return staged["sig"]

    out = {
        "s01_r1_ingest": ingest,
        "a15_pass_features": lambda: ss.extract_pass_features(staged["sig"], channels=b.EVENT_CHANNELS),
        "j01_label_join": lambda: wr.label_passes(
            ss.extract_pass_features(staged["sig"], channels=b.EVENT_CHANNELS),
            wr.wear_table(b.raw_wear(spark, d))),
        "g08_welch_features": lambda: sp.extract_spectral_features(
            b.spectral_signals(spark, d), q_spectral.spectral_wear(spark, d), b.SPECTRAL_FS, b.SPECTRAL_L,
            channels=b.EVENT_CHANNELS, f0=q_spectral.F0),
        "a41_profile": lambda: pr.profile_table(b.table(spark, d, "lineitem"), target="l_returnflag"),
        "a28_describe": lambda: pr.describe(b.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
        # one group holds all rows
        "w10_hot_group_ranks": lambda: st.avg_rank(b.table(spark, d, "lineitem"), "l_extendedprice"),
        "u01_fusion": lambda: q_fusion.fused(spark, d),
        "v05_m14_logistic_oof": lambda: mo.oof_predict(
            q_models._ml_table(spark, d), lambda n_rows, sigma_y: mo.make_model(
                "logistic_regression", "classification", n_rows=n_rows, scale=True), range(5), "logistic_regression"),
        "e01_e09_metrics": lambda: ev.classification_metrics(b.oof_classification(spark, d))
        .join(ev.fold_summary(b.oof_classification(spark, d), "classification")
              .select("model", "accuracy_std", "f1_macro_std"), "model"),
        "m11_knn_oof": lambda: mo.knn_oof(q_models.emb(spark, d), 5, "classification"),
        "x01_window_stats": lambda: __import__("flankwear.streaming.windows", fromlist=["x"]).tumbling_stats(
            b.table(spark, d, "events").select("ts", F.col("event_type").alias("channel"), F.col("value").alias("x")),
            "ts", "1 hour", ["channel"]),
    }
    if os.environ.get("BENCH_FOREST"):
        # the benchmark grid's forest (300 trees, depth 30): minutes per fit, so opt-in
        out["v05_m02_forest_oof"] = lambda: mo.oof_predict(
            q_models._ml_table(spark, d), lambda: mo.make_model("random_forest", "classification"), range(5),
            "random_forest")
    return out


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))  # protocol: warm-up, then the median of three runs
    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = get_spark(f"local[{cpus}]", app="flankwear-bench", shuffle_partitions=int(cpus) * 2, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    # warm-up: JVM code paths, Python workers for Arrow UDFs, one staged position plan
    from flankwear.operators.ordering import exact_quantiles
    reg = b.table(spark, d, "region")
    force(reg)
    force(exact_quantiles(reg.withColumn("g", F.lit(1)), ["g"], "r_regionkey", {"q": 0.5}))
    force(sp.welch(reg.select(F.lit("t").alias("tool"), F.lit(1).alias("passe"), F.lit("c").alias("channel"),
                              F.col("r_regionkey").cast("long").alias("i"), F.col("r_regionkey").cast("double").alias("x")),
                   1.0, 4))
    times = {}
    for name, mk in plans(spark, d).items():
        if name.startswith("_"):
            continue
        ts = []
        for _ in range(runs):
            t0 = time.time()
            force(mk())
            ts.append(time.time() - t0)
        times[name] = round(statistics.median(ts), 3)
    m = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
