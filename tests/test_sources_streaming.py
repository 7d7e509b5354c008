"""File sources, sinks and streaming on small files written to a temporary folder."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwear.sources import files as fs
from flankwear.sources import sinks as sk
from flankwear.streaming import windows as sw


def _write_pass(d, tool, passe, n=50, cols=7):
    rng = np.random.default_rng(passe)
    x = rng.normal(size=(n, cols))
    p = d / f"c{tool}" / f"c_{tool}_{passe:03d}.csv"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(",".join(f"{v:.6f}" for v in row) for row in x) + "\n")
    return x


def test_read_signals_order_keys_and_features(spark, tmp_path):
    x1 = _write_pass(tmp_path, 1, 1)
    _write_pass(tmp_path, 1, 2)
    (tmp_path / "c1" / "c1_wear.csv").write_text("1,10,20,30\n2,11,21,31\n")
    sig = fs.with_tool_dir(fs.with_pass_key(fs.read_signals(spark, str(tmp_path))))
    assert sig.select("passe").distinct().count() == 2
    first = sig.where("passe = 1 AND channel = 'force_x'").orderBy("i").toPandas()
    assert np.allclose(first.x.to_numpy(), x1[:, 0], atol=1e-6)
    assert set(r.tool_dir for r in sig.select("tool_dir").distinct().collect()) == {"c1"}
    from flankwear.operators.signal_stats import extract_pass_features
    feats = extract_pass_features(sig.select("tool", "passe", "channel", "i", "x"))
    assert feats.count() == 2 and "ae_iqr" in feats.columns
    wear = fs.read_wear(spark, str(tmp_path))
    assert wear.count() == 2


def test_classify_source_and_readers(spark, tmp_path):
    from pyspark.sql import types as T
    raw = T.StructType([T.StructField(f"_c{i}", T.DoubleType()) for i in range(7)])
    assert fs.classify_source(raw) == "raw_signals"
    feat = T.StructType([T.StructField(f"force_x_{s}", T.DoubleType()) for s in range(11)])
    assert fs.classify_source(feat) == "feature_table"
    (tmp_path / "experiment_01.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "experiment_02.csv").write_text("a,b\n5,6\n")
    e = fs.read_experiments(spark, str(tmp_path / "experiment_*.csv"))
    assert sorted(r.exp_id for r in e.select("exp_id").distinct().collect()) == [1, 2]
    m = fs.read_many(spark, [str(tmp_path / "experiment_01.csv"), str(tmp_path / "missing.csv")])
    assert m.count() == 2
    with pytest.raises(FileNotFoundError):
        fs.read_many(spark, [str(tmp_path / "nope.csv")])


def test_readers_go_by_name_and_by_file(spark, tmp_path):
    w = tmp_path / "w"
    w.mkdir()
    (w / "c1_wear.csv").write_text("cut,flute_1,flute_2,flute_3\n1,10,20,30\n")
    (w / "c2_wear.csv").write_text("flute_3,cut,flute_1,flute_2\n33,2,11,22\n")
    (w / "c3_wear.csv").write_text("cut,a,b,c\n9,9,9,9\n")
    got = sorted(map(tuple, fs.read_wear(spark, str(w), header=True).collect()))
    assert got == [("c1", 1, 10.0, 20.0, 30.0), ("c2", 2, 11.0, 22.0, 33.0)]
    v = tmp_path / "v"
    v.mkdir()
    (v / "c1_wear.csv").write_text("1,10\n2,11\n")
    (v / "c4_wear.csv").write_text("cut,f1,f2,f3,note\n1,1,2,3,x\n")
    (v / "c5_wear.csv").write_text("1,2,3\n")
    got = sorted(map(tuple, fs.read_wear(spark, str(v)).collect()))
    assert got == [("c1", 1, 10.0, None, None), ("c1", 2, 11.0, None, None), ("c4", 1, 1.0, 2.0, 3.0)]
    e = tmp_path / "e"
    e.mkdir()
    (e / "experiment_01.csv").write_text("a,b\n1,2\n")
    (e / "experiment_02.csv").write_text("b,a,c\n20,10,30\n")
    rows = fs.read_experiments(spark, str(e / "experiment_*.csv")).select("exp_id", "a", "b", "c").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == [(1, 1, 2, None), (2, 10, 20, 30)]
    (e / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        fs.read_many(spark, [str(e / "broken.parquet")]).collect()


def test_probe_source(spark, tmp_path):
    raw = tmp_path / "raw"
    _write_pass(raw, 1, 1, n=5)
    (raw / "c1" / "c1_wear.csv").write_text("cut,f1\n1,2\n")
    assert fs.probe_source(spark, str(raw)) == "raw_signals"
    (tmp_path / "f.csv").write_text(",".join(f"force_x_{i}" for i in range(12)) + "\n" + ",".join("1.5" for _ in range(12)) + "\n")
    assert fs.probe_source(spark, str(tmp_path / "f.csv")) == "feature_table"
    (tmp_path / "m.csv").write_text("a,label\n1.5,worn\n")
    assert fs.probe_source(spark, str(tmp_path / "m.csv")) == "mixed_table"


def test_signal_index_over_file_blocks(spark, tmp_path):
    x = _write_pass(tmp_path, 1, 1, n=400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = fs.read_signals(spark, str(tmp_path), long=False).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.i for r in rows] == list(range(400)) and np.allclose([r.ae for r in rows], x[:, 6], atol=1e-6)


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1, 0.1), ("c4", 2, 0.2)], "tool string, passe int, vb double")
    sk.write_features(df, str(tmp_path / "feats"))
    assert {"tool=c1", "tool=c4"} <= set(os.listdir(tmp_path / "feats"))
    sk.write_profile(df.limit(1), str(tmp_path / "prof"), "step1")
    assert fs.read_profile(spark, str(tmp_path / "prof")).first().step == "step1"
    prof = spark.createDataFrame([({"a": 0.5, "b": 0.25},)], "correlations map<string,double>")
    sk.write_profile(prof, str(tmp_path / "prof2"), "profile")
    back = fs.read_profile(spark, str(tmp_path / "prof2"))
    assert sorted(r.key for r in fs.profile_maps_long(back.select(
        F.from_json(F.to_json("correlations"), "map<string,double>").alias("correlations"))).collect()) == ["a", "b"]
    sk.write_summary(df, str(tmp_path / "summary"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "summary")).count() == 2


def test_stream_matches_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "ts", F.col("event_type").alias("channel"), F.col("value").alias("x"))
    src = tmp_path / "in"
    ev.write.parquet(str(src))
    q = sw.stream_window_stats(spark, str(src), ev.schema, "ts", "1 day", ["channel"], "x",
                               str(tmp_path / "out"), str(tmp_path / "ck"), watermark="0 seconds")
    q.processAllAvailable()
    q.stop()
    batch = sw.tumbling_stats(ev, "ts", "1 day", ["channel"])
    got = spark.read.parquet(str(tmp_path / "out"))
    # append mode emits windows closed by the watermark; every emitted window equals the batch twin
    assert got.count() > 0
    diff = got.select("window_start", "channel", "n").subtract(
        batch.select(F.col("window_start").cast("timestamp").alias("window_start"), "channel", "n"))
    assert diff.count() == 0


def test_incremental_pass_features(spark, tmp_path):
    _write_pass(tmp_path / "in", 1, 1)
    _write_pass(tmp_path / "in", 1, 2)
    q = sw.incremental_pass_features(spark, str(tmp_path / "in" / "c1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2
    q = sw.incremental_pass_features(spark, str(tmp_path / "in" / "c1"), str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination(120)     # a replay from a lost checkpoint overwrites the batch
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
