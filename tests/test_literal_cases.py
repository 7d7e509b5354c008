"""Hand-computed cases (FIXTURES §4)."""
import math

import pytest
from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import balance as ba
from flankwear.operators import evaluate as ev
from flankwear.operators import fusion as fu
from flankwear.operators import profile as pr
from flankwear.operators import signal_stats as ss
from flankwear.operators import stats as st
from flankwear.operators import wear as wr


def sig(spark, xs, ch="force_x"):
    return spark.createDataFrame([("c1", 1, ch, i, x) for i, x in enumerate(xs)],
                                 "tool string, passe int, channel string, i long, x double")


def stats_of(spark, xs):
    return ss.channel_stats(sig(spark, xs)).first().asDict()


def test_basic_features(spark):
    r = stats_of(spark, [1.0, 2.0, 3.0, 4.0])
    assert r["mean"] == pytest.approx(2.5)
    assert r["std"] == pytest.approx(math.sqrt(1.25))
    assert r["rms"] == pytest.approx(math.sqrt(7.5))
    assert r["max"] == 4 and r["p2p"] == 3
    assert r["skew"] == pytest.approx(0.0, abs=1e-12)
    assert r["kurt"] == pytest.approx(-1.36)
    assert r["crest"] == pytest.approx(4 / math.sqrt(7.5))
    assert r["energy"] == pytest.approx(30.0) and r["energy_mean"] == pytest.approx(7.5)
    assert (r["p25"], r["p75"], r["iqr"]) == pytest.approx((1.75, 3.25, 1.5))


def test_sign_and_zero_and_missing(spark):
    r = stats_of(spark, [-5.0, 1.0])
    assert (r["max"], r["mean"], r["p2p"]) == (5.0, -2.0, 6.0)
    z = stats_of(spark, [0.0, 0.0, 0.0])
    assert (z["rms"], z["crest"], z["shape"], z["energy"]) == (0.0, 0.0, 0.0, 0.0)
    m = stats_of(spark, [None, 1.0, 3.0])
    n = stats_of(spark, [1.0, 3.0])
    assert {k: v for k, v in m.items() if k != "n"} == pytest.approx({k: v for k, v in n.items() if k != "n"})


def test_empty_and_constant(spark):
    e = stats_of(spark, [None, None])
    assert all(e[s] is None for s in ss.STATS)
    c = stats_of(spark, [5.0, 5.0, 5.0])
    assert c["std"] == 0 and c["skew"] is None and c["kurt"] is None


def test_wear_mean_and_units(spark):
    raw = spark.createDataFrame([("c1", 1, 40.0, None, 60.0), ("c1", 2, 5.0, 5.0, 5.0)],
                                "tool string, passe int, vb1 double, vb2 double, vb3 double")
    w = {r.passe: r.vb_mean for r in wr.wear_table(raw).collect()}
    assert w[1] == pytest.approx(0.05) and w[2] == pytest.approx(0.005)


def test_header_row_dropped(spark, tmp_path):
    d = tmp_path / "c1"
    d.mkdir()
    (d / "c1_wear.csv").write_text("cut,flute_1,flute_2,flute_3\n1,10,20,30\n2,11,21,31\n")
    from flankwear.sources.files import read_wear
    rows = sorted(read_wear(spark, str(tmp_path)).collect())
    assert [(r.tool, r.passe, r.vb1) for r in rows] == [("c1", 1, 10.0), ("c1", 2, 11.0)]


def test_state_bins_and_labels(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.1999,), (None,)], "vb double")
    out = df.select(fx.wear_state("vb", "three_state").alias("s"), fx.cut_right("vb").alias("c"),
                    fx.worn_label("vb").alias("w")).collect()
    assert [r.s for r in out[:3]] == ["intermediaire", "use", "use"]
    assert [r.c for r in out[:3]] == ["New (<0.1)", "Acceptable (0.1-0.2)", "Worn (0.2-0.3)"]
    assert [r.w for r in out[1:]] == ["worn", "worn", "unworn", "unknown"]


def test_gradient_and_rolling(spark):
    df = spark.createDataFrame([("c1", p, v) for p, v in zip([1, 2, 3, 4], [1.0, 2.0, 4.0, 7.0])],
                               "tool string, passe int, vb_mean double")
    g = [r.rate for r in wr.wear_rate(df).orderBy("passe").collect()]
    assert g == [1.0, 1.5, 2.5, 3.0]
    six = spark.createDataFrame([("c1", p, float(p)) for p in range(1, 7)], "tool string, passe int, v double")
    r5 = [r.v_roll5 for r in wr.rolling_mean(six, "v", 5).orderBy("passe").collect()]
    assert r5 == [None, None, 3.0, 4.0, None, None]


def test_pass_name(spark):
    from flankwear.sources.files import with_pass_key
    df = spark.createDataFrame([("/d/c1/c_1_042.csv",), ("/d/c1/c1_wear.csv",), ("/d/notes.csv",)], "file string")
    assert [(r.tool, r.passe) for r in with_pass_key(df).collect()] == [("c1", 42)]


def test_class_weights_strategy_folds_task(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "y string")
    w = {r["class"]: r.weight for r in ba.class_weights(df, "y").collect()}
    assert w == {"a": 0.5556, "b": 1.1111, "c": 3.3333}
    cases = spark.createDataFrame([(1.2, 900), (3.0, 900), (8.0, 400), (8.0, 900)], "r double, n long")
    assert [r.s for r in cases.select(ba.recommend_strategy("r", "n").alias("s")).collect()] == \
        ["none", "class_weight", "class_weight", "smote"]
    three = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3, "y string")
    one = spark.createDataFrame([("a",)] * 5 + [("b",)], "y string")
    assert ba.n_splits(three, "y").first()[0] == 3 and ba.n_splits(one, "y").first()[0] == 2
    t15 = spark.createDataFrame([(float(i % 15),) for i in range(100)], "t double")
    t16 = spark.createDataFrame([(float(i % 16),) for i in range(100)], "t double")
    t400 = spark.createDataFrame([(float(i % 16),) for i in range(400)], "t double")
    assert [pr.task_stats(d, ["t"]).first().task for d in (t15, t16, t400)] == \
        ["classification", "regression", "classification"]


def test_f1_macro_and_rel_dev(spark):
    oof = spark.createDataFrame([("m", 1, 0, "a", "a"), ("m", 2, 0, "a", "b"), ("m", 3, 0, "b", "b")],
                                "model string, row_id long, fold int, y_true string, y_pred string")
    assert ev.classification_metrics(oof).first().f1_macro == pytest.approx(2 / 3)
    df = spark.createDataFrame([(0.0, 3.0), (4.0, 3.0)], "y double, p double")
    assert [r.d for r in df.select(fx.rel_deviation("y", "p").alias("d")).collect()] == [0.0, 0.25]


def test_kruskal(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g2", 3.0), ("g2", 4.0), ("g3", 5.0), ("g3", 6.0)],
                               "g string, x double")
    r = st.kruskal(df, "x", "g").first()
    assert r.H == pytest.approx(4.5714, abs=1e-4) and r.p == pytest.approx(math.exp(-r.H / 2), rel=1e-9)


def test_union_and_availability(spark):
    a = spark.createDataFrame([("s1", 1.0)], "source string, x double")
    b = spark.createDataFrame([("s2", 2.0), ("s2", 3.0)], "source string, y double")
    u = fu.fuse(a, b)
    assert u.count() == 3 and u.where("source = 's1'").first().y is None
    av = spark.createDataFrame([("s", 1.0, None), ("s", 1.0, 2.0)], "source string, p double, q double")
    assert fu.availability(av, {"g": ["p", "q"]}).first().availability == 0.5


def test_shared_columns_and_set_ops(spark):
    m = spark.createDataFrame([("force", "phm"), ("force", "exp"), ("force", "turning"), ("current", "exp"),
                               ("current", "turning"), ("ae", "phm")], "feature string, source string")
    out = {r.feature: (r.sharing, r.n_datasets) for r in fu.shared_columns(m).collect()}
    assert out == {"force": ("all", 3), "current": ("several", 2), "ae": ("unique", 1)}
    a = m.where("source = 'phm'").select("feature")
    b = m.where("source = 'exp'").select("feature")
    assert sorted(r.feature for r in fu.only_in(a, b).collect()) == ["ae"]
    assert sorted(r.feature for r in fu.in_both(a, b).collect()) == ["force"]


def test_sizing():
    from flankwear.session import partitions_for
    assert partitions_for(100 * 2 ** 40, cores=8000) == 819200 and partitions_for(10, cores=4) == 8


def test_target_meta_and_groups(spark):
    from flankwear.functions import scalar as fx
    from flankwear.operators import profile as pr
    df = spark.createDataFrame([(i, i % 3, i % 40, "x", float(i), "u", i) for i in range(60)],
                               "a int, few int, many int, Label string, force_x double, note string, run_no int")
    assert pr.detect_target(df.schema) == "Label" and pr.detect_target(df.schema, target="a") == "a"
    assert pr.detect_target(df.select("a", "note", "many").schema) == "note"
    assert pr.detect_target(df.select("a", "many").schema) == "many"
    assert pr.detect_meta(df, "Label") == ["few", "note", "run_no"]
    names = ["force_x", "ae_rms", "S1_x", "Ra", "Rank", "Fx", "F", "f", "vc", "zz", "Rt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(fx.feature_group("n").alias("g")).collect()
    assert [r.g for r in got] == ["pass_signals", "pass_signals", "motor_signals", "roughness", "other", "forces", "forces",
                                  "cutting_params", "cutting_params", "other", "roughness"]


def test_distinct_counts_without_row_copies(spark, monkeypatch):
    """Exact counts of every kind of column; cells are handed on when a task holds many; no Expand in the plan."""
    import datetime
    from decimal import Decimal
    from flankwear.operators import profile as pr
    nan = float("nan")
    rows = [(k % 7 if k % 11 else None, [0.0, -0.0, nan, 1.5, None][k % 5], f"t{k % 13}" * (40 if k % 2 else 1), k % 3 == 0, Decimal(k % 9) / 4,
             datetime.date(2020, 1, 1 + k % 20), [k % 4], k, bytes([k % 6]), None) for k in range(900)]
    schema = "a int, b double, c string, d boolean, e decimal(10,2), f date, g array<int>, h long, i binary, j string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    want = {0: 7, 1: 3, 2: 26, 3: 2, 4: 9, 5: 20, 6: 4, 7: 900, 8: 6}
    for limit in (500_000, 50):
        monkeypatch.setattr(pr, "DISTINCT_CELLS", limit)
        got = pr.distinct_counts(df, df.columns)
        assert {r.i: r.n_distinct for r in got.collect()} == want
        assert "Expand" not in got._jdf.queryExecution().toString()
    cat = {r.column: (r.non_null, r.n_distinct) for r in pr.column_catalog(df.drop("g", "i")).collect()}
    assert cat["j"] == (0, 0) and cat["h"] == (900, 900) and cat["b"] == (720, 3)
    dup = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, "a"), ("a", "a")], "x string, y string")
    assert tuple(pr.duplicate_count(dup).first()) == (2, 5)
    assert tuple(pr.duplicate_count(dup.limit(0)).first()) == (0, 0)


def test_rms_ratio_takes_each_tools_own_passes(spark):
    from flankwear.operators.signal_stats import rms_ratio
    rows = [("a", 2, "x", 3.0), ("a", 2, "x", None), ("a", 5, "x", 6.0), ("a", 5, "x", -6.0), ("a", 3, "x", 99.0),
            ("a", 2, "y", 1.0), ("b", 1, "x", 2.0), ("b", None, "x", 50.0), (None, 7, "x", 4.0)]
    sig = spark.createDataFrame(rows, "tool string, passe int, channel string, x double")
    got = {(r["tool"], r["channel"]): (r["rms_first"], r["rms_last"], r["ratio"]) for r in rms_ratio(sig).collect()}
    assert got == {("a", "x"): (3.0, 6.0, 2.0), ("a", "y"): (1.0, None, None), ("b", "x"): (2.0, 2.0, 1.0), (None, "x"): (4.0, 4.0, 1.0)}
    fixed = {r["tool"]: r["ratio"] for r in rms_ratio(sig.where("channel = 'x'"), 2, 3).collect()}
    assert fixed == {"a": 33.0}


def test_column_facts_count_few_values_exactly(spark):
    from flankwear.operators.profile import column_facts
    df = spark.range(1000).selectExpr("id % 19 AS a", "cast(id % 20 AS short) AS b", "cast(id % 21 AS byte) AS c", "cast(null AS int) AS e",
                                      "cast(id AS string) AS s", "id * 0.5D AS f")
    got = [(r["column"], r["kind"], r["n_distinct"]) for r in column_facts(df).orderBy("position").collect()]
    assert got == [("a", "integer", 19), ("b", "integer", 20), ("c", "integer", 21), ("e", "integer", 0), ("s", "string", None), ("f", "number", None)]
