"""Cross-form equalities and invariants: skew-safe positions vs row_number,
Welch vs a direct DFT, exact kNN vs brute force, SMOTE invariants, fold balance."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flankwear.operators import balance as ba
from flankwear.operators import models as mo
from flankwear.operators import spectral as sp
from flankwear.operators import ordering
from flankwear.operators.ordering import exact_quantiles, sorted_quantiles, with_position


def test_positions_match_row_number_with_hot_key(spark):
    rows = [("hot", float(i)) for i in range(3000)] + [(f"k{i % 7}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = with_position(df, ["k"], ["v"], name="pos")
    b = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)
    assert sorted(a.collect()) == sorted(b.collect())


def test_exact_quantiles_numpy(spark):
    rng = np.random.default_rng(0)
    xs = rng.normal(size=501)
    df = spark.createDataFrame([("g", float(x)) for x in xs], "k string, v double")
    q = exact_quantiles(df, ["k"], "v", {"p25": 0.25, "p75": 0.75}).first()
    assert q.p25 == pytest.approx(np.percentile(xs, 25)) and q.p75 == pytest.approx(np.percentile(xs, 75))


def test_welch_peak_and_dft(spark):
    L, k, fs = 64, 5, 1.0
    n = 64 * 4
    x = np.sin(2 * np.pi * k * np.arange(n) / L)
    df = spark.createDataFrame([("c", 1, "ch", i, float(v)) for i, v in enumerate(x)],
                               "tool string, passe int, channel string, i long, x double")
    psd = sp.welch(df, fs, L).orderBy("bin").toPandas()
    assert int(psd.psd.idxmax()) == k
    # direct periodic-Hann DFT of the same segments
    step = L // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(L) / L)
    segs = [x[s:s + L] - x[s:s + L].mean() for s in range(0, n - L + 1, step)]
    p = np.mean([np.abs(np.fft.rfft(s * w)) ** 2 / (fs * np.sum(w * w)) for s in segs], axis=0)
    p[1:-1] *= 2
    assert np.allclose(psd.psd.to_numpy(), p)
    bands = sp.band_power(psd_df := sp.welch(df, 25000.0, L), ["tool", "passe", "channel"]).toPandas()
    assert bands.power_rel.sum() <= 1.0 + 1e-9
    _ = psd_df


def test_knn_bruteforce_and_smote(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 4))
    y = (X[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(60)], "row_id long, vec array<double>, label double")
    nn = mo.knn(df.select(F.col("row_id").alias("qid"), "vec"), df.select(F.col("row_id").alias("rid"), "vec"), 3,
                exclude_self=True, block_rows=16).toPandas()
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for q, g in nn.groupby("qid"):
        assert sorted(g.rid) == sorted(np.argsort(d2[q], kind="stable")[:3])
    imb = df.where("label = 1 OR row_id < 40")
    out = mo.smote(imb.withColumn("label", F.col("label").cast("int")), "label", k=3)
    counts = {r.label: r.c for r in out.groupBy("label").agg(F.count("*").alias("c")).collect()}
    assert len(set(counts.values())) == 1
    assert out.where("is_synthetic").count() > 0


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "row_id long, y int")
    f = ba.stratified_folds(df, "y", 5).groupBy("y", "fold").count().toPandas()
    for _, g in f.groupby("y"):
        assert g["count"].max() - g["count"].min() <= 1


def test_permutation_importance_and_multi_output(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 3))
    y = (X[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1]), float(X[i, 2]), float(y[i])) for i in range(120)],
                               "row_id long, a double, b double, c double, label double")
    m = mo.make_model("decision_tree", "classification").fit(mo.assemble(df, ["a", "b", "c"]))
    imp = {r.feature: r.importance for r in mo.permutation_importance(m, df, ["a", "b", "c"], repeats=2).collect()}
    assert imp["a"] > imp["b"] and imp["a"] > imp["c"]
    out = mo.multi_output_predict(df.withColumn("t2", F.col("a") * 2), ["a", "b"], ["label", "t2"],
                                  lambda t: mo.make_model("decision_tree", "regression", label=t))
    assert out.count() == 120 and {"label_pred", "t2_pred", "t2_true"} <= set(out.columns)


def test_standard_scale_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    z = [r.x_z for r in mo.standard_scale(df, ["x"]).orderBy("x").collect()]
    assert np.allclose(z, (np.array([1, 2, 3, 4]) - 2.5) / np.std([1, 2, 3, 4]))


def test_short_signal_single_segment(spark):
    x = np.cos(2 * np.pi * 3 * np.arange(40) / 40)
    df = spark.createDataFrame([("c", 1, "ch", i, float(v)) for i, v in enumerate(x)],
                               "tool string, passe int, channel string, i long, x double")
    seg = sp.segments(df, 64).collect()
    assert len(seg) == 1 and seg[0].L == 40
    psd = sp.welch(df, 1.0, 64).orderBy("bin").toPandas()
    assert len(psd) == 21 and int(psd.psd.idxmax()) == 3


def test_importance_spread(spark):
    from pyspark.ml.classification import RandomForestClassifier
    rng = np.random.default_rng(5)
    X = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(float(X[i, 0]), float(X[i, 1]), float(X[i, 2]), float(X[i, 0] > 0)) for i in range(80)],
                               "a double, b double, c double, label double")
    m = RandomForestClassifier(numTrees=5, seed=1).fit(mo.assemble(df, ["a", "b", "c"]))
    sp_ = {r.feature: r for r in mo.importance_spread(spark, m, ["a", "b", "c"]).collect()}
    assert sp_["a"].mean > sp_["b"].mean and all(r.std >= 0 for r in sp_.values())
    imp = mo.feature_importances(spark, m, ["a", "b", "c"]).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9


def test_pvalues_known():
    from flankwear.functions.pvalues import chi2_sf_value, t_two_sided_value
    assert t_two_sided_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert chi2_sf_value(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf_value(4.5714, 2) == pytest.approx(np.exp(-4.5714 / 2), rel=1e-10)
    assert chi2_sf_value(11.0705, 5) == pytest.approx(0.05, abs=1e-5)


def test_smote_between_parents_and_deterministic(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v)], 0) for i, v in enumerate(rng.normal(0, 1, 30))] + \
           [(100 + i, [float(v)], 1) for i, v in enumerate(rng.normal(10, 1, 8))]
    df = spark.createDataFrame(rows, "row_id long, vec array<double>, label int")
    a = mo.smote(df, "label", k=3).toPandas()
    b2 = mo.smote(df, "label", k=3).toPandas()
    key = lambda t: t.sort_values("row_id").reset_index(drop=True)
    assert key(a)[["row_id", "label"]].equals(key(b2)[["row_id", "label"]])
    minority = [r[1][0] for r in rows if r[2] == 1]
    syn = a[a.is_synthetic & (a.label == 1)]
    assert len(syn) == 22 and syn.vec.map(lambda v: min(minority) <= v[0] <= max(minority)).all()


def test_oof_beats_majority(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(150, 2))
    y = (X[:, 0] + X[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1]), float(y[i])) for i in range(150)],
                               "row_id long, a double, b double, label double")
    df = ba.kfolds(mo.assemble(df, ["a", "b"]), 5)
    oof = mo.oof_predict(df, lambda: mo.make_model("logistic_regression", "classification", n_rows=120), range(5), "lr")
    assert oof.count() == 150 and oof.select("row_id").distinct().count() == 150
    acc = oof.select(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
    assert acc > max(y.mean(), 1 - y.mean()) + 0.2


def test_approx_quantiles_close_to_exact(spark):
    from flankwear.operators.ordering import approx_quantiles
    rng = np.random.default_rng(9)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("cold", float(v)) for v in rng.normal(size=50)]
    df = spark.createDataFrame(rows, "k string, v double")
    ex = {r.k: r.p25 for r in exact_quantiles(df, ["k"], "v", {"p25": 0.25}).collect()}
    ap = {r.k: r.p25 for r in approx_quantiles(df, ["k"], "v", {"p25": 0.25}).collect()}
    assert ex["hot"] == pytest.approx(ap["hot"], abs=0.01) and set(ex) == set(ap)


@pytest.mark.parametrize("slices", [None, 1, 7])
def test_hot_and_cold_groups(spark, slices):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + \
           [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.normal(size=300))] + \
           [(None, float(v)) for v in rng.normal(size=150)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = with_position(df, ["k"], ["v"], name="pos", count_name="n", slices=slices)
    b = (df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)
         .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))))
    assert sorted(a.select("k", "v", "pos", "n").collect(), key=repr) == sorted(b.collect(), key=repr)
    q = {r.k: (r.p25, r.p90) for r in sorted_quantiles(df, ["k"], "v", {"p25": 0.25, "p90": 0.9}, slices=slices).collect()}
    for key in ["hot", "k0", None]:
        xs = [v for k, v in rows if k == key]
        assert q[key] == pytest.approx((np.percentile(xs, 25), np.percentile(xs, 90)))
    g = with_position(df.select("v"), [], ["v"], name="pos", slices=slices)
    assert sorted(r.pos for r in g.collect()) == list(range(len(rows)))
    assert "SinglePartition" not in g._jdf.queryExecution().toString()
    assert with_position(df.where("v > 99"), [], ["v"]).collect() == []


def test_tail_probabilities_settle_for_large_degrees():
    from flankwear.functions.pvalues import chi2_sf_value, t_two_sided_value
    assert chi2_sf_value(1e6, 1e6) == pytest.approx(0.499812, abs=1e-6)
    assert chi2_sf_value(1e8, 1e8) == pytest.approx(0.499981, abs=1e-6)
    assert t_two_sided_value(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided_value(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf_value(0.0, 3) == 1.0 and np.isnan(chi2_sf_value(-1.0, 3))


def test_edge_values_do_not_divide_by_zero(spark):
    from flankwear.operators import evaluate as ev
    from flankwear.operators import stats as st
    oof = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 1.0)],
                                "model string, y_true double, y_pred double")
    got = {r.model: r.r2 for r in ev.regression_metrics(oof).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.0 and got["c"] == pytest.approx(-1.0)
    tied = spark.createDataFrame([("g", 1.0), ("h", 1.0), ("h", 1.0)], "g string, x double")
    assert tuple(st.kruskal(tied, "x", "g").select("H", "p").first()) == (None, None) or \
        all(v is None or np.isnan(v) for v in st.kruskal(tied, "x", "g").select("H", "p").first())
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)], "x double, y double")
    assert st.linreg(line, "x", "y").first().p == 0.0
    assert st.linreg(line.where("x < 2"), "x", "y").first().p is None


def test_grid_models(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(160, 3))
    y = (X[:, 0] > 0).astype(float)
    rows = [(i, float("nan") if i % 9 == 0 else float(X[i, 0]), *map(float, X[i, 1:]), float(y[i]), float(X[i, 0] * 2 + X[i, 1]))
            for i in range(160)]
    df = mo.assemble(spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, t double"), ["a", "b", "c"])
    hist = mo.make_model("hist_gradient_boosting", "regression", label="t")
    hist.getStages()[1].setMaxIter(5)
    assert hist.fit(df).transform(df).where("prediction IS NULL OR isnan(prediction)").count() == 0   # takes missing values
    full = df.where("NOT isnan(a)")
    extra = mo.make_model("extra_trees", "regression", label="t").setNumTrees(6).fit(full)
    assert len({t.toDebugString.split("\n", 1)[1] for t in extra.trees}) > 1 and extra.getMaxDepth() == 30
    assert mo.make_model("bagging", "regression").getMaxDepth() == 30
    for name in ("logistic_regression", "svm"):
        with pytest.raises(ValueError):
            mo.make_model(name, "classification")
    folds = ba.kfolds(full, 4)
    stats = mo.fold_statistics(folds, range(4), "t")
    rest = [r[5] for r in rows if not np.isnan(r[1])]
    assert sum(s["n_rows"] for s in stats.values()) == 3 * len(rest)
    oof = mo.oof_predict(folds, lambda n_rows, sigma_y: mo.make_model("ridge", "regression", label="t", n_rows=n_rows, sigma_y=sigma_y,
                                                                       scale=True), range(4), "ridge", label="t")
    assert oof.count() == len(rest) and oof.where("abs(y_true - y_pred) > 0.5").count() == 0
    knn = mo.knn_oof(folds.withColumn("vec", F.array("a", "b", "c")), 5, "classification")
    per_fold = mo.knn_oof_scaled(folds.withColumn("vec", F.array("a", "b", "c")), 5, range(4), "classification")
    for o in (knn, per_fold):
        assert o.count() == len(rest) and o.where("y_true = y_pred").count() > 0.8 * len(rest)


def test_bracketed_quantiles(spark, monkeypatch):
    """Two scans give numpy's quantiles whatever the sketch's accuracy: ties, NULL groups, one hot group, a sketch that is off."""
    monkeypatch.setattr(ordering, "ACCURACY", 100)
    rng = np.random.default_rng(4)
    rows = [("hot", float(x)) for x in rng.normal(size=6000).round(3)] + [("hot", 0.5)] * 3000 + [(None, float(x)) for x in rng.random(900)]
    rows += [("one", 1.0), ("null", None), ("two", 1.0), ("two", 4.0)]
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p1": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).extend([v] if v is not None else [])

    def check(got):
        assert {r.k for r in got} == {k for k, v in want.items() if v}
        for r in got:
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(want[r.k], p), abs=1e-12)

    check(exact_quantiles(df, ["k"], "v", probs).collect())
    v = df.where("v is not null")
    brackets = ordering.write_stage(v.groupBy("k").agg(*ordering.bracket_aggs(v, "v", list(probs.values()))))
    plan = ordering.quantiles_in(v, ["k"], "v", probs, brackets)
    assert "Python" not in plan._jdf.queryExecution().toString()
    off = ordering.write_stage(brackets.withColumn("__b", F.transform("__b", lambda x: x + 0.4)))
    check(ordering.quantiles_in(v, ["k"], "v", probs, off).collect())
    monkeypatch.setattr(ordering, "BROADCAST_GROUPS", 0)
    check(ordering.quantiles_in(v, ["k"], "v", probs, brackets).collect())


def test_bracketed_quantiles_share_of_rows(spark, monkeypatch):
    """Only rows in brackets are cells: about 4 / ACCURACY of a group per probability, and one gap between."""
    monkeypatch.setattr(ordering, "ACCURACY", 1000)
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.rand(7).alias("v"))
    lo, hi = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.75}).select("a", "b").first()
    v = np.sort([r.v for r in df.collect()])
    assert (lo, hi) == pytest.approx((np.quantile(v, 0.25), np.quantile(v, 0.75)), abs=1e-12)


def test_quantiles_with_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0)], "k string, v double")
    got = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 4.0}
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []
    assert exact_quantiles(df.where("k = 'b'"), [], "v", {"m": 0.5}).collect() == [(4.0,)]


def test_corr_matrix_pairwise_complete(spark):
    """Blocks of columns, tasks and NULLs at random against pandas; constants and short pairs are NULL."""
    import pandas as pd
    from flankwear.operators import profile as pr
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 70)) @ rng.normal(size=(70, 70)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = 0.1
    x[2:, 5] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c {k}" for k in range(70)])
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x],
                               ", ".join(f"`c {k}` double" for k in range(70))).repartition(7)
    want = pdf.corr()
    got = {(r.a, r.b): r.r for r in pr.corr_matrix(df, pdf.columns, lower_only=False).collect()}
    assert len(got) == 70 * 70
    for (a, b), r in got.items():
        if a == "c 3" or b == "c 3" or (("c 5" in (a, b)) and r is None):
            assert r is None
        elif "c 5" not in (a, b):
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    low = {(r.a, r.b): r.r for r in pr.corr_matrix(df, pdf.columns).collect()}
    assert len(low) == 70 * 69 // 2 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in low.items() if v is not None)
    empty = pr.corr_matrix(df.limit(0), ["c 0", "c 1"]).collect()
    assert [r.r for r in empty] in ([], [None])


def test_corr_matrix_of_many_columns(spark):
    import time
    from flankwear.operators import profile as pr
    df = spark.range(2000).select(*[F.rand(k).alias(f"x{k}") for k in range(196)])
    begin = time.time()
    assert pr.corr_matrix(df, df.columns).count() == 196 * 195 // 2
    assert time.time() - begin < 60
    text = [pr.corr_matrix(df, df.columns[:n])._jdf.queryExecution().sparkPlan().toString().count("Exchange") for n in (2, 196)]
    assert text[0] == text[1]


def _nearest(q, r, k, ok):
    """Nearest by all distances: {qid: [(rid, dist2)]}, ties to the smaller id."""
    out = {}
    for i, (qi, qv, *qx) in enumerate(q):
        d = sorted((float(((np.asarray(qv) - np.asarray(rv)) ** 2).sum()), ri) for ri, rv, *rx in r if ok(qi, qx, ri, rx))
        out[qi] = d[:k]
    return out


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_knn_pruned_is_exact(spark, block_rows):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 5)) * 30
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=5)).round(1)], int(rng.integers(3)), "ab"[i % 2]) for i in range(360)]
    rows += [(1000 + i, rows[i][1], 1, "a") for i in range(20)] + [(5000, rows[0][1], 2, "b")]        # equal vectors
    df = spark.createDataFrame(rows, "qid long, vec array<double>, fold int, cls string").repartition(3)
    ref = df.withColumnRenamed("qid", "rid")

    def check(nn, want):
        got = {}
        for r in nn.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.dist2, r.rid))
        assert set(got) == {q for q, v in want.items() if v}
        for q, v in got.items():
            assert [x for _, x in v] == [x for _, x in want[q]] and [d for d, _ in v] == pytest.approx([d for d, _ in want[q]])

    check(mo.knn(df, ref, 5, block_rows=block_rows), _nearest(rows, rows, 5, lambda *a: True))
    check(mo.knn(df, ref, 4, differ="fold", block_rows=block_rows), _nearest(rows, rows, 4, lambda q, qx, r, rx: qx[0] != rx[0]))
    check(mo.knn(df, ref, 3, within="cls", exclude_self=True, block_rows=block_rows),
          _nearest(rows, rows, 3, lambda q, qx, r, rx: qx[1] == rx[1] and q != r))
    few = [r for r in rows if r[0] < 4]
    check(mo.knn(df.where("qid < 30"), ref.where("rid < 4"), 9, block_rows=block_rows), _nearest(rows[:30], few, 9, lambda *a: True))
    assert mo.knn(df, ref.limit(0), 3).collect() == []


def test_knn_visits_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(25, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 25] + rng.normal(size=8)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "qid long, vec array<double>")
    nn, met = mo.knn_visits(df, df.withColumnRenamed("qid", "rid"), 5)
    share = met.agg(F.sum("met")).first()[0] / len(rows) ** 2
    assert nn.count() == 5 * len(rows) and share < 0.2, share


@pytest.mark.parametrize("length,run", [(8, 65_536), (8, 12), (7, 9), (7, 4), (5, 1)])
def test_segments_cut_from_runs(spark, monkeypatch, length, run):
    """Every full segment once, across the runs' borders, odd lengths and short signals included."""
    monkeypatch.setattr(sp, "RUN", run)
    sizes = {"a": 50, "b": length, "c": length - 1, "d": 1, "e": 3 * length + 2}
    rows = [(k, i, None if i == 2 else float(i * 10 + len(k))) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "tool string, i long, x double").repartition(4)
    step = length - length // 2
    want = {}
    for k, n in sizes.items():
        x = [v for t, _, v in rows if t == k]
        for s in range(n // step + 1):
            if len(x[s * step:s * step + length]) == length or (n < length and s == 0):
                want[k, s] = x[s * step:s * step + length]
    got = sp.segments(df, length, ["tool"]).collect()
    assert {(r.tool, r.seg): list(r.x) for r in got} == want and len(got) == len(want) and all(r.L == len(r.x) for r in got)


def test_permuted_copies_trade_one_feature_in_every_block(spark, monkeypatch):
    """Every copy holds all rows; only its feature moves, every value once, NULLs too; blocks change nothing of that."""
    monkeypatch.setattr(mo, "PERMUTE_ROWS", 20)
    rows = [(i, float(i), None if i % 7 == 0 else i * 0.5, i % 3, "z") for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, a double, repeat2 double, label int, _b string")
    got = mo.permuted_copies(df, ["a", "repeat2"], 3, keep=["label"]).collect()
    assert len(got) == 150 * 2 * 3
    for rep in range(3):
        for feat, still in (("a", "repeat2"), ("repeat2", "a")):
            part = {r["row_id"]: r for r in got if r["repeat"] == rep and r["feature"] == feat}
            assert len(part) == 150
            want = {r[0]: dict(zip(("a", "repeat2", "label"), r[1:4])) for r in rows}
            assert all(part[i][still] == want[i][still] and part[i]["label"] == want[i]["label"] for i in want)
            assert sorted(map(repr, (r[feat] for r in part.values()))) == sorted(repr(x[feat]) for x in want.values())
            if feat == "a":
                assert all(part[i]["a"] != want[i]["a"] for i in want)
    one = mo.permuted_copies(df.limit(1), ["a"], 2).collect()
    assert len(one) == 2 and mo.permuted_copies(df.where("row_id < 0"), ["a"], 2).collect() == []


def test_permutation_importance_against_a_plain_loop(spark):
    """Scores of the copies equal the weighted F1 counted by hand; a feature that the tree ignores has importance 0."""
    rows = [(i, float(i % 10), float(i % 4), float(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x double, noise double, label double")
    model = mo.make_model("decision_tree", "classification").fit(mo.assemble(df, ["x", "noise"]))
    got = {r["feature"]: r for r in mo.permutation_importance(model, df, ["x", "noise"], repeats=4).collect()}
    assert abs(got["noise"]["importance"]) < 1e-12
    drops = []
    for rep in range(4):
        pairs = [(r["label"], float(r["x"] >= 5)) for r in mo.permuted_copies(df, ["x"], 4, keep=["label"]).where(F.col("repeat") == rep).collect()]
        f1 = 0.0
        for c in (0.0, 1.0):
            tp = sum(t == c and p == c for t, p in pairs)
            wrong = sum((t == c) != (p == c) for t, p in pairs)
            f1 += 2 * tp / (2 * tp + wrong) * sum(t == c for t, _ in pairs) / len(pairs)
        drops.append(1 - f1)
    assert abs(got["x"]["importance"] - sum(drops) / 4) < 1e-9
