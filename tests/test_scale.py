"""Steps whose cost must not hang on how common a value is or on how many files a table has."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flankwear.functions import scalar as fx
from flankwear.operators import cart
from flankwear.operators import models as mo
from flankwear.operators import ordering, signal_stats, stats
from flankwear.plans import q_models


def _plan(df):
    return df._jdf.queryExecution().toString()


def _spied(monkeypatch, *modules):
    """The tables that the modules write as stages."""
    written, real = [], ordering.write_stage
    for m in modules:
        monkeypatch.setattr(m, "write_stage", lambda df, *a, **k: written.append(real(df, *a, **k)) or written[-1])
    return written


def test_label_encode_leaves_rows_where_they_are(spark):
    df = spark.createDataFrame([(i, ["b", "a", None][min(i, 2)]) for i in range(50)], "id int, y string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = fx.label_encode(df, "y")
        assert "BroadcastHashJoin" in _plan(out) and "SortMergeJoin" not in _plan(out)
        assert {r.id: r.label_idx for r in out.collect()} == {0: 2, 1: 1} | {i: 0 for i in range(2, 50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_label_encode_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(fx, "BROADCAST_LABELS", 1)
    out = fx.label_encode(spark.createDataFrame([("b",), ("a",), ("b",)], "y string"), "y")
    assert sorted((r.y, r.label_idx) for r in out.collect()) == [("a", 0), ("b", 1), ("b", 1)]


def test_copies_of_vectors_go_out_in_pieces():
    b = pa.record_batch([pa.array([1, 2, 3]), pa.array([[0.0] * 100] * 3)], ["_id", "_v"])
    at, block = np.repeat(np.arange(3), 40_000), np.tile(np.arange(40_000), 3)
    out = list(mo._copies(b, at, block, 100))
    assert max(p.num_rows for p in out) * 100 <= mo._PIECE and sum(p.num_rows for p in out) == 120_000
    assert out[-1].column("_id")[-1].as_py() == 3 and out[-1].column("_b")[-1].as_py() == 39_999
    assert [p.column("_id").to_pylist() for p in mo._cut(iter([b, b]), 2)] == [[1, 2], [3], [1, 2], [3]]


def test_knn_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(mo, "_PIECE", 50)
    x = np.random.default_rng(3).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vec array<double>")
    out = mo.knn(df.withColumnRenamed("i", "qid"), df.withColumnRenamed("i", "rid"), 3, exclude_self=True).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(300, np.inf))
    want = {(q, int(r)) for q in range(300) for r in np.argsort(d[q])[:3]}
    assert len(out) == 900 and {(r.qid, r.rid) for r in out} == want


def test_iterated_fits_have_tasks_by_work(spark):
    seen = []

    class Spy(LogisticRegression):
        def _fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super()._fit(df)

    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 5).cast("int").alias("fold"),
                                 array_to_vector(F.array((F.col("id") % 2).cast("double"), (F.col("id") % 3).cast("double"))).alias("features")).repartition(40)
    out = mo.oof_predict(df, lambda: Spy(maxIter=5), range(5), "lr").collect()
    assert seen == [1] * 5 and len(out) == 400 and all(r.y_true == r.y_pred for r in out)


def test_ranks_are_cut_among_distinct_values(spark, monkeypatch):
    written = _spied(monkeypatch, ordering, stats)
    x = [0.0] * 900 + [2.0] * 90 + [1.0] * 9 + [float("nan"), -0.0, None]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(x)], "x double, g string")
    out = sorted((str(r.x), r.avg_rank, r.ties) for r in stats.avg_rank(df, "x").collect())
    assert out == [("0.0", 451.0, 901), ("1.0", 906.0, 9), ("2.0", 955.5, 90), ("nan", 1001.0, 1)]
    assert max(t.count() for t in written) <= 4
    written.clear()
    assert stats.kruskal(df, "x", "g").first().n == 1001
    assert max(t.count() for t in written) <= 8


def test_tied_ranks_of_groups_and_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), int(t)) for g in (None, "a", "b") for v, t in zip(rng.permutation(500), rng.integers(1, 4, 500))]
    got = {(r.g, r.v): r["rank"] for r in ordering.tied_ranks(spark.createDataFrame(rows, "g string, v double, ties long"), ["g"], "v").collect()}
    for g in (None, "a", "b"):
        at = 0
        for _, v, t in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            assert got[g, v] == at + (t + 1) / 2
            at += t


def test_targets_of_a_fold_without_joins(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("x"),
                                 (F.col("id") % 7 * 2).cast("double").alias("t1"), (F.col("id") % 7 + 1).cast("double").alias("t2"))
    make = lambda t: mo.make_model("decision_tree", "regression", label=t)
    out = mo.multi_output_predict(df, ["x"], ["t1", "t2"], make, folds=range(3))
    assert "Join" not in _plan(out) and out.columns == ["row_id", "fold", "t1_pred", "t1_true", "t2_pred", "t2_true"]
    rows = out.collect()
    assert len(rows) == 300 and all(abs(r.t1_pred - r.t1_true) < 1e-9 and abs(r.t2_pred - r.t2_true) < 1e-9 for r in rows)
    assert mo.multi_output_predict(df, ["x"], ["t1"], make).columns == ["row_id", "t1_pred", "t1_true"]


def test_only_large_groups_are_sketched(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=90)
    sig = spark.createDataFrame([("c", 1 if i < 80 else 2, float(v)) for i, v in enumerate(x)] + [("c", 3, None)], "tool string, passe int, x double")
    want = {1: np.percentile(x[:80], [25, 75]), 2: np.percentile(x[80:], [25, 75])}
    for accuracy, sketched in ((10_000, False), (20, True)):
        written = _spied(monkeypatch, signal_stats)
        for m in (ordering, signal_stats):
            monkeypatch.setattr(m, "ACCURACY", accuracy)
        got = {r.passe: r for r in signal_stats.channel_stats(sig, ["tool", "passe"]).collect()}
        assert all(np.allclose([got[p].p25, got[p].p75], w) for p, w in want.items()) and got[3].p25 is None and got[3].n == 0
        assert [t.where("passe < 3").count() for t in written if "__b" in t.columns] == ([1, 2] if sketched else [])


def test_rows_a_task_keeps_for_a_tree_are_bounded(spark, tmp_path, monkeypatch):
    """One file of 2,000 line items: neither a fit nor a permutation reads it in one task, and nothing is lost or changed."""
    class Spy(DecisionTreeClassifier):
        def fit(self, df):
            seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(df)

    seen, real = [], mo.make_model
    rows = spark.range(2000, numPartitions=1).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "if(id % 4 < 2, 'A', 'N') AS l_returnflag", "CAST(id % 4 AS DOUBLE) AS l_quantity",
        "CAST(id % 9 AS DOUBLE) AS l_extendedprice", "CAST(id % 5 AS DOUBLE) AS l_discount", "CAST(id % 3 AS DOUBLE) AS l_tax")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(mo, "make_model", lambda *a, **k: Spy(maxDepth=real(*a, **k).getMaxDepth()))
    want = {r.feature: r for r in q_models.q_e19(spark, str(tmp_path)).collect()}
    assert [len(s) for s in seen] == [1] and want["l_quantity"].importance > 0.3 and abs(want["l_tax"].importance) < 1e-9
    monkeypatch.setattr(mo, "TASK_BYTES", 112 * 200, raising=False)
    got = {r.feature: r for r in q_models.q_e19(spark, str(tmp_path)).collect()}
    assert sum(seen[1]) == 2000 and max(seen[1]) <= 300
    assert got.keys() == want.keys()
    assert all(abs(got[f].importance - want[f].importance) < 1e-9 and abs(got[f].importance_std - want[f].importance_std) < 1e-9 for f in want)
    oof = mo.oof_predict(spark.range(1000, numPartitions=1).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 3 > 0).cast("double").alias("label"),
        array_to_vector(F.array((F.col("id") % 3).cast("double"))).alias("features")), Spy, range(2), "tree").collect()
    assert [max(s) <= 250 and sum(s) == 500 for s in seen[2:]] == [True] * 2 and len(oof) == 1000 and all(r.y_true == r.y_pred for r in oof)


def test_rows_to_permute_are_bounded_by_task(spark, monkeypatch):
    monkeypatch.setattr(mo, "PERMUTE_ROWS", 10)
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.lit(0.0).alias("b"))
    want = sorted(map(tuple, mo.permuted_copies(df, ["a", "b"], 2).collect()))
    monkeypatch.setattr(mo, "TASK_BYTES", 88 * 100, raising=False)
    got = mo.permuted_copies(df, ["a", "b"], 2)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 30 and max(per_task) < 1000 and sorted(map(tuple, got.collect())) == want


def _brute(rows, k, ok):
    """Per query row the k nearest (squared distance, rid) among the rows that count."""
    out = {}
    for q, x, fold, cls in rows:
        if x is None or not all(v is not None and np.isfinite(v) for v in x):
            continue
        found = [(float(((np.array(x) - np.array(y)) ** 2).sum()), r) for r, y, f, c in rows
                 if y is not None and all(v is not None and np.isfinite(v) for v in y) and ok((q, fold, cls), (r, f, c))]
        if found:
            out[q] = sorted(found)[:k]
    return out


def test_neighbours_lay_every_vector_out_once_a_round(spark, monkeypatch):
    """Vectors without structure, which pivots can't part: each lies in one chunk of bounded size, whatever it visits."""
    written = _spied(monkeypatch, mo)
    x = np.random.default_rng(5).normal(size=(700, 6))
    rows = [(i, v.tolist(), i % 3, None) for i, v in enumerate(x)]
    df = spark.createDataFrame([r[:3] for r in rows], "qid long, vec array<double>, fold int")
    nn, met = mo.knn_visits(df, df.withColumnRenamed("qid", "rid"), 4, differ="fold", block_rows=100)
    got = {}
    for r in nn.collect():
        got.setdefault(r.qid, []).append((r.rank, r.dist2, r.rid))
    want = _brute(rows, 4, lambda q, r: q[1] != r[1])
    assert {q: [x[2] for x in sorted(v)] for q, v in got.items()} == {q: [r for _, r in v] for q, v in want.items()}
    assert met.agg(F.sum("met")).first()[0] > 0.5 * 700 ** 2                      # nearly all pairs count
    chunks = [t for t in written if "_rows" in t.columns]
    assert len(chunks) == 3                                                      # references, queries of two rounds
    for t in chunks:
        ids = [pa.ipc.open_stream(r["_rows"]).read_all()["_id"].to_pylist() for r in t.collect()]
        assert max(map(len, ids)) <= 256 and sorted(i for c in ids for i in c) == list(range(700))


def test_neighbours_of_odd_vectors(spark):
    """Equal vectors, null classes and folds, null, infinite and missing components, in one table; far from zero."""
    rng = np.random.default_rng(6)
    rows = [(i, (1e6 + rng.integers(-9, 10, 3)).tolist(), int(rng.integers(3)), "ab"[i % 2]) for i in range(150)]
    rows += [(200 + i, rows[i][1], None, None) for i in range(12)] + [(300 + i, [1e6] * 3, 1, "a") for i in range(40)]
    rows += [(400, [float("nan"), 0.0, 0.0], 0, "a"), (401, [None, 0.0, 0.0], 0, "b"), (402, None, 0, "a"), (403, [float("inf"), 0.0, 0.0], 1, "a")]
    df = spark.createDataFrame(rows, "qid long, vec array<double>, fold int, cls string").repartition(3)
    ref = df.withColumnRenamed("qid", "rid")
    for kw, ok in (({"differ": "fold"}, lambda q, r: q[1] is None or r[1] is None or q[1] != r[1]),
                   ({"within": "cls", "exclude_self": True}, lambda q, r: q[2] == r[2] and q[0] != r[0])):
        got = {}
        for r in mo.knn(df, ref, 5, block_rows=32, **kw).collect():
            got.setdefault(r.qid, []).append((r.rank, r.rid))
        assert {q: [x[1] for x in sorted(v)] for q, v in got.items()} == {q: [r for _, r in v] for q, v in _brute(rows, 5, ok).items()}


def test_bounds_in_single_precision_lose_no_neighbour():
    rng = np.random.default_rng(7)
    for scale, offset in ((1.0, 0.0), (1e-3, 1e4), (1e-200, 0.0), (1e120, 0.0), (0.0, 1.0)):
        a, b = (offset + scale * rng.normal(size=(n, 7)) for n in (30, 400))
        b[50:60] = b[0]
        d = ((a[:, None] - b[None]) ** 2).sum(2)
        best = (np.full((30, 5), np.inf), np.zeros((30, 5), np.int64), np.zeros((30, 5), bool))
        for s in (0, 200):
            mo.meet_cell(best, np.arange(30), a, b[s:s + 200], b[7], np.full(30, np.inf), np.arange(s, s + 200), np.zeros(200, bool), None)
        assert [list(r) for r in best[1]] == [sorted(range(400), key=lambda j: (d[i, j], j))[:5] for i in range(30)]


def test_trees_grown_together_are_those_of_the_library(spark, monkeypatch):
    """Every fold's and target's tree predicts as Spark's fit on the same rows, from rows and from rows added up, in one or many passes."""
    rng = np.random.default_rng(8)
    n = 900
    x = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 40, n), rng.normal(size=n), np.zeros(n)]).astype(float)
    t1, t2 = np.floor(10 * x[:, 2]) + x[:, 1] + rng.integers(0, 5, n), (x[:, 0] > 1) * 7.0 - x[:, 1]
    label = (rng.integers(0, 9, n) + (x[:, 2] > 0) * 5 + x[:, 0] * 2) // 5
    rows = [(i, i % 3, *map(float, (*x[i], t1[i], t2[i], label[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, fold int, a double, b double, c double, d double, t1 double, t2 double, label double").repartition(3)

    def plain(cls):
        return lambda t: mo.make_model("decision_tree", "classification" if cls else "regression", label=t).setMaxBins(32).setMaxDepth(6)

    class Spark(type(mo.make_model("decision_tree", "regression"))):              # a subclass is fitted by itself
        pass

    for cols in (["a", "b", "c", "d"], ["a", "b"]):
        want = mo.multi_output_predict(df, cols, ["t1", "t2"], lambda t: Spark(labelCol=t, maxBins=32, maxDepth=6), folds=range(3)).collect()
        want = {r.row_id: r for r in want}
        for size in (cart.GROUP_BYTES, 40_000):
            monkeypatch.setattr(cart, "GROUP_BYTES", size)
            out = mo.multi_output_predict(df, cols, ["t1", "t2"], plain(False), folds=range(3))
            got = {r.row_id: r for r in out.collect()}
            assert "MapInArrow" in _plan(out) and out.columns == ["row_id", "fold", "t1_pred", "t1_true", "t2_pred", "t2_true"] and got.keys() == want.keys()
            assert all(abs(got[i].t1_pred - want[i].t1_pred) < 1e-9 and abs(got[i].t2_pred - want[i].t2_pred) < 1e-9 for i in want)
    vec = mo.assemble(df, ["a", "b", "c"])
    model = mo.fit_tree(plain(True)("label"), df, ["a", "b", "c"])
    spark_model = plain(True)("label").fit(vec)
    assert isinstance(model, cart.TreeModel)
    assert [r.prediction for r in model.transform(vec).orderBy("row_id").collect()] == [r.prediction for r in spark_model.transform(vec).orderBy("row_id").collect()]
    monkeypatch.setattr(mo, "PERMUTE_ROWS", 50)
    a, b = ({r.feature: r for r in mo.permutation_importance(m, df, ["a", "b", "c"], repeats=3).collect()} for m in (model, spark_model))
    assert a.keys() == b.keys() and all(abs(a[f].importance - b[f].importance) < 1e-9 and abs(a[f].importance_std - b[f].importance_std) < 1e-9 for f in a)


@pytest.mark.parametrize("odd", [(5, 0, None, 1.0), (5, 0, float("nan"), 1.0), (5, 0, 1.0, None)])
def test_trees_refuse_missing_values_like_the_library(spark, odd):
    df = spark.createDataFrame([(i, i % 2, float(i), float(i)) for i in range(5)] + [odd], "row_id long, fold int, x double, t double")
    with pytest.raises(Exception, match="null"):
        mo.multi_output_predict(df, ["x"], ["t"], lambda t: mo.make_model("decision_tree", "regression", label=t), folds=range(2))
