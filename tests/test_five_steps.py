"""End-to-end five-step run on a small raw-signal folder."""
import numpy as np
from pyspark.sql import functions as F

import pytest

from flankwear.plans import five_steps as pl


def test_five_steps_raw_signals(spark, tmp_path):
    src = tmp_path / "data"
    rng = np.random.default_rng(7)
    for tool in (1, 4):
        d = src / f"c{tool}"
        d.mkdir(parents=True)
        lines = []
        for p in range(1, 13):
            scale = 1 + p / 4
            x = rng.normal(scale=scale, size=(60, 7))
            (d / f"c_{tool}_{p:03d}.csv").write_text("\n".join(",".join(f"{v:.5f}" for v in r) for r in x) + "\n")
            lines.append(f"{p},{40 + 25 * p},{41 + 25 * p},{39 + 25 * p}")
        (d / f"c{tool}_wear.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    pl.run(spark, str(src), out, cv=3, models=("logistic_regression", "decision_tree", "knn"))
    lb = spark.read.parquet(out + "/leaderboard")
    assert lb.count() == 3 and lb.where(F.col("rank") == 1).count() == 1
    oof = spark.read.parquet(out + "/results/oof")
    feats = spark.read.parquet(out + "/features")
    assert oof.groupBy("model").count().where(F.col("count") != feats.count()).count() == 0


def test_five_steps_tables_and_regression(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    y = x[:, 0] * 2 + x[:, 1] + rng.normal(scale=0.1, size=90)
    lines = ["p,q,r,leak,sample_no,wear"] + [f"{a:.4f},{b:.4f},{c:.4f},{v * 3:.6f},{i},{v:.6f}" for i, ((a, b, c), v) in enumerate(zip(x, y))]
    lines += lines[-1:]          # a repeated row is a row of its own
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    pl.run(spark, str(tmp_path / "t.csv"), out, cv=3, models=("ridge", "decision_tree", "knn"))
    feats = spark.read.parquet(out + "/features")
    assert feats.columns == ["row_id", "y", "p", "q", "r"]               # leaky and meta columns are gone
    assert feats.count() == 91 == feats.select("row_id").distinct().count()
    lb = {r.model: r for r in spark.read.parquet(out + "/leaderboard").collect()}
    assert lb["ridge"].r2 > 0.9 and lb["ridge"].rank == 1 and lb["ridge"].r2_std is not None and lb["knn"].fit_time_s > 0
    assert spark.read.parquet(out + "/residuals").count() == 3


@pytest.mark.parametrize("small, strategy", [(60, "smote"), (200, "class_weight"), (320, "none")])
def test_benchmark_follows_the_strategy(spark, tmp_path, monkeypatch, small, strategy):
    rng = np.random.default_rng(5)
    n = 340 if strategy != "smote" else 480
    rows = [(i, "few" if i < small else "many", float(rng.normal(2.5 * (i < small))), float(rng.normal())) for i in range(n + small)]
    feats = spark.createDataFrame(rows, "row_id long, y string, a double, b double")
    made, folds, smote, make_model = [], [], pl.mo.smote, pl.mo.make_model
    monkeypatch.setattr(pl.mo, "make_model", lambda *a, **k: "n_rows" in k and made.append((k["weight_col"], k["n_rows"])) or make_model(*a, **k))
    monkeypatch.setattr(pl.mo, "smote", lambda df, *a, **k: folds.append((df, smote(df, *a, **k))) or folds[-1][1])
    out = str(tmp_path / "out")
    pl.step_balance(spark, feats, out)
    assert spark.read.json(out + "/strategy").first()["strategy"] == strategy
    oof, metrics = pl.step_benchmark(spark, feats, out, cv=2, models=("logistic_regression", "knn"))
    assert {r["status"] for r in metrics.collect()} == {"ok"} and oof.where("row_id < 0").count() == 0
    assert oof.groupBy("model").count().where(F.col("count") == n + small).count() == 2
    assert {w for w, _ in made} == {"weight" if strategy == "class_weight" else None}
    assert len(folds) == (2 if strategy == "smote" else 0)
    for before, after in folds:      # only the other fold's rows, oversampled to equal classes
        assert before.select("fold").distinct().count() == 1
        assert [r["count"] for r in after.groupBy("label").count().collect()] == [n // 2] * 2
    assert {m for _, m in made} == ({float(n)} if strategy == "smote" else {(n + small) / 2})


def test_benchmark_trains_its_own_kernel_machine(spark, tmp_path):
    """The grid's svm is the kernel machine: it separates classes that no line does."""
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    rows = [(i, "in" if np.hypot(*p) < 1.0 else "out", float(p[0]), float(p[1])) for i, p in enumerate(x)]
    feats = spark.createDataFrame(rows, "row_id long, y string, a double, b double")
    out = str(tmp_path / "out")
    pl.step_balance(spark, feats, out)
    oof, metrics = pl.step_benchmark(spark, feats, out, cv=2, models=("svm",))
    r = metrics.first()
    assert oof.count() == 90 and r.status == "ok" and r.accuracy > 0.8
