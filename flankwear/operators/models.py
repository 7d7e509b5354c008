"""Models, out-of-fold prediction and importances.

Tree, linear and neural models are ``pyspark.ml`` estimators.  k-nearest
neighbours and SMOTE use an exact plan over blocks around pivots: the triangle
inequality skips blocks that can't hold a neighbour, chunks of the others meet in
bounded pandas tasks that keep only the ``k`` best candidates per query row.
No pair is ever emitted as a row.
"""
from __future__ import annotations

import inspect
import math
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flankwear.operators import cart
from flankwear.operators.stats import with_scalars
from flankwear.session import write_stage

SEED = 42


# ------------------------------------------------------------------ M01, M19
def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x − mean) / population std (0 when the std is 0), statistics from one aggregation."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = with_scalars(df, st)
    for c in cols:
        j = j.withColumn(f"{c}{suffix}", F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
                         .otherwise(F.lit(0.0)))
    return j.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs by the exact column median (skew-safe quantile plan)."""
    from flankwear.operators.ordering import exact_quantiles
    long = df.select(*cols).unpivot([], list(cols), "_c", "_v")
    med = exact_quantiles(long, ["_c"], "_v", {"_med": 0.5})
    one = med.groupBy().pivot("_c", list(cols)).agg(F.first("_med"))
    j = with_scalars(df, one.select(*[F.col(c).alias(f"_med_{c}") for c in cols]))
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}")))
    return j.drop(*[f"_med_{c}" for c in cols])


# ------------------------------------------------------------------ estimators
class MissingToLow(Transformer, HasInputCol, HasOutputCol):
    """Vectors with missing entries (NaN) set below every value, so that one split of a tree separates them."""

    LOW = -1e30

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = F.transform(vector_to_array(self.getInputCol()), lambda x: F.when(F.isnan(x), self.LOW).otherwise(x))
        return df.withColumn(self.getOutputCol(), array_to_vector(filled))


#: Models whose features are standardised on the training fold.
SCALED = ("svm", "knn", "logistic_regression", "ridge", "mlp")


def make_model(name: str, task: str, features: str = "features", label: str = "label",
               weight_col: str | None = None, seed: int = SEED, n_features: int | None = None,
               n_classes: int | None = None, n_rows: float | None = None, sigma_y: float | None = None,
               C: float = 1.0, alpha: float = 1.0, scale: bool = False) -> Estimator:
    """The benchmark grid as pyspark.ml estimators.

    M14 (C=1, L2): ``regParam = 1/(C·n)``; M15 (α=1): ``regParam = α·σ_y/n`` with the population σ of the
    label and the normal solver; M09 and M10 (C=10): ``1/(C·n)``.  ``n_rows`` (or the sum of weights) and
    ``sigma_y`` are statistics of the training fold; models that need them raise without them.  ``scale``
    puts M01 in front of the models of ``SCALED``, so that it is fitted on the training fold.

    Spark's forests stop at depth 30 (its own limit).  The estimators here of M04 (no random thresholds), M05 (several
    classes one against the rest), M07 (missing values below all others, depth-wise) and M09 / M10 (linear, Huber loss)
    are Spark's nearest ones, for single fits (V07); the benchmark uses ``trees.oof`` and ``kernel.oof``, which are
    those learners themselves.
    """
    cls = task == "classification"
    if scale and name in SCALED:
        est = make_model(name, task, "_scaled", label, weight_col, seed, n_features, n_classes, n_rows, sigma_y, C, alpha)
        return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="_scaled", withMean=True), est])
    if name in ("logistic_regression", "ridge", "svm") and not n_rows:
        raise ValueError(f"{name} needs the number of training rows")
    kw = dict(featuresCol=features, labelCol=label)
    # tree growth: larger node batches per pass over the data and cached node ids
    tkw = dict(maxMemoryInMB=2048, cacheNodeIds=True, checkpointInterval=10)
    wkw = dict(weightCol=weight_col) if weight_col else {}
    if name == "random_forest":
        return (RandomForestClassifier(numTrees=300, maxDepth=30, seed=seed, **tkw, **kw, **wkw) if cls
                else RandomForestRegressor(numTrees=300, maxDepth=30, featureSubsetStrategy="all", seed=seed, **tkw,
                                           **kw, **wkw))
    if name == "extra_trees":
        forest = RandomForestClassifier if cls else RandomForestRegressor
        return forest(numTrees=300, maxDepth=30, bootstrap=False, featureSubsetStrategy="sqrt" if cls else "onethird",
                      maxBins=16, seed=seed, **tkw, **kw, **wkw)
    if name == "gradient_boosting":
        return _boosted(cls, features, label, wkw, seed, n_classes, maxIter=200, stepSize=0.05, maxDepth=3, maxBins=32)
    if name == "hist_gradient_boosting":
        # library defaults of the histogram learner: rate 0.1, 31 leaves (depth 5), 255 bins
        est = _boosted(cls, "_filled", label, wkw, seed, n_classes, maxIter=200, stepSize=0.1, maxDepth=5, maxBins=255)
        return Pipeline(stages=[MissingToLow(features, "_filled"), est])
    if name == "bagging":
        forest = RandomForestClassifier if cls else RandomForestRegressor
        return forest(numTrees=100, maxDepth=30, featureSubsetStrategy="all", seed=seed, **tkw, **kw, **wkw)
    if name == "decision_tree":
        return (DecisionTreeClassifier(maxDepth=10, maxBins=256, seed=seed, **kw, **wkw) if cls
                else DecisionTreeRegressor(maxDepth=10, maxBins=256, seed=seed, **kw, **wkw))
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (C * n_rows), elasticNetParam=0.0, standardization=False,
                                  maxIter=200, **kw, **wkw)
    if name == "ridge":
        if sigma_y is None:
            raise ValueError("ridge needs the label's population deviation on the training rows")
        return LinearRegression(regParam=alpha * sigma_y / n_rows, elasticNetParam=0.0, standardization=False,
                                solver="normal", **kw, **wkw)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, **kw, **wkw)
    if name == "svm":
        reg = 1.0 / (10.0 * n_rows)
        if cls:
            return OneVsRest(classifier=LinearSVC(maxIter=100, regParam=reg), featuresCol=features, labelCol=label, **wkw)
        return LinearRegression(loss="huber", regParam=reg, **kw, **wkw)
    if name == "mlp":
        layers = [n_features or 1, 128, 64, n_classes or 2]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=200, seed=seed, **kw)
    raise ValueError(f"unknown model {name}")


def _boosted(cls: bool, features: str, label: str, wkw: dict, seed: int, n_classes: int | None, **params) -> Estimator:
    """Gradient boosting; more than two classes one against the rest."""
    if not cls:
        return GBTRegressor(featuresCol=features, labelCol=label, seed=seed, **params, **wkw)
    gbt = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **params, **wkw)
    return gbt if (n_classes or 2) <= 2 else OneVsRest(classifier=gbt, featuresCol=features, labelCol=label, **wkw)


def fold_statistics(df: DataFrame, folds: Sequence[int], label: str = "label", fold: str = "fold",
                    weight_col: str | None = None) -> dict[int, dict[str, float]]:
    """Per fold: rows (or weights) and the label's population deviation of the other folds, from one aggregation."""
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    y = F.col(label).cast("double")
    per = {r[fold]: r for r in df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(y).alias("s"),
                                                    F.sum(y * y).alias("q")).collect()}
    out = {}
    for f in folds:
        rest = [r for k, r in per.items() if k != f]
        n, s, q = (sum(r[c] for r in rest) for c in ("n", "s", "q"))
        out[f] = {"n_rows": sum(r["w"] for r in rest), "sigma_y": math.sqrt(max(0.0, q / n - (s / n) ** 2)) if n else 0.0}
    return out


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector; missing values stay in it as NaN."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def rbf_features(df: DataFrame, cols: Sequence[str], n: int = 100, gamma: float | None = None,
                 seed: int = SEED, out: str = "features") -> DataFrame:
    """M09/M10 mapping: random Fourier features ``sqrt(2/n)·cos(W x + b)`` approximating an
    RBF kernel, computed batch-wise (Arrow) with one matrix product per batch."""
    d = len(cols)
    g = gamma if gamma is not None else 1.0 / d
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * g), size=(n, d))
    b = rng.uniform(0, 2 * math.pi, size=n)

    @F.pandas_udf("array<double>")
    def rff(x: pd.Series) -> pd.Series:
        X = np.vstack(x.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        Z = math.sqrt(2.0 / n) * np.cos(X @ w.T + b)
        return pd.Series(list(Z))

    return df.withColumn(out, array_to_vector(rff(F.array(*[F.col(c).cast("double") for c in cols]))))


# ------------------------------------------------------------------ V05, V07, E17-E21
#: Training rows and bytes of features from which an iterated fit gets one more partition.
FIT_ROWS, FIT_BYTES = 10_000, 128 * 1024 * 1024


#: Learners whose fit keeps its training rows in memory and passes over them level by level.
_TREES = (DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier, RandomForestRegressor, GBTClassifier, GBTRegressor)


def _iterated(est: Estimator) -> bool:
    """Whether a fit is a long row of passes whose every task answers the driver and whose result does not hang on how
    rows are dealt to tasks (trees draw per partition; the normal solver takes one pass)."""
    est = est.getStages()[-1] if isinstance(est, Pipeline) else est
    est = est.getClassifier() if isinstance(est, OneVsRest) else est
    return (isinstance(est, (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier))
            or isinstance(est, LinearRegression) and est.getLoss() == "huber")


def fit_partitions(df: DataFrame, features: str = "features") -> int:
    """Partitions for an iterated fit on ``df``: by its rows up to the cluster's cores, beyond by the bytes of its features.
    Every pass sends one answer per task to the driver, so tasks grow by work, not by the files the rows lie in."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-n // FIT_ROWS)), -(-n * 8 * (width or 0) // FIT_BYTES))


#: Bytes that one task of a tree fit keeps of its training rows, and that one task reads of rows to permute.
TASK_BYTES = 128 * 1024 * 1024


def deal_to_trees(est: Estimator, df: DataFrame, features: str = "features") -> DataFrame:
    """Training rows of a tree learner, dealt anew where all of them take more than a task may keep; other rows stay as they are.

    A tree fit keeps its binned rows by the partitions they come in and reads a whole one per task and pass, so a task would
    grow with the table's files.  A kept row takes about 96 bytes, 4 for each feature and 4 for each tree of a forest."""
    inner = est.getStages()[-1] if isinstance(est, Pipeline) else est
    inner = inner.getClassifier() if isinstance(inner, OneVsRest) else inner
    if not isinstance(inner, _TREES):
        return df
    forest = inner.getNumTrees() if isinstance(inner, (RandomForestClassifier, RandomForestRegressor)) else 0
    vec = [c for c in (inner.getFeaturesCol(), features) if c in df.columns]
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(vec[0]))) if vec else F.lit(len(df.columns))).first()
    parts = -(-n * (96 + 4 * (width or 0) + 4 * forest) // TASK_BYTES)
    return df.repartition(parts) if parts > 1 else df


def fit_tree(est: Estimator, df: DataFrame, cols: Sequence[str]):
    """A model fitted on the columns ``cols`` of a table: plain decision trees by ``cart``, whose tasks stream their rows, others
    by their own fit on rows dealt to tasks."""
    rule = cart.rules(est)
    if rule is None:
        return est.fit(deal_to_trees(est, assemble(df, cols)))
    return cart.TreeModel(cart.grow(df, cols, [est.getLabelCol()], rule)[None, 0])


def oof_predict(df: DataFrame, make: Callable[[], Estimator], folds: Sequence[int], model_name: str,
                label: str = "label", row_id: str = "row_id", fold: str = "fold",
                parallelism: int = 4, train: dict[int, DataFrame] | None = None, features: str = "features") -> DataFrame:
    """Each row predicted by a model fitted on the other folds (k fits, one per fold).

    Like ``CrossValidator(parallelism=…)``, up to ``parallelism`` fold fits are
    submitted concurrently; each fit is itself a distributed job.  ``make`` may take
    the training fold's statistics (``n_rows``, ``sigma_y``) as keywords.  ``train`` has
    the training rows of each fold where they are not just the other folds' (``smote_folds``)."""
    needs = "n_rows" in inspect.signature(make).parameters
    stats = fold_statistics(df, folds, label, fold) if needs else {}
    if needs and train:
        stats = {f: stats[f] | {"n_rows": float(train[f].count())} for f in folds}

    made = {f: make(**stats[f]) if needs else make() for f in folds}
    # the whole table's partitions do for every fold; oversampled folds are looked at one by one
    whole = fit_partitions(df, features) if not train and any(map(_iterated, made.values())) else 0

    def one(f):
        rows = train[f] if train else df.where(F.col(fold) != f)
        if _iterated(made[f]):
            rows = rows.coalesce(whole or fit_partitions(rows, features))
        m = made[f].fit(deal_to_trees(made[f], rows, features))
        p = m.transform(df.where(F.col(fold) == f))
        return p.select(F.lit(model_name).alias("model"), row_id, fold, F.col(label).alias("y_true"),
                        F.col("prediction").alias("y_pred"))

    folds = list(folds)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(folds)))) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refit_predict(df: DataFrame, make: Callable[[], Estimator], label: str = "label") -> DataFrame:
    """Fit on all rows and predict the same rows (display only)."""
    return make().fit(df).transform(df).withColumn("in_sample", F.lit(True))


def benchmark(df: DataFrame, grid: dict[str, Callable[[], Estimator]], folds: Sequence[int], task: str,
              label: str = "label", train: dict[int, DataFrame] | None = None) -> tuple[DataFrame, list[dict]]:
    """V05 + E20 + E21 over a model grid: OOF table and one status row per model.
    The entry ``knn``, and entries with a true attribute ``whole``, take the table and return its OOF rows (staged, so
    that their time is measured)."""
    oofs, status = [], []
    for name, make in grid.items():
        t0 = time.time()
        try:
            o = make(df) if name == "knn" or getattr(make, "whole", False) else oof_predict(df, make, folds, name, label, train=train)
            oofs.append(o)
            status.append({"model": name, "status": "ok", "error": None, "fit_time_s": time.time() - t0})
        except Exception as e:  # noqa: BLE001 - a failed model stays as a row (E21)
            status.append({"model": name, "status": "error", "error": str(e), "fit_time_s": time.time() - t0})
    if not oofs:
        raise RuntimeError(f"every model failed: {status}")
    oof = oofs[0]
    for o in oofs[1:]:
        oof = oof.unionByName(o)
    return oof, status


def status_table(spark, status: list[dict]) -> DataFrame:
    """E20 / E21 rows."""
    return spark.createDataFrame(status, "model string, status string, error string, fit_time_s double")


def feature_importances(spark, model, names: Sequence[str]) -> DataFrame:
    """Impurity importances of a fitted tree ensemble as rows."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")


def importance_spread(spark, model, names: Sequence[str]) -> DataFrame:
    """Mean and population std of the importances over the trees."""
    rows = [(t, n, float(v)) for t, tree in enumerate(model.trees)
            for n, v in zip(names, tree.featureImportances.toArray().tolist())]
    df = spark.createDataFrame(rows, "tree int, feature string, importance double")
    return df.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))


#: Rows of a block in which a column is permuted (blocks hold one to two times as many on average).
PERMUTE_ROWS = 1000


def _blocks(df: DataFrame, features: Sequence[str], repeats: int, seed: int, row_id: str,
            keep: Sequence[str]) -> tuple[DataFrame, Callable[[int, int], np.ndarray]]:
    """E19 helper: the rows with their block (``_b``), their place in it (``_h``, ``_id``), kept columns ``_k0`` ... and features ``_x0``
    ..., and the rows of a block of ``m`` that lend their feature in a repeat."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    n = df.count()
    blocks = max(1, n // PERMUTE_ROWS)
    u = np.random.default_rng(seed).random(repeats)
    # features go by place, so that no column of the table can clash with the helper's names
    base = df.select(F.col(row_id).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                     *[F.col(c).alias(f"_x{i}") for i, c in enumerate(features)], h.alias("_h"))
    # the hash is shuffled as bytes, which sort like its text
    base = base.withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(blocks))).withColumn("_h", F.unhex("_h"))
    # more rows than the session's shuffle partitions hold get more of them (a row: its hash, block and columns)
    parts = -(-n * (64 + 8 * (len(base.columns) - 2)) // TASK_BYTES)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        base = base.repartition(parts, "_b")
    return base, lambda m, k: (np.arange(m) + (int(u[k] * (m - 1)) + 1)) % m


def permuted_copies(df: DataFrame, features: Sequence[str], repeats: int, seed: int = SEED, row_id: str = "row_id",
                    keep: Sequence[str] = ()) -> DataFrame:
    """E19 helper: for every feature and repeat a copy of the table (``row_id``, ``keep``, features) in which that feature is permuted.

    Rows fall into random blocks by a seeded hash of their id; in a repeat each row takes the feature of the row a seeded
    distance further on in its block's hash order (a permutation without fixed points).  Every row is shuffled once, on
    its block; the copies arise in the task that holds the block and go on to the model without another shuffle.
    NULL features move like values; a table of one row has nothing to trade and keeps its values."""
    features, keep = list(features), [c for c in keep if c != row_id]
    base, shift = _blocks(df, features, repeats, seed, row_id, keep)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    own = [c for c in base.columns if c not in ("_h", "_b")]
    moved = [c for c in own if c.startswith("_x")]

    def copies(block: pa.Table) -> pa.Table:
        block = block.sort_by([("_h", "ascending"), ("_id", "ascending")])
        m = block.num_rows
        out = []
        for k in range(repeats):
            other = block.take(pa.array(shift(m, k)))
            out.append(pa.table([pa.array(np.full(m, k, np.int32)), *[block[c] for c in own], *[other[c] for c in moved]],
                                ["repeat", *own, *[f"_o{c}" for c in moved]]))
        return pa.concat_tables(out)

    schema = ", ".join(["repeat int", *[f"{c} {kinds[c]}" for c in own], *[f"_o{c} {kinds[c]}" for c in moved]])
    each = base.groupBy("_b").applyInArrow(copies, schema)
    each = each.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_f") + 1)
    return each.select(F.col("_id").alias(row_id), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "repeat", name.alias("feature"),
                       *[F.when(F.col("_f") == i, F.col(f"_o_x{i}")).otherwise(F.col(f"_x{i}")).alias(c) for i, c in enumerate(features)])


def permuted_counts(model: "cart.TreeModel", df: DataFrame, features: Sequence[str], repeats: int, seed: int = SEED, row_id: str = "row_id",
                    label: str = "label") -> DataFrame:
    """How often a tree predicts what for every label in the copies of ``permuted_copies``: (feature, repeat, y_true, y_pred, n), and
    in the table itself (a null feature); written once.  The copies are numbers in the task that holds their block; only
    counts leave it."""
    features = list(features)
    base, shift = _blocks(df, features, repeats, seed, row_id, [label])
    base = base.select(F.col("_k0").cast("string").alias("y"), *[F.col(f"_x{i}").cast("double").alias(f"_x{i}") for i in range(len(features))], "_h", "_b")
    used = {f for f, left in zip(model.tree["feature"], model.tree["left"]) if left >= 0}
    classes = int(max(model.tree["value"])) + 1

    def counts(block: pa.Table) -> pa.Table:
        block = block.sort_by("_h")
        m = block.num_rows
        y = block["y"].combine_chunks().dictionary_encode(null_encoding="encode")
        x = np.column_stack([block[f"_x{i}"].to_numpy().astype(np.float64) for i in range(len(features))])
        code, others = y.indices.to_numpy(), np.concatenate([shift(m, k) for k in range(repeats)])
        many, own = np.tile(x, (repeats, 1)), model.predict(x).astype(np.int64)
        kinds, out = len(y.dictionary), []
        cell = (np.repeat(np.arange(repeats), m) * kinds + np.tile(code, repeats)) * classes
        for f in range(-1, len(features)):
            if f in used:
                many[:, f] = x[others, f]
                p = model.predict(many).astype(np.int64)
                many[:, f] = np.tile(x[:, f], repeats)
            else:
                p = np.tile(own, repeats) if f >= 0 else own
            n = np.bincount(cell[:len(p)] + p)
            at = np.flatnonzero(n)
            out.append(pa.table([pa.array(np.full(len(at), f, np.int32)), pa.array((at // (kinds * classes)).astype(np.int32)),
                                 y.dictionary.take(pa.array(at // classes % kinds)), pa.array((at % classes).astype(np.float64)), pa.array(n[at])],
                                ["f", "repeat", "y_true", "p", "n"]))
        return pa.concat_tables(out)

    each = base.groupBy("_b").applyInArrow(counts, "f int, repeat int, y_true string, p double, n long")
    each = each.groupBy("f", "repeat", "y_true", "p").agg(F.sum("n").alias("n"))
    name = F.when(F.col("f") >= 0, F.element_at(F.array(*[F.lit(c) for c in features]), F.col("f") + 1))
    return write_stage(each.select(name.alias("feature"), "repeat", "y_true", F.col("p").cast("string").alias("y_pred"), "n"))


# ------------------------------------------------------------------ J09 / J10 / M11 / M12: exact kNN, blocks pruned by pivots
MAX_PIVOTS = 1024
_SLACK = 1e-9             # relative rounding allowed for in distance bounds


def _matrix(column) -> np.ndarray:
    """An Arrow list column or a pandas column of lists as a matrix."""
    rows = column.to_numpy() if isinstance(column, pd.Series) else column.to_numpy(zero_copy_only=False)
    return np.vstack([np.asarray(v, dtype=np.float64) for v in rows])


_PIECE = 4_000_000        # numbers (32 MB) that a task makes at a time


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _copies(b: pa.RecordBatch, at: np.ndarray, block: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Row ``at[i]`` for block ``block[i]``: a row may visit every block, so the copied vectors go out piece by piece."""
    rows = max(1, _PIECE // max(1, width))
    for s in range(0, len(at), rows):
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(at[s:s + rows])).columns, pa.array(block[s:s + rows], pa.int32())],
                                         names=[*b.schema.names, "_b"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``, by differences, in pieces of about 32 MB."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        diff = a[k:k + step, None, :] - b[None, :, :]
        out[k:k + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def choose_pivots(ref: DataFrame, n: int, vec: str, rid: str) -> np.ndarray:
    """``n`` reference vectors far from one another: farthest-first over ``4 n`` rows in hash order (``4 * MAX_PIVOTS``
    rows at most reach the driver)."""
    rows = ref.select(rid, vec).where(F.col(vec).isNotNull()).orderBy(F.xxhash64(rid), rid).limit(4 * n).select(vec).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x):
        return x
    chosen = [0]
    gap = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    return x[chosen]


#: Bytes of chunks of references that a task streams past a chunk of queries.
STREAM_BYTES = 64 * 1024 * 1024
_CACHED = 2 ** 19          # distances made at a time, so that they are compared before they leave the processor's cache
#: Classes fall into so many groups whose chunks never meet another group's.
CLASS_GROUPS = 64


def exact_nearest(best: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, dist2: np.ndarray, rid: np.ndarray,
                  null: np.ndarray) -> None:
    """Candidates (row, squared distance, rid, whether the rid is null) put into every row's k best, which are held in
    order: distance, null rids first, then the smaller rid."""
    d, r, n = best
    k = d.shape[1]
    at = np.unique(rows)
    where = np.concatenate([np.repeat(at, k), rows])
    d2, ids, nulls = np.concatenate([d[at].ravel(), dist2]), np.concatenate([r[at].ravel(), rid]), np.concatenate([n[at].ravel(), null])
    o = np.lexsort((ids, ~nulls, d2, where))
    where = where[o]
    place = np.arange(len(o)) - np.searchsorted(where, where)
    keep = place < k
    for into, v in ((d, d2), (r, ids), (n, nulls)):
        into[where[keep], place[keep]] = v[o][keep]


def meet_cell(best: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, a: np.ndarray, b: np.ndarray, centre: np.ndarray,
              ub: np.ndarray, rid: np.ndarray, null: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
    """Rows ``at`` of the queries ``a`` meet all of ``b``, the references around ``centre``; ``apart`` marks pairs that don't count.

    A product in single precision bounds every squared distance from below (its rounding is bounded by the lengths);
    only pairs that the bound leaves among a row's k best are measured by differences, in pieces."""
    k = best[0].shape[1]
    width = a.shape[1]
    y = b - centre
    scale = max(float(np.abs(y).max(initial=0.0)), float(np.abs(a[at] - centre).max(initial=0.0))) or 1.0
    sure = 1e-100 < scale < 1e100
    if sure:
        y /= scale
        yy = np.einsum("ij,ij->i", y, y)
        right = np.hstack([y, yy[:, None]]).astype(np.float32).T.copy()
        slack = (width + 8) * 2.0 ** -24 * 1.1
    step = max(1, min(_PIECE, _CACHED) // len(b))
    few = max(1, _PIECE // width)
    for s in range(0, len(at), step):
        rows = at[s:s + step]
        if sure:
            x = (a[rows] - centre) / scale
            xx = np.einsum("ij,ij->i", x, x)
            err = slack * (xx + 2 * yy.max(initial=0.0)) + 1e-30
            low = np.hstack([-2 * x, np.ones((len(x), 1))]).astype(np.float32) @ right
            limit = np.minimum(best[0][rows, k - 1], ub[rows]) / (scale * scale) - xx + err
            if (open_ := np.flatnonzero(~np.isfinite(limit))).size:
                # rows that hold fewer than k yet: the k-th of this piece bounds them
                if apart is not None:
                    i, j = (v.ravel() for v in np.indices((len(open_), len(b))))
                    hide = apart(rows[open_][i], j)
                    low[open_[i[hide]], j[hide]] = np.inf
                if len(b) > k:
                    limit[open_] = np.partition(low[open_], k - 1, axis=1)[:, k - 1] + 2 * err[open_]
            # rounded up, so that the limit's own rounding hides no pair
            i, j = np.divmod(np.flatnonzero(low <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), len(b))
        else:
            i, j = (v.ravel() for v in np.indices((len(rows), len(b))))
        for c in range(0, len(i), few):
            ii, jj = rows[i[c:c + few]], j[c:c + few]
            diff = a[ii] - b[jj]
            d2 = np.einsum("ij,ij->i", diff, diff)
            keep = np.isfinite(d2) & (d2 <= best[0][ii, k - 1]) & (d2 <= ub[ii])
            if apart is not None:
                keep &= ~apart(ii, jj)
            if keep.any():
                exact_nearest(best, ii[keep], d2[keep], rid[jj[keep]], null[jj[keep]])


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of ``width`` present numbers each, as a matrix without a copy per row."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _whole_numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and whether they are null."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy()


def knn(query: DataFrame, ref: DataFrame, k: int, vec: str = "vec", qid: str = "qid", rid: str = "rid",
        within: str | None = None, exclude_self: bool = False, block_rows: int = 8192, differ: str | None = None) -> DataFrame:
    """Exact k nearest references per query row: ``(qid, rid, dist2, rank)``, ties to the smaller rid.

    ``within`` restricts neighbours to rows with the same value (e.g. class), ``differ`` to rows with another value
    (e.g. fold).  See ``knn_visits`` for the method."""
    return knn_visits(query, ref, k, vec, qid, rid, within, exclude_self, block_rows, differ)[0]


def knn_visits(query: DataFrame, ref: DataFrame, k: int, vec: str = "vec", qid: str = "qid", rid: str = "rid",
               within: str | None = None, exclude_self: bool = False, block_rows: int = 8192,
               differ: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``knn`` and, per query, the number of references it was compared with (qid, met).

    References go to the block of their nearest pivot (half the square root of their number, ``MAX_PIVOTS`` at most);
    a block knows its radius.  In the first round a query meets the blocks of its nearest pivots until they hold
    ``4 k`` rows; its k-th distance there bounds the answer.  By the triangle inequality a block whose pivot is
    farther than that bound plus the block's radius holds no neighbour, so the second round visits the other blocks
    only.

    Both sides lie in chunks of at most ``block_rows`` rows of neighbouring blocks, each one row of a stage table.  A task
    holds one chunk of queries and streams the chunks of references past it (``STREAM_BYTES`` of them), so a vector is
    shuffled once a round, whatever it visits; ``k`` candidates per query leave a task, and no pair is a row.
    Vectors with a missing or infinite component have no distance to any other and no neighbours."""
    spark = query.sparkSession
    extra = F.col(differ).cast("long") if differ else F.lit(None).cast("long")

    def base(df: DataFrame, ident: str) -> DataFrame:
        kind = df.schema[within].dataType.typeName() if within else ""
        # the two zeros of a fraction are one class
        cls = F.col(within) + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(within) if within else F.lit(0)
        group = F.pmod(F.xxhash64(cls), F.lit(CLASS_GROUPS)).cast("int") if within else F.lit(0)
        d = df.select(F.col(ident).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v"), extra.alias("_d"),
                      cls.alias("_g"), group.alias("_k"))
        return d.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    # both sides are written once; what is derived from them (blocks, visits) is cheap and made again where it is read
    held = write_stage(base(ref, rid))
    n_held = held.count()
    pivots = choose_pivots(held, max(1, min(MAX_PIVOTS, math.isqrt(n_held) // 2)), "_v", "_id")
    if not len(pivots):
        none = spark.createDataFrame([], "qid long, rid long, dist2 double, rank int")
        return none, none.select("qid", F.lit(0).cast("long").alias("met"))

    width, n_pivots = max(1, pivots.shape[1]), len(pivots)
    few = max(1, _PIECE // (8 * n_pivots))          # a row has a few numbers per pivot
    groups = CLASS_GROUPS if within else 1
    side_cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, few):
            if b.num_rows:
                d = _distances(_matrix(b.column("_v")), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                                                 names=["_k", "_b", "_dist"])

    def cells(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows and radius of every block in every group of classes (a number per pivot and group)."""
        n, radius = np.zeros((groups, n_pivots), np.int64), np.zeros((groups, n_pivots))
        found = df.select("_k", "_v").mapInArrow(place, "_k int, _b int, _dist double").groupBy("_k", "_b")
        for r in found.agg(F.count(F.lit(1)).alias("n"), F.max("_dist").alias("r")).collect():
            n[r["_k"], r["_b"]], radius[r["_k"], r["_b"]] = r["n"], r["r"]
        return n, radius

    def chunked(n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
        """First chunk of every cell, over how many chunks it is dealt, and the number of chunks.  Neighbouring cells of
        a group share a chunk up to ``rows`` rows; a larger cell has chunks of its own."""
        first, parts, at, full = np.zeros_like(n), np.ones_like(n), -1, rows
        for g in range(len(n)):
            full = rows                                                                     # a group begins a chunk
            for c in np.flatnonzero(n[g]):
                m = -(-int(n[g, c]) // rows)
                if m > 1 or full + n[g, c] > rows:
                    first[g, c], parts[g, c], full = at + 1, m, rows if m > 1 else n[g, c]
                    at += m
                else:
                    first[g, c], full = at, full + n[g, c]
        return first, parts, at + 1

    most = max(1, min(block_rows, _PIECE // width))
    count, far = cells(held)
    size, radius = count.sum(axis=0), far.max(axis=0)
    first, parts, n_chunks = chunked(count, most)

    def visits(v: np.ndarray, ub: np.ndarray | None) -> np.ndarray:
        """The blocks that queries visit in the first round, or with bounds in the second."""
        d = _distances(v, pivots)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        now = np.zeros(d.shape, bool)
        np.put_along_axis(now, order, before < 4 * k, axis=1)
        if ub is not None:
            now = ~now & (d * (1 - _SLACK) <= (np.sqrt(ub)[:, None] + radius[None, :]) * (1 + _SLACK))
        return now & (size > 0)

    def bounds(b) -> np.ndarray:
        ub = b.column("_ub").to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b["_ub"].to_numpy()
        return np.where(np.isnan(ub := ub.astype(np.float64)), np.inf, ub)

    def chunks_of(df: DataFrame, first: np.ndarray, parts: np.ndarray, n_chunks: int, second: bool | None) -> DataFrame:
        """A side's chunks (_c, _rows), rows by block; those of queries (``second`` set) with the chunks that they want."""
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = 0
            for b in _cut(batches, few):
                if b.num_rows:
                    near = _distances(_matrix(b.column("_v")), pivots).argmin(axis=1)
                    g = b.column("_k").to_numpy(zero_copy_only=False)
                    chunk = first[g, near] + (turn + np.arange(len(near))) % parts[g, near]     # a large cell's rows by turns
                    turn += len(near)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(chunk, pa.int32())],
                                                     names=[*b.schema.names, "_b", "_c"])

        def pack(block: pa.Table) -> pa.Table:
            block = block.sort_by("_b")
            c, g, want = block["_c"][0].as_py(), block["_k"][0].as_py(), []
            if second is not None:
                ub, marks, blocks = bounds(block), [], np.zeros(n_pivots, bool)
                for s in range(0, block.num_rows, few):
                    seen = visits(_matrix(block["_v"].slice(s, few).combine_chunks()), ub[s:s + few] if second else None)
                    marks += [m.tobytes() for m in np.packbits(seen, axis=1)]
                    blocks |= seen.any(axis=0)
                block = block.append_column("_seen", pa.array(marks, pa.binary()))
                cells = np.flatnonzero(blocks & (count[g] > 0))
                want = sorted({int(x) for j in cells for x in range(ref_first[g, j], ref_first[g, j] + ref_parts[g, j])})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as w:
                w.write_table(block.combine_chunks())
            return pa.table([pa.array([c], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([want], pa.list_(pa.int32()))],
                            names=["_c", "_rows", "_want"])

        more = "" if second is None else ", _ub double"
        dealt = df.mapInArrow(deal, f"{side_cols}{more}, _b int, _c int").repartition(max(1, n_chunks), "_c")
        return write_stage(dealt.groupBy("_c").applyInArrow(pack, "_c int, _rows binary, _want array<int>"))

    ref_first, ref_parts = first, parts
    refs = chunks_of(held, first, parts, n_chunks, None).select(F.col("_c").alias("_rc"), F.col("_rows").alias("_refs"))
    streams = -(-n_held * (8 * width + 32) // STREAM_BYTES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q, best = None, {}, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None and (i := np.nonzero(np.isfinite(best[0])))[0].size:
                ids, nulls = q["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[0]], mask=nulls[i[0]]), pa.array(best[1][i], mask=best[2][i]), pa.array(best[0][i])],
                                                 names=["qid", "rid", "dist2"])

        for b in batches:
            for row in range(b.num_rows):
                if (c := b.column("_qc")[row].as_py()) != at:
                    yield from done()
                    t = pa.ipc.open_stream(b.column("_queries")[row].as_buffer()).read_all().combine_chunks()
                    seen = np.frombuffer(b"".join(t["_seen"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    q = {"v": _vectors(t["_v"], width), "ids": _whole_numbers(t["_id"]), "d": _whole_numbers(t["_d"]), "g": t["_g"],
                         "seen": np.unpackbits(seen, axis=1, count=n_pivots).astype(bool), "ub": bounds(t)}
                    best = (np.full((t.num_rows, k), np.inf), np.zeros((t.num_rows, k), np.int64), np.zeros((t.num_rows, k), bool))
                    at = c
                r = pa.ipc.open_stream(b.column("_refs")[row].as_buffer()).read_all().combine_chunks()
                v, (ids, nulls), (d, d_null) = _vectors(r["_v"], width), _whole_numbers(r["_id"]), _whole_numbers(r["_d"])
                both = pa.chunked_array([*q["g"].chunks, *r["_g"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                qg, rg = both[:len(q["v"])], both[len(q["v"]):]
                block = r["_b"].to_numpy()
                found, start = np.unique(block, return_index=True)
                for j, s, e in zip(found, start, [*start[1:], len(block)]):
                    if (rows := np.flatnonzero(q["seen"][:, j])).size:
                        def apart(qi: np.ndarray, ri: np.ndarray, s: int = s) -> np.ndarray:
                            ri = ri + s
                            out = qg[qi] != rg[ri]
                            if exclude_self:
                                out |= (q["ids"][0][qi] == ids[ri]) & ~q["ids"][1][qi] & ~nulls[ri]
                            if differ:
                                out |= (q["d"][0][qi] == d[ri]) & ~q["d"][1][qi] & ~d_null[ri]
                            return out
                        meet_cell(best, rows, q["v"], v[s:e], pivots[j], q["ub"], ids[s:e], nulls[s:e],
                                  apart if within or exclude_self or differ else None)
        yield from done()

    def meet(asked: DataFrame, second: bool) -> DataFrame:
        """Candidates of the queries' visits: every chunk of queries streams the chunks it wants."""
        q = chunks_of(asked, *query_chunks, second).select(F.col("_c").alias("_qc"), F.col("_rows").alias("_queries"), "_want")
        pairs = q.join(refs.coalesce(max(1, streams)).hint("shuffle_replicate_nl"), F.array_contains("_want", F.col("_rc")))
        return pairs.drop("_want").mapInArrow(search, "qid long, rid long, dist2 double")

    def compared(second: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _cut(batches, few):
                if b.num_rows:
                    seen = visits(_matrix(b.column("_v")), bounds(b) if second else None)
                    yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(seen @ size)], names=["qid", "met"])
        return run

    queries = write_stage(base(query, qid).withColumn("_ub", F.lit(None).cast("double")))
    n_cells = cells(queries)[0]
    # a chunk of queries per core and more, as far as chunks of 256 rows go
    tasks = 3 * spark.sparkContext.defaultParallelism
    query_chunks = chunked(n_cells, max(1, min(most, _PIECE // n_pivots, max(256, -(-int(n_cells.sum()) // tasks)))))

    w = Window.partitionBy("qid").orderBy("dist2", "rid")    # the group limit cuts to k rows before the shuffle
    best = lambda c: c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rid", "dist2", "rank")
    near = write_stage(best(meet(queries, False)))
    found = near.where(F.col("rank") == k).select(F.col("qid").alias("_id"), F.col("dist2").alias("_ub"))
    more = queries.drop("_ub").join(found, "_id", "left").select(*queries.columns)
    met = (queries.mapInArrow(compared(False), "qid long, met long").unionByName(more.mapInArrow(compared(True), "qid long, met long"))
           .groupBy("qid").agg(F.sum("met").alias("met")))
    return best(near.drop("rank").unionByName(meet(more, True))), met


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, task: str = "classification", vec: str = "vec",
                label: str = "label", row_id: str = "row_id", differ: str | None = None) -> DataFrame:
    """Majority vote (ties to the smallest label) or mean of the k nearest training rows."""
    more = [differ] if differ else []
    nn = knn(test.select(F.col(row_id).alias("qid"), vec, *more), train.select(F.col(row_id).alias("rid"), vec, *more), k,
             vec=vec, differ=differ)
    lab = train.select(F.col(row_id).alias("rid"), F.col(label).alias("_y"))
    j = nn.join(lab, "rid")
    if task == "regression":
        return j.groupBy(F.col("qid").alias(row_id)).agg(F.avg("_y").alias("prediction"))
    votes = j.groupBy("qid", "_y").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(F.col("qid").alias(row_id)).agg(
        F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("prediction"))


def knn_oof(df: DataFrame, k: int, task: str, vec: str = "vec", label: str = "label",
            row_id: str = "row_id", fold: str = "fold", model_name: str = "knn") -> DataFrame:
    """V05 for M11/M12: one block plan in which references of the query's own fold do not count."""
    p = knn_predict(df, df, k, task, vec, label, row_id, differ=fold)
    return (p.join(df.select(row_id, fold, F.col(label).alias("y_true")), row_id)
            .select(F.lit(model_name).alias("model"), row_id, fold, "y_true", F.col("prediction").alias("y_pred")))


def scale_by_fold(df: DataFrame, folds: Sequence[int], vec: str = "vec", fold: str = "fold", out: str = "vec",
                  train: dict[int, DataFrame] | None = None) -> list[DataFrame]:
    """M01 inside the folds for models without an estimator: per fold the whole table, standardised with the means
    and deviations of the other folds.  With ``train`` those are the means and deviations of its rows, which take
    the place of the other folds and have a null fold."""
    parts = []
    for f in folds:
        rest = train[f] if train else df.where(F.col(fold) != f)
        m = StandardScaler(inputCol="_in", outputCol="_out", withMean=True).fit(rest.withColumn("_in", array_to_vector(vec)))
        whole = df if not train else df.where(F.col(fold) == f).unionByName(
            rest.withColumn(fold, F.lit(None).cast("int")), allowMissingColumns=True)
        parts.append(m.transform(whole.withColumn("_in", array_to_vector(vec))).withColumn(out, vector_to_array("_out")).drop("_in", "_out"))
    return parts


def knn_oof_scaled(df: DataFrame, k: int, folds: Sequence[int], task: str, vec: str = "vec", label: str = "label",
                   row_id: str = "row_id", fold: str = "fold", model_name: str = "knn",
                   train: dict[int, DataFrame] | None = None) -> DataFrame:
    """M11 / M12 as in the benchmark: scaled on each training fold, then voted; written once."""
    out = None
    for f, scaled in zip(folds, scale_by_fold(df, folds, vec, fold, train=train)):
        p = knn_predict(scaled.where(~F.col(fold).eqNullSafe(f)), scaled.where(F.col(fold) == f), k, task, vec, label, row_id)
        p = (p.join(df.select(row_id, fold, F.col(label).alias("y_true")), row_id)
             .select(F.lit(model_name).alias("model"), row_id, fold, "y_true", F.col("prediction").alias("y_pred")))
        out = p if out is None else out.unionByName(p)
    return write_stage(out)


# ------------------------------------------------------------------ B03 SMOTE
def smote(df: DataFrame, y: str, vec: str = "vec", row_id: str = "row_id", k: int = 5, seed: int = SEED) -> DataFrame:
    """Oversample every class to the majority count with synthetic points
    ``x + λ (neighbour − x)`` between a row and one of its k same-class nearest
    neighbours (k = min(5, n_class − 1); classes with k < 1 are copied as is).
    Neighbour choice and λ come from md5(seed | row | copy), so the output is
    deterministic.  Output adds ``is_synthetic``."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    nmax = counts.agg(F.max("_nc").alias("_nmax"))
    base = df.join(counts, y)
    base = with_scalars(base, nmax)
    from flankwear.operators.ordering import with_position
    base = with_position(base.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))),
                         [y], ["_h"], name="_p")
    need = F.col("_nmax") - F.col("_nc")
    copies = F.when(need > F.col("_p"), F.ceil((need - F.col("_p")) / F.col("_nc"))).otherwise(0).cast("int")
    req = (base.where(copies > 0).select(row_id, y, vec, "_nc", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_q")))
    nn = knn(base.where(copies > 0).select(F.col(row_id).alias("qid"), vec, y), df.select(F.col(row_id).alias("rid"), vec, y), k,
             vec=vec, within=y, exclude_self=True)
    kk = nn.groupBy("qid").agg(F.count(F.lit(1)).alias("_k"))
    hsh = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"), F.col("_q").cast("string")))
    u1 = F.conv(F.substring(hsh, 1, 8), 16, 10).cast("double") / 4294967296.0
    u2 = F.conv(F.substring(hsh, 9, 8), 16, 10).cast("double") / 4294967296.0
    req = req.join(kk.withColumnRenamed("qid", row_id), row_id, "left").where(F.col("_k") >= 1)
    req = req.withColumn("rank", (F.floor(u1 * F.col("_k")) + 1).cast("int")).withColumn("_lam", u2)
    req = req.join(nn.withColumnRenamed("qid", row_id), [row_id, "rank"])
    nv = df.select(F.col(row_id).alias("rid"), F.col(vec).alias("_nv"))
    syn = req.join(nv, "rid").select(
        (-F.abs(F.xxhash64(F.col(row_id), F.col("_q"), F.lit(seed))) - 1).alias(row_id), y,
        F.zip_with(vec, "_nv", lambda a, b: a + F.col("_lam") * (b - a)).alias(vec),
        F.lit(True).alias("is_synthetic"))
    orig = df.select(row_id, y, vec, F.lit(False).alias("is_synthetic"))
    return orig.unionByName(syn)


def smote_folds(df: DataFrame, folds: Sequence[int], label: str = "label", vec: str = "vec", row_id: str = "row_id",
                fold: str = "fold", features: str = "features") -> dict[int, DataFrame]:
    """B03 inside the folds (Q10): per fold the rows of the other folds, oversampled; written once for all models."""
    filled = F.transform(vec, lambda x: F.coalesce(x, F.lit(float("nan"))))
    return {f: write_stage(smote(df.where(F.col(fold) != f), label, vec, row_id).withColumn(features, array_to_vector(filled)))
            for f in folds}


# ------------------------------------------------------------------ M18, M20, E19
def multi_output_predict(df: DataFrame, features: Sequence[str], targets: Sequence[str],
                         make: Callable[[str], Estimator], row_id: str = "row_id",
                         folds: Sequence[int] | None = None, fold: str = "fold") -> DataFrame:
    """One regressor per target; every row with a ``row_id`` gets all its predictions in one pass.
    With ``folds`` each target's predictions are out-of-fold (V05), else in-sample (V07).  Plain decision trees of the same
    settings grow together (``cart.grow``), other estimators are fitted one by one."""
    made = [make(t) for t in targets]
    grown = [cart.rules(est) if est.hasParam("labelCol") and est.getLabelCol() == t else None for est, t in zip(made, targets)]
    if grown and None not in grown and all(r == grown[0] and not r["cls"] for r in grown):
        # plain decision trees: all targets and folds grow in the same passes
        return cart.predict_targets(df, features, targets, cart.grow(df, features, targets, grown[0], folds, fold), row_id, folds, fold)
    base = assemble(df, features)
    # (target, fold) fits side by side; a fold's rows pass through its models one after another, without a join
    parts = [None] if folds is None else list(folds)
    wanted = [(f, t) for t in targets for f in parts]
    with ThreadPoolExecutor(max_workers=4) as pool:
        fitted = dict(zip(wanted, pool.map(lambda w: make(w[1]).fit(base if w[0] is None else base.where(F.col(fold) != w[0])), wanted)))
    out = None
    for f in parts:
        p = (base if f is None else base.where(F.col(fold) == f)).where(F.col(row_id).isNotNull())
        for t in targets:
            p = fitted[f, t].transform(p).select(*[F.col(f"`{c}`") for c in p.columns], F.col("prediction").alias(f"{t}_pred"))
        p = p.select(row_id, *([fold] if folds is not None else []), *[c for t in targets for c in (f"{t}_pred", F.col(t).alias(f"{t}_true"))])
        out = p if out is None else out.unionByName(p)
    return out


def with_source_feature(df: DataFrame, source: str = "source", out: str = "source_idx") -> DataFrame:
    """The data source as an alphabetical index, ready to join the feature vector."""
    from flankwear.functions.scalar import label_encode
    return label_encode(df, source, out=out)


def permutation_importance(model, df: DataFrame, features: Sequence[str], label: str = "label",
                           repeats: int = 10, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Mean drop (and its deviation) of the support-weighted F1 when one feature column is permuted
    (seeded, per repeat).  All features and repeats are scored in one plan; those of a ``cart`` tree where their block lies."""
    from flankwear.operators.evaluate import f1_weighted

    def score(frame: DataFrame, by: list[str]) -> DataFrame:
        pred = model.transform(assemble(frame, features)).select(
            *by, row_id, F.col(label).cast("string").alias("y_true"), F.col("prediction").cast("string").alias("y_pred"))
        return f1_weighted(pred, by)

    if isinstance(model, cart.TreeModel):
        counts = permuted_counts(model, df, features, repeats, seed, row_id, label)
        whole = f1_weighted(counts.where(F.col("feature").isNull()), ["repeat"], "n")
        each = f1_weighted(counts.where(F.col("feature").isNotNull()), ["feature", "repeat"], "n")
    else:
        whole = score(df.withColumn("model", F.lit("m")), ["model"])
        each = score(permuted_copies(df, features, repeats, seed, row_id, [label]), ["feature", "repeat"])
    whole = whole.select(F.col("f1_weighted").alias("_whole"))
    drop = F.col("_whole") - F.col("f1_weighted")
    return (with_scalars(each, whole).groupBy("feature")
            .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std")))
