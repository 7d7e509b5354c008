"""Decision trees by the rules of Spark's own learner, grown for all folds and targets at once.

Spark's learner keeps a table's rows in memory for every single fit and passes over them level by level.  Here rows are
cut into bins and written once.  Rows that lie in the same bins are one row to the learner: where that makes them few,
their counts and sums take their place.  A level of all models is one pass whose tasks return histograms; sums are merged
and splits chosen in Spark tasks, and only splits reach the driver, which holds the trees (bounded by ``max_depth``).

Candidate cuts, gains, leaves and ties follow Spark's learner: cuts lie between neighbouring values, or where a sample of
``max(bins^2, 10,000)`` rows has too many values, between quantiles; the first feature and lowest cut win a tie; a node
stays whole at ``max_depth``, where no cut gains, or where its impurity is 0.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.operators.trees import BUCKETS, _merge
from flankwear.session import write_stage

#: Bytes of histograms that a task adds up in one pass; nodes beyond them wait for another pass of their level.
GROUP_BYTES = 64 * 1024 * 1024
#: Rows that a task takes at a time.
AT_ONCE = 2 ** 18
#: Rows in the same bins are added up beforehand where that leaves this share of them or less.
FEWER = 0.25
_EPSILON = 2.0 ** -52


def rules(est: Estimator, features: str = "features") -> dict | None:
    """What a plain decision tree of Spark's grows by; None for any other estimator, subclasses too, whose fit is its own."""
    if type(est) not in (DecisionTreeClassifier, DecisionTreeRegressor):
        return None
    cls = type(est) is DecisionTreeClassifier
    if (est.getFeaturesCol() != features or est.isSet(est.weightCol) or est.getImpurity() != ("gini" if cls else "variance")
            or cls and est.isSet(est.thresholds) or est.getMinWeightFractionPerNode() or est.getLeafCol()):
        return None
    return {"cls": cls, "depth": est.getMaxDepth(), "bins": est.getMaxBins(), "min_rows": est.getMinInstancesPerNode(),
            "min_gain": est.getMinInfoGain(), "seed": est.getSeed()}


def cut_points(values: np.ndarray, n_splits: int) -> np.ndarray:
    """Spark's candidate cuts of a feature: between all neighbouring values, or if they are too many at about equal counts."""
    v, n = np.unique(values + 0.0, return_counts=True)
    between = (v[:-1] + v[1:]) / 2.0
    if len(between) <= n_splits:
        return between
    stride = len(values) / (n_splits + 1)
    out, target, before = [], stride, 0
    for k, now in enumerate(np.cumsum(n).tolist()):
        if k and abs(before - target) < abs(now - target):
            out.append(between[k - 1])
            target += stride
        before = now
    return np.array(out)


def impurity(s: np.ndarray, cls: bool) -> np.ndarray:
    """Gini of class counts, or the variance of (rows, sum, sum of squares)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if cls:
            n, out = s.sum(-1), np.ones(s.shape[:-1])
            for c in range(s.shape[-1]):
                f = s[..., c] / n
                out = out - f * f
        else:
            n = s[..., 0]
            out = (s[..., 2] - s[..., 1] * s[..., 1] / n) / n
    return np.where(n == 0, 0.0, out)


def best_cut(hists: Sequence[np.ndarray | None], total: np.ndarray, rule: dict) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Feature, bin, left and right sums of the cut that gains most, from a node's sums by bin of every feature, or None."""
    cls, best, parent = rule["cls"], None, impurity(total, rule["cls"])
    rows = (lambda s: s.sum(-1)) if cls else (lambda s: s[..., 0])
    for j, h in enumerate(hists):
        if h is None:
            continue
        below = h.cumsum(axis=0)
        left = below[:-1]
        right = below[-1] - left
        nl, nr = rows(left), rows(right)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = parent - nl / (nl + nr) * impurity(left, cls) - nr / (nl + nr) * impurity(right, cls)
        gain = np.where((nl >= rule["min_rows"]) & (nr >= rule["min_rows"]) & (gain >= rule["min_gain"]), gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > (best[0] if best else 0.0):
            best = (gain[k], j, k, left[k], right[k])
    return best[1:] if best else None


def walk(tree: dict, x: np.ndarray, by: str = "cut", columns: np.ndarray | None = None) -> np.ndarray:
    """Leaf of every row of ``x``; a value is compared with the node's ``by`` (a missing one goes right)."""
    n, width = x.shape
    flat, start = np.ascontiguousarray(x).ravel(), np.arange(0, n * width, width)
    left, right, feature = (np.asarray(tree[c]) for c in ("left", "right", "feature"))
    leaf = left < 0
    own = np.arange(len(left))
    child = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], 1).ravel() * 2       # twice the node
    column = np.repeat(np.where(leaf, 0, feature if columns is None else columns[np.maximum(feature, 0)]), 2)
    limit = np.repeat(np.asarray(tree[by]), 2)
    node, at, bound = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, limit.dtype)
    for _ in range(tree["depth"]):
        column.take(node, out=at, mode="clip")
        at += start
        limit.take(node, out=bound, mode="clip")
        node += flat.take(at, mode="clip") <= bound
        node = child.take(node, mode="clip")
    return node // 2


def grow(df: DataFrame, features: Sequence[str], labels: Sequence[str], rule: dict, folds: Sequence[int] | None = None,
         fold: str = "fold") -> dict[tuple[int | None, int], dict]:
    """A tree for every fold (grown on the rows of the others) and label, by (fold, place of the label); without
    ``folds`` on all rows, by (None, place).  Features and labels must be present and finite, as Spark's learner wants them."""
    cls, width = rule["cls"], len(features)
    xs, ys = [f"x{j}" for j in range(width)], [f"y{t}" for t in range(len(labels))]
    base = df.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, xs)],
                     *[F.col(f"`{c}`").cast("double").alias(y) for c, y in zip(labels, ys)],
                     (F.col(fold).cast("int") if folds is not None else F.lit(-1)).alias("f")).where(F.col("f").isNotNull())
    good = F.lit(True)
    for c in (*xs, *ys):
        good = good & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    if cls:
        good = good & (F.col("y0") >= 0) & (F.col("y0") == F.floor("y0"))
    seen = base.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~good, 1)).alias("bad"), F.max("y0").alias("top")).collect()
    parts = [None] if folds is None else list(folds)
    if sum(r["bad"] for r in seen):
        raise ValueError("a tree's features and labels must not be null, NaN or infinite; classes are 0, 1, 2, ...")
    n_rows = {f: sum(r["n"] for r in seen if r["f"] != f) for f in parts}
    if not min(n_rows.values()):
        raise ValueError("a tree needs training rows")
    classes = int(max(r["top"] for r in seen)) + 1 if cls else 0

    # cuts of every fold's features, from all rows or a sample of bounded size
    share = max(rule["bins"] ** 2, 10_000) / min(n_rows.values())
    sample = (base.sample(min(1.0, share), rule["seed"]) if share < 1 else base).select(*xs, "f").toPandas()
    at, values = sample["f"].to_numpy(), sample[xs].to_numpy(np.float64)
    columns: list[tuple[int, np.ndarray]] = []                       # features' cuts; folds with the same ones share a column
    place = {}
    for f in parts:
        for j in range(width):
            edge = cut_points(values[at != f if f is not None else slice(None), j], min(rule["bins"], n_rows[f]) - 1)
            same = [k for k, (i, e) in enumerate(columns) if i == j and np.array_equal(e, edge)]
            place[f, j] = same[0] if same else len(columns)
            columns += [] if same else [(j, edge)]
    del sample, at, values

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [pa.array(np.searchsorted(e, b.column(f"x{j}").to_numpy(zero_copy_only=False), side="left").astype(np.int32)) for j, e in columns]
            yield pa.RecordBatch.from_arrays([*codes, b.column("f"), *[b.column(y) for y in ys]], names=[*cs, "f", *ys])

    cs = [f"c{k}" for k in range(len(columns))]
    binned = write_stage(base.mapInArrow(to_bins, ", ".join([*[f"{c} int" for c in cs], "f int", *[f"{y} double" for y in ys]])))
    keys = [*cs, "f", *(["y0"] if cls else [])]
    n, distinct = binned.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if distinct <= FEWER * n:
        sums = [a for t, y in enumerate(ys) for a in (F.sum(y).alias(f"s{t}"), F.sum(F.col(y) * F.col(y)).alias(f"q{t}"))] if not cls else []
        spread = max(1, min(df.sparkSession.sparkContext.defaultParallelism, distinct // 10_000))
        rows = write_stage(binned.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums).repartition(spread))
    else:
        sums = [a for t, y in enumerate(ys) for a in (F.col(y).alias(f"s{t}"), (F.col(y) * F.col(y)).alias(f"q{t}"))] if not cls else []
        rows = binned.select(*keys, F.lit(1.0).alias("n"), *sums)
        # a pass returns histograms by task, so tasks follow the cores, not the files
        rows = rows.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)

    models = [(f, t) for f in parts for t in range(len(ys))]
    trees = {m: {"left": [-1], "right": [-1], "feature": [-1], "bin": [-1], "cut": [np.inf], "sums": [None], "depth": 0} for m in models}
    stats = classes if cls else 3
    cells = {f: sum(len(columns[place[f, j]][1]) + 1 for j in range(width)) * stats * 8 for f in parts}

    def partial(group: dict[tuple, list[int]]) -> DataFrame:
        place_ = {f: np.array([place[f, j] for j in range(width)]) for f in parts}
        wide = [len(e) + 1 for _, e in columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot = {}
            for m, nodes in group.items():
                slot[m] = np.full(len(trees[m]["left"]), -1)
                slot[m][nodes] = np.arange(len(nodes))
            hist = {m: [np.zeros((len(nodes) * wide[c], stats)) for c in place_[m[0]]] for m, nodes in group.items()}
            total = {m: np.zeros((len(nodes), stats)) for m, nodes in group.items()}

            def add(held: list[pa.RecordBatch]) -> None:
                t = pa.Table.from_batches(held)
                codes = np.column_stack([t[c].to_numpy() for c in cs])
                f, n_, y = t["f"].to_numpy(), t["n"].to_numpy(), t["y0"].to_numpy().astype(np.int64) if cls else None
                at_fold = {}
                for m, nodes in group.items():
                    if m[0] not in at_fold:
                        use = np.flatnonzero(f != m[0]) if m[0] is not None else np.arange(len(f))
                        at_fold[m[0]] = (use, codes[use])
                    use, mine = at_fold[m[0]]
                    s = slot[m][walk(trees[m], mine, "bin", place_[m[0]])]
                    if not (keep := s >= 0).all():
                        use, mine, s = use[keep], mine[keep], s[keep]
                    w = [n_[use]] if cls else [n_[use], t[f"s{m[1]}"].to_numpy()[use], t[f"q{m[1]}"].to_numpy()[use]]

                    def sums_by(i: np.ndarray, size: int, use: np.ndarray = use, w: list = w) -> np.ndarray:
                        if cls:
                            return np.bincount(i * stats + y[use], w[0], size * stats).reshape(size, stats)
                        return np.column_stack([np.bincount(i, v, size) for v in w])

                    total[m] += sums_by(s, len(nodes))
                    for j, c in enumerate(place_[m[0]]):
                        if wide[c] > 1:
                            hist[m][j] += sums_by(s * wide[c] + mine[:, c], len(nodes) * wide[c])

            held, many = [], 0
            for b in batches:
                held, many = [*held, b], many + b.num_rows
                if many >= AT_ONCE:
                    add(held)
                    held, many = [], 0
            if many:
                add(held)
            buckets: dict[int, dict] = {}
            for i, (m, nodes) in enumerate(group.items()):
                for k, node in enumerate(nodes):
                    if total[m][k].any():
                        own = [h.reshape(len(nodes), -1, stats)[k] if h.shape[0] > len(nodes) else None for h in hist[m]]
                        buckets.setdefault((i + node) % BUCKETS, {})[m, node] = (total[m][k], own)
            yield pa.record_batch([pa.array(list(buckets), pa.int32()), pa.array([pickle.dumps(v) for v in buckets.values()], pa.binary())],
                                  ["bucket", "payload"])
        return rows.mapInArrow(run, "bucket int, payload binary")

    def choose(_: int, payloads: list) -> dict:
        merged: dict = {}
        for p in payloads:
            for key, (s, own) in p.items():
                old = merged.get(key)
                merged[key] = (s, own) if old is None else (old[0] + s, [a if a is None else a + b for a, b in zip(old[1], own)])
        out = {}
        for (m, node), (s, own) in merged.items():
            known = trees[m]["sums"][node]
            out[m, node] = (s, best_cut(own, s if known is None else known, rule))
        return out

    active = {m: [0] for m in models}
    for depth in range(rule["depth"]):
        found: dict = {}
        group, held = {}, 0
        todo = [(m, node) for m, nodes in active.items() for node in nodes]
        for k, (m, node) in enumerate(todo):
            group.setdefault(m, []).append(node)
            held += cells[m[0]]
            if held >= GROUP_BYTES or k == len(todo) - 1:
                for part in _merge(partial(group), choose):
                    found |= part
                group, held = {}, 0
        active = {}
        for (m, node), (s, cut) in sorted(found.items(), key=lambda x: (models.index(x[0][0]), x[0][1])):
            t = trees[m]
            t["sums"][node] = s if t["sums"][node] is None else t["sums"][node]
            if cut is None:
                continue
            j, k, low, high = cut
            size = len(t["left"])
            t["left"][node], t["right"][node], t["feature"][node], t["bin"][node] = size, size + 1, j, k
            t["cut"][node], t["depth"] = float(columns[place[m[0], j]][1][k]), depth + 1
            for side, s_ in enumerate((low, high)):
                for c, v in (("left", -1), ("right", -1), ("feature", -1), ("bin", -1), ("cut", np.inf), ("sums", s_)):
                    t[c].append(v)
                if depth + 1 < rule["depth"] and abs(float(impurity(s_, cls))) >= _EPSILON:
                    active.setdefault(m, []).append(size + side)
        if not active:
            break
    if any(t["sums"][0] is None for t in trees.values()):             # max_depth 0: a leaf of all rows
        for part in _merge(partial({m: [0] for m in models}), choose):
            for (m, node), (s, _) in part.items():
                trees[m]["sums"][node] = s
    for t in trees.values():
        s = np.array(t.pop("sums"))
        t["value"] = s.argmax(axis=1).astype(np.float64) if cls else s[:, 1] / s[:, 0]
    return trees


class TreeModel:
    """One tree; ``transform`` adds its ``prediction`` to a table with a feature vector."""

    def __init__(self, tree: dict, features: str = "features") -> None:
        self.tree, self.features = tree, features

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.tree["value"])[walk(self.tree, x)]

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def prediction(v: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.vstack(v.to_numpy()))) if len(v) else pd.Series([], dtype="float64")
        return df.withColumn("prediction", prediction(vector_to_array(self.features)))


def predict_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str], trees: dict[tuple[int | None, int], dict],
                    row_id: str, folds: Sequence[int] | None, fold: str) -> DataFrame:
    """Every row's targets as its own fold's trees predict them, beside the true ones, in one pass without a join."""
    keep = [row_id, *([fold] if folds is not None else [])]
    base = df.where(F.col(f"`{row_id}`").isNotNull() & (F.col(fold).isin(list(folds)) if folds is not None else F.lit(True)))
    base = base.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(targets)],
                       *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    names = [*[f"k{i}" for i in range(len(keep))], *[c for i in range(len(targets)) for c in (f"p{i}", f"t{i}")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))])
            of = b.column("k1").to_numpy(zero_copy_only=False) if folds is not None else None
            out = {}
            for i in range(len(targets)):
                p = np.zeros(len(x))
                for f in folds if folds is not None else [None]:
                    rows = of == f if f is not None else np.ones(len(x), bool)
                    if rows.any():
                        p[rows] = np.asarray(trees[f, i]["value"])[walk(trees[f, i], x[rows])]
                out[f"p{i}"] = pa.array(p)
            yield pa.RecordBatch.from_arrays([out[c] if c in out else b.column(c) for c in names], names=names)

    called = dict(zip(names, [*keep, *[c for t in targets for c in (f"{t}_pred", f"{t}_true")]]))
    return base.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)).select(*[F.col(c).alias(called[c]) for c in names])
