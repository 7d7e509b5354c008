"""Kernel machines on landmark features, solved over Spark.

The RBF kernel is replaced by its Nystroem features: kernel values with ``LANDMARKS`` training rows times the
inverse root of the landmarks' own kernel matrix.  On them the primal problem

    |w|^2 / 2 + C * sum of losses,   loss = max(0, |y - f| - EPSILON)  or  max(0, 1 - y f)

is solved by Newton steps on the loss with its corner rounded over a width that shrinks round by round: a job
sums loss, gradient and curvature of all models (one per fold, and per class of a classification, one against
the rest) at several step lengths in one look at the rows; the driver solves systems of ``LANDMARKS + 1``
unknowns and takes the step that descends most.  The rounded loss's slopes are a feasible point of the dual problem, whose distance from
the primal value (``gap``) bounds the error of the solution.

Scaling and landmarks come from the rows that train a model alone; missing values count as the mean.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.operators.trees import _arrays, _predict, _trains, training_rows
from flankwear.session import write_stage

C, EPSILON = 10.0, 0.1
LANDMARKS = 100
WIDTHS = (4.0, 1.0, 0.3, 0.1, 0.03, 0.01)   # of the rounded corner
STEPS = 25                            # Newton steps per width, at most
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)   # parts of a Newton step that are tried together


class Features:
    """Scaling, landmarks and root matrix of one fold's model."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, marks: np.ndarray) -> None:
        self.mean, self.scale = mean, np.where(scale > 0, scale, 1.0)
        self.gamma = 1.0 / max(1, len(mean))
        self.marks = self.scaled(marks)
        values, vectors = np.linalg.eigh(self.kernel(self.marks))
        good = values > 1e-8
        self.root = vectors[:, good] / np.sqrt(values[good])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.where(np.isnan(z), 0.0, z)

    def kernel(self, z: np.ndarray) -> np.ndarray:
        d = (z * z).sum(1)[:, None] + (self.marks * self.marks).sum(1)[None, :] - 2 * z @ self.marks.T
        return np.exp(-self.gamma * np.maximum(d, 0.0))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Features of raw rows; the last one is the constant."""
        return np.column_stack([self.kernel(self.scaled(x)) @ self.root, np.ones(len(x))])


def features_of_folds(rows: DataFrame, folds: Sequence[int], landmarks: int = LANDMARKS) -> dict[int, Features]:
    """One aggregation per fold group for the scaling; ``landmarks`` rows in hash order per model reach the driver."""
    train = rows.where("weight > 0")
    x = train.select("fold", "only", F.posexplode("vec").alias("j", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    sums = x.groupBy("fold", "only", "j").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()
    out = {}
    width = len(rows.select("vec").first()[0])
    for f in folds:
        mine = F.when(F.col("only").isNull(), F.col("fold") != f).otherwise(F.col("only") == f)
        picked = train.where(mine).orderBy(F.xxhash64("row_id", F.lit(f)), "row_id").limit(landmarks).select("vec").collect()
        mean, scale = np.zeros(width), np.ones(width)
        for j in range(width):
            own = [r for r in sums if r["j"] == j and (r["only"] == f if r["only"] is not None else r["fold"] != f)]
            if n := sum(r["n"] for r in own):
                mean[j] = sum(r["n"] * r["m"] for r in own) / n
                scale[j] = np.sqrt(sum(r["n"] * (r["v"] + (r["m"] - mean[j]) ** 2) for r in own) / n)
        marks = np.array([[np.nan if v is None else v for v in r["vec"]] for r in picked], dtype=np.float64).reshape(-1, width)
        out[f] = Features(mean, scale, marks)
    return out


def _slopes(margin: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounded max(0, margin): value, slope and curvature."""
    slope = np.clip(margin / width, 0.0, 1.0)
    return slope * margin - width * slope * slope / 2, slope, ((margin > 0) & (margin < width)) / width


class Machine:
    """Weights by (fold, class); class None for a regression, and 1 alone for two classes."""

    def __init__(self, features: dict[int, Features], classes: int | None) -> None:
        self.features, self.classes = features, classes
        kinds = [None] if not classes else [1] if classes == 2 else list(range(classes))
        self.w = {(f, k): np.zeros(features[f].root.shape[1] + 1) for f in features for k in kinds}
        self.gap: dict[tuple, float] = {}

    def scores(self, f: int, x: np.ndarray) -> np.ndarray:
        z = self.features[f].of(x)
        s = np.column_stack([z @ w for (g, _), w in self.w.items() if g == f])
        return np.hstack([-s, s]) if self.classes == 2 else s


def losses(z: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray, kind: int | None, width: float, c: float, epsilon: float) -> tuple:
    """Sums over rows: rounded loss, gradient, curvature, exact loss, and the linear part of the dual value."""
    s = z @ w
    if kind is None:
        r = s - y
        value, slope, curve = _slopes(np.abs(r) - epsilon, width)
        sign, exact = np.sign(r), np.maximum(0.0, np.abs(r) - epsilon)
        linear = -(slope * weight * (sign * y + epsilon)).sum() * c
    else:
        t = np.where(y == kind, 1.0, -1.0)
        value, slope, curve = _slopes(1 - t * s, width)
        sign, exact = -t, np.maximum(0.0, 1 - t * s)
        linear = (slope * weight).sum() * c
    g = z.T @ (slope * sign * weight) * c
    h = (z * (curve * weight)[:, None]).T @ z * c
    return (value * weight).sum() * c, g, h, (exact * weight).sum() * c, linear


def total_of(w: np.ndarray, sums: tuple) -> dict:
    """Value, gradient and curvature of the whole problem from the rows' sums, and both sides of the duality gap."""
    value, g, h, exact, linear = sums
    w = np.append(w[:-1], 0.0)                                # the constant is free
    return {"value": value + w @ w / 2, "g": g + w, "h": h + np.diag([*np.ones(len(w) - 1), 0.0]), "primal": exact + w @ w / 2,
            "dual": linear - (g[:-1] @ g[:-1]) / 2}


def solve(evaluate: Callable[[dict, float], dict], w: dict, c: float) -> dict:
    """Newton steps on all models until their gradients vanish, for every width; ``w`` is changed, the last sums are
    returned.  ``evaluate`` takes points by (model, place) and gives their sums."""
    at: dict = {}
    for width in WIDTHS:
        at = {m: v for (m, _), v in evaluate({(m, 0): x for m, x in w.items()}, width).items()}
        todo = set(w)
        for _ in range(STEPS):
            todo = {m for m in todo if np.abs(at[m]["g"]).max() > 1e-5 * c}
            if not todo:
                break
            move = {m: np.linalg.solve(at[m]["h"] + 1e-9 * np.eye(len(at[m]["g"])), -at[m]["g"]) for m in todo}
            trial = {(m, k): w[m] + t * move[m] for m in todo for k, t in enumerate(LENGTHS)}
            new = evaluate(trial, width)
            for m in list(todo):
                k = min(range(len(LENGTHS)), key=lambda k: new[m, k]["value"])
                if new[m, k]["value"] < at[m]["value"]:
                    w[m], at[m] = trial[m, k], new[m, k]
                else:
                    todo.discard(m)
    return at


def fit(rows: DataFrame, folds: Sequence[int], classes: int | None, c: float = C, epsilon: float = EPSILON,
        landmarks: int = LANDMARKS) -> Machine:
    """Machines of all folds; every job evaluates every model that has not settled yet."""
    machine = Machine(features_of_folds(rows, folds, landmarks), classes)
    train = rows.where("weight > 0")

    def evaluate(points: dict, width: float) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, weight, fold, only = _arrays(b)
                for f in {m[0][0] for m in points}:
                    use = _trains(fold, only, f)
                    z = machine.features[f].of(x[use])
                    for m in points:
                        if m[0][0] == f:
                            new = losses(z, points[m], y[use], weight[use], m[0][1], width, c, epsilon)
                            total[m] = new if m not in total else tuple(u + v for u, v in zip(total[m], new))
            yield pa.record_batch([pa.array([pickle.dumps(m) for m in total], pa.binary()), pa.array([pickle.dumps(v) for v in total.values()], pa.binary())],
                                  ["m", "sums"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            parts = [pickle.loads(s) for s in pdf["sums"]]
            return pd.DataFrame({"m": [key[0]], "sums": [pickle.dumps(tuple(sum(p[1:], start=p[0]) for p in zip(*parts)))]})

        sums = train.mapInArrow(run, "m binary, sums binary").groupBy("m").applyInPandas(add, "m binary, sums binary").collect()
        return {(m := pickle.loads(r["m"])): total_of(points[m], pickle.loads(r["sums"])) for r in sums}

    at = solve(evaluate, machine.w, c)
    machine.gap = {m: (v["primal"] - v["dual"]) / max(1e-12, abs(v["primal"])) for m, v in at.items()}
    return machine


def oof(df: DataFrame, folds: Sequence[int], classes: int | None, weight: str | None = None, train: dict[int, DataFrame] | None = None,
        row_id: str = "row_id", label: str = "label", name: str = "svm", landmarks: int = LANDMARKS) -> DataFrame:
    """Out-of-fold rows of the kernel machine: class of the largest score (ties to the smaller), or the value."""
    rows = training_rows(df, label=label, row_id=row_id, weight=weight, train=train)
    machine = fit(rows, folds, classes, landmarks=landmarks)
    return write_stage(_predict(rows, list(folds), machine.scores, classes, name))
