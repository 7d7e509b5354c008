"""Tree learners that Spark's library lacks, grown for all folds at once.

Every learner here trains the models of all folds in lockstep: a job's tasks look at their rows once and add
them to the statistics of every fold's model but the row's own, so an out-of-fold run costs as many jobs as
one fit.  A task returns one partial sum per model (or bucket of trees); sums are merged, and splits chosen,
in Spark tasks; only splits reach the driver, which holds the trees (bounded by ``max_leaves``, or by
``max_depth`` and the rows, times the number of trees).

* ``extra_trees``: level-wise growth of all trees; one random cut between a node's extremes per drawn
  feature; two aggregations per level (extremes, then sums left of the cuts).
* ``boost``: gradient boosting over histograms of ``BINS`` bins and one for missing values.  A node's
  missing values go to the side that gains more.  Depth-wise growth (M05, M06), or best-first growth to
  ``max_leaves`` (M07): the queue is replayed after every round and the children it is about to open are
  evaluated together; of two siblings the smaller one is counted and the other is the parent's histogram
  less it.  A classification has one tree per class and round, coupled by the softmax of all classes' scores.

Rows: row_id, fold, label, vec (array of doubles, NULL or NaN where missing), and optionally a weight and
``only`` (a row that trains the model of that fold alone, e.g. a synthetic one).
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.session import write_stage

BINS, MISSING = 254, 255
SEED = 42
BUCKETS = 16                  # groups of trees whose sums are merged in one task
RESTAGE = 10                  # boosting rounds after which the scores are written


def training_rows(df: DataFrame, label: str = "label", vec: str = "vec", row_id: str = "row_id", fold: str = "fold",
                  weight: str | None = None, train: dict[int, DataFrame] | None = None) -> DataFrame:
    """The learners' rows, written once.  With ``train`` (training rows by fold) the rows of ``df`` only test."""
    def cols(d: DataFrame, f, only, w) -> DataFrame:
        return d.select(F.col(row_id).alias("row_id"), f.cast("int").alias("fold"), F.col(label).cast("double").alias("label"),
                        F.col(vec).cast("array<double>").alias("vec"), w.cast("double").alias("weight"), only.cast("int").alias("only"))

    none, one = F.lit(None), F.col(weight) if weight else F.lit(1.0)
    rows = cols(df, F.col(fold), none, one if not train else F.lit(0.0))
    for f, d in (train or {}).items():
        rows = rows.unionByName(cols(d, none, F.lit(f), one))
    return write_stage(rows)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    num = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    vec = b.column("vec")
    lengths = np.unique(pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False))
    if vec.null_count or len(lengths) != 1:
        raise ValueError("the rows' feature vectors must be present and of one length")
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)       # missing values as NaN
    return x, num("label"), num("weight"), num("fold"), num("only")


def _trains(fold: np.ndarray, only: np.ndarray, m: int) -> np.ndarray:
    """Whether each row trains model ``m``."""
    return np.where(np.isnan(only), fold != m, only == m)


def _merge(parts: DataFrame, of: Callable[[int, list], object]) -> list:
    """``of(bucket, all tasks' payloads of the bucket)`` of every bucket, collected; payloads are pickled."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"out": [pickle.dumps(of(int(key[0]), [pickle.loads(p) for p in pdf["payload"]]))]})
    return [pickle.loads(r["out"]) for r in parts.groupBy("bucket").applyInPandas(run, "out binary").collect()]


# ------------------------------------------------------------------ M04
def route(tree: dict, x: np.ndarray) -> np.ndarray:
    """Leaf of every row in a tree of cuts; missing values go right."""
    node = np.zeros(len(x), np.int64)
    left, right, feature, cut = (np.asarray(tree[c]) for c in ("left", "right", "feature", "cut"))
    while (inner := left[node] >= 0).any():
        go = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
        node = np.where(inner, np.where(go, left[node], right[node]), node)
    return node


def split_score(left: np.ndarray, total: np.ndarray, classes: int | None) -> np.ndarray:
    """Decrease of impurity times rows (Gini, or squared error) for sums left of cuts against the node's sums."""
    right = total - left
    if classes:
        inner = lambda s: (s * s).sum(-1) / np.maximum(s.sum(-1), 1e-300)
        empty = (left.sum(-1) <= 0) | (right.sum(-1) <= 0)
    else:
        inner = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
        empty = (left[..., 0] <= 0) | (right[..., 0] <= 0)
    return np.where(empty, -np.inf, inner(left) + inner(right) - inner(total))


def node_cuts(seed: int, tree: int, node: int, lo: np.ndarray, hi: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn features of a node (varying ones only) and a uniform cut between each one's extremes."""
    rng = np.random.default_rng([seed, tree, node])
    varying = np.flatnonzero(hi > lo)
    chosen = np.sort(rng.permutation(varying)[:n_features])
    cuts = lo[chosen] + rng.random(len(chosen)) * (hi[chosen] - lo[chosen])
    return chosen, np.where(cuts >= hi[chosen], lo[chosen], cuts)


def merge_nodes(parts: Sequence[tuple[np.ndarray, ...]], how: Sequence[np.ufunc]) -> tuple[np.ndarray, ...]:
    """Values by node (its number first, then arrays with a row per node) of several parts, joined by ``how``: one row per node."""
    ids = np.concatenate([p[0] for p in parts])
    order = np.argsort(ids, kind="stable")
    ids, start = np.unique(ids[order], return_index=True)
    return ids, *[u.reduceat(np.concatenate([p[i + 1] for p in parts])[order], start, axis=0) for i, u in enumerate(how)]


def extra_trees(rows: DataFrame, folds: Sequence[int], classes: int | None, n_trees: int = 300, max_depth: int = 30,
                seed: int = SEED) -> dict[tuple[int, int], dict]:
    """Trees by (fold, number), grown on the rows of the other folds (all rows, no bootstrap).  A classification
    (``classes``) draws the square root of the number of features per node, a regression all of them."""
    width = len(rows.select("vec").first()[0])
    drawn = max(1, math.isqrt(width)) if classes else width
    keys = [(f, t) for f in folds for t in range(n_trees)]
    trees = {k: {"left": [-1], "right": [-1], "feature": [-1], "cut": [0.0], "value": [None]} for k in keys}
    active = {k: [0] for k in keys}

    def sums(y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if classes:
            return np.eye(classes)[y.astype(int)] * w[:, None]
        return np.column_stack([w, w * y, w * y * y])

    def partial(of: Callable, how: Sequence[np.ufunc]) -> DataFrame:
        grown = {k: {c: np.asarray(trees[k][c]) for c in ("left", "right", "feature", "cut")} for k in active}
        nodes = {k: np.array(v) for k, v in active.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, w, fold, only = _arrays(b)
                s = sums(y, w)
                for f in folds:
                    use = np.flatnonzero(_trains(fold, only, f) & (w > 0))
                    mine = x[use]
                    for t in range(n_trees):
                        if (f, t) not in nodes:
                            continue
                        # rows in the order of their nodes, so that every node's are added up at once
                        at = route(grown[f, t], mine)
                        asked = np.zeros(len(grown[f, t]["left"]), bool)
                        asked[nodes[f, t]] = True
                        rows_ = np.flatnonzero(asked[at])
                        if len(rows_):
                            rows_ = rows_[np.argsort(at[rows_], kind="stable")]
                            ids, start = np.unique(at[rows_], return_index=True)
                            total.setdefault((f, t), []).append((ids, *of((f, t), ids, start, at[rows_], mine[rows_], s[use[rows_]])))
            buckets: dict[int, dict] = {}
            for k, v in total.items():
                buckets.setdefault((k[0] * n_trees + k[1]) % BUCKETS, {})[k] = merge_nodes(v, how)
            yield pa.record_batch([pa.array(list(buckets), pa.int32()), pa.array([pickle.dumps(v) for v in buckets.values()], pa.binary())],
                                  ["bucket", "payload"])
        return rows.mapInArrow(run, "bucket int, payload binary")

    def together(parts: list, how: Sequence[np.ufunc]) -> dict:
        """Every tree's values by node, of all tasks."""
        of_tree: dict = {}
        for p in parts:
            for key, v in p.items():
                of_tree.setdefault(key, []).append(v)
        return {key: merge_nodes(v, how) for key, v in of_tree.items()}

    ends = (np.minimum, np.maximum, np.add)

    def extremes(key: tuple, ids: np.ndarray, start: np.ndarray, at: np.ndarray, x: np.ndarray, s: np.ndarray) -> tuple:
        gap = np.isnan(x)
        return (np.minimum.reduceat(np.where(gap, np.inf, x), start, axis=0), np.maximum.reduceat(np.where(gap, -np.inf, x), start, axis=0),
                np.add.reduceat(s, start, axis=0))

    def choose_cuts(_: int, parts: list) -> dict:
        return {k: {int(n): (*node_cuts(seed, k[0] * n_trees + k[1], int(n), lo, hi, drawn), s) for n, lo, hi, s in zip(*v)}
                for k, v in together(parts, ends).items()}

    for depth in range(max_depth + 1):
        found: dict = {}
        for part in _merge(partial(extremes, ends), choose_cuts):
            found |= part
        for k, nodes in found.items():
            for n, (_, _, s) in nodes.items():
                trees[k]["value"][n] = s / s.sum() if classes else np.array([s[1] / s[0]])
        pure = lambda s: (s.max() >= s.sum()) if classes else (s[0] * s[2] - s[1] ** 2 <= 1e-12 * s[0] * s[2])
        cuts = {k: {n: v for n, v in nodes.items() if len(v[0]) and not pure(v[2])} for k, nodes in found.items()}
        active = {k: list(v) for k, v in cuts.items() if v}
        if depth == max_depth or not active:
            break

        # a node's cuts in a row of a table; those it lacks part nothing
        tables = {}
        for k, nodes in cuts.items():
            at_, feature_, cut_ = np.full(len(trees[k]["left"]), -1), np.zeros((len(nodes), drawn), np.int64), np.full((len(nodes), drawn), -np.inf)
            for i, (n, (features, cut, _)) in enumerate(nodes.items()):
                at_[n], feature_[i, :len(features)], cut_[i, :len(features)] = i, features, cut
            tables[k] = (at_, feature_, cut_)

        def left_sums(key: tuple, ids: np.ndarray, start: np.ndarray, at: np.ndarray, x: np.ndarray, s: np.ndarray, tables: dict = tables) -> tuple:
            place, feature_, cut_ = tables[key]
            go = x[np.arange(len(x))[:, None], feature_[place[at]]] <= cut_[place[at]]
            return (np.stack([np.add.reduceat(go * s[:, c:c + 1], start, axis=0) for c in range(s.shape[1])], -1),)

        def choose(_: int, parts: list, cuts: dict = cuts) -> dict:
            out: dict = {}
            for key, (ids, sums_) in together(parts, (np.add,)).items():
                for n, left in zip(ids.tolist(), sums_):
                    features, cut, s = cuts[key][n]
                    score = split_score(left[:len(features)], s, classes)
                    if np.isfinite(top := score.max()):
                        # cuts that part the rows alike tie whatever the order of summation; the first one counts
                        j = int((score >= top - 1e-9 * max(1.0, abs(top))).argmax())
                        out.setdefault(key, {})[n] = (int(features[j]), float(cut[j]))
            return out

        active, chosen = {k: v for k, v in active.items()}, _merge(partial(left_sums, (np.add,)), choose)
        active = {}
        for part in chosen:
            for k, nodes in part.items():
                t = trees[k]
                for n, (feature, cut) in sorted(nodes.items()):
                    size = len(t["left"])
                    t["feature"][n], t["cut"][n], t["left"][n], t["right"][n] = feature, cut, size, size + 1
                    for c, v in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0.0), ("value", t["value"][n])):
                        t[c] += [v, v]
                    active.setdefault(k, []).extend([size, size + 1])
        if not active:
            break
    return trees


def predict_extra_trees(trees: dict[tuple[int, int], dict], rows: DataFrame, classes: int | None, model: str = "extra_trees") -> DataFrame:
    """Out-of-fold predictions: the mean of the trees of a row's own fold (class shares: the largest, ties to the smaller)."""
    by_fold: dict[int, list[dict]] = {}
    for (f, _), t in trees.items():
        by_fold.setdefault(f, []).append(t)

    def score(f: int, x: np.ndarray) -> np.ndarray:
        out = 0.0
        for t in by_fold[f]:
            out = out + np.stack(t["value"])[route(t, x)]
        return out / len(by_fold[f])

    return _predict(rows, sorted(by_fold), score, classes, model)


def _predict(rows: DataFrame, folds: Sequence[int], score: Callable[[int, np.ndarray], np.ndarray], classes: int | None, model: str) -> DataFrame:
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, _, _, fold, _ = _arrays(b)
            out = np.zeros(b.num_rows)
            shares = np.zeros((b.num_rows, classes or 0))
            for f in folds:
                if (m := fold == f).any():
                    s = score(f, x[m])
                    out[m] = s.argmax(axis=1) if classes else s[:, 0]
                    if classes:
                        shares[m] = s
            yield pa.record_batch([b.column("row_id"), b.column("fold"), b.column("label"), pa.array(out), pa.array(list(shares), pa.list_(pa.float64()))],
                                  ["row_id", "fold", "y_true", "y_pred", "shares"])

    tests = rows.where(F.col("only").isNull() & F.col("fold").isin(list(folds)))
    out = tests.mapInArrow(run, f"row_id {kind}, fold int, y_true double, y_pred double, shares array<double>")
    return out.select(F.lit(model).alias("model"), "row_id", "fold", "y_true", "y_pred", "shares")


# ------------------------------------------------------------------ M05, M06, M07
def bin_edges(rows: DataFrame) -> list[np.ndarray]:
    """Upper edges of the bins of every feature: up to ``BINS - 1`` distinct quantiles of its present values."""
    probs = [k / BINS for k in range(1, BINS)]
    x = rows.where("weight > 0").select(F.posexplode("vec").alias("j", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = {r["j"]: r["q"] for r in x.groupBy("j").agg(F.percentile_approx("x", probs, 10_000).alias("q")).collect()}
    return [np.unique(found.get(j, [])) for j in range(len(rows.select("vec").first()[0]))]


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], side="left"))
    return out


def route_bins(tree: dict, bins: np.ndarray) -> np.ndarray:
    """Node of every row in a tree over bins; a node's missing values go where its split says."""
    node = np.zeros(len(bins), np.int64)
    left, right, feature, cut, low = (np.asarray(tree[c]) for c in ("left", "right", "feature", "cut", "missing_left"))
    while (inner := left[node] >= 0).any():
        b = bins[np.arange(len(bins)), np.maximum(feature[node], 0)]
        go = np.where(b == MISSING, low[node], b <= cut[node])
        node = np.where(inner, np.where(go, left[node], right[node]), node)
    return node


def histogram_of(bins: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Sums of ``stats`` (rows x 3) by feature and bin: features x 256 x 3."""
    n, width = bins.shape
    at = (bins.astype(np.int64) + 256 * np.arange(width)).ravel()
    return np.stack([np.bincount(at, np.repeat(stats[:, c], width), minlength=256 * width) for c in range(3)], -1).reshape(width, 256, 3)


def best_split(hist: np.ndarray, min_rows: float, min_hessian: float, newton: bool, ridge: float = 0.0) -> dict | None:
    """Split of largest gain of a histogram (rows, gradients, hessians), or None.  Both sides are tried for missing
    values; ties go to the first feature, missing values right, the lowest cut."""
    total = hist[0].sum(axis=0)
    below = hist[:, :MISSING].cumsum(axis=1)                                  # features, cut, 3
    gap = hist[:, MISSING][:, None, :]
    left = np.stack([below, below + gap], axis=1)                             # features, missing right or left, cut, 3
    right = total - left
    value = lambda s: s[..., 1] ** 2 / np.maximum((s[..., 2] if newton else s[..., 0]) + ridge, 1e-300)
    gain = value(left) + value(right) - value(total)
    ok = (np.minimum(left[..., 0], right[..., 0]) >= max(min_rows, 1e-9)) & (np.minimum(left[..., 2], right[..., 2]) >= min_hessian)
    gain = np.where(ok, gain, -np.inf)
    k = int(gain.argmax())
    j, side, cut = np.unravel_index(k, gain.shape)
    if not gain[j, side, cut] > 1e-12:
        return None
    a, b = left[j, side, cut], right[j, side, cut]
    low = bool(side) if gap[j, 0, 0] > 0 else bool(a[0] >= b[0])              # none missing here: with the larger side
    return {"gain": float(gain[j, side, cut]), "feature": int(j), "cut": int(cut), "missing_left": low, "left": a, "right": b}


class Boosted:
    """Trees of all folds' models: ``trees[fold][round][class]``, with the bins' edges and the first scores."""

    def __init__(self, edges: list[np.ndarray], start: dict[int, np.ndarray], rate: float, classes: int | None) -> None:
        self.edges, self.start, self.rate, self.classes = edges, start, rate, classes
        self.trees: dict[int, list[list[dict]]] = {f: [] for f in start}

    def raw(self, fold: int, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.start[fold]))) + (self.start[fold] if not since else 0)
        for group in self.trees[fold][since:]:
            for k, t in enumerate(group):
                out[:, k] += self.rate * np.asarray(t["value"])[route_bins(t, bins)]
        return out

    def shares(self, raw: np.ndarray) -> np.ndarray:
        if not self.classes:
            return raw
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw))
            return np.hstack([1 - p, p])
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def replay(known: dict, max_leaves: int | None, max_depth: int | None) -> tuple[list[int], list[int]]:
    """Opened nodes in queue order, and those among them whose children are not evaluated yet.  ``known`` maps an
    evaluated node to its best split (or None) with its depth and children."""
    leaves, opened, pending = 1, [], []
    queue = [0]
    while queue and (max_leaves is None or leaves < max_leaves):
        queue = [n for n in queue if n in known and known[n]["split"] and (max_depth is None or known[n]["depth"] < max_depth)]
        if not queue:
            break
        n = max(queue, key=lambda n: (known[n]["split"]["gain"], -n))
        queue.remove(n)
        opened.append(n)
        leaves += 1
        if known[n]["children"] is None:
            pending.append(n)
        else:
            queue += known[n]["children"]
    return opened, pending


def boost(rows: DataFrame, folds: Sequence[int], classes: int | None, n_iter: int = 200, rate: float = 0.1, max_leaves: int | None = 31,
          max_depth: int | None = None, min_rows: float = 20, newton: bool = True) -> Boosted:
    """Gradient boosting of the models of all folds.  ``newton`` gains use hessians (M07); without it splits use the
    gradients' squared error and only leaf values use hessians (M05, M06).  Two classes share one score."""
    folds = list(folds)
    scores = 1 if not classes or classes == 2 else classes
    model = Boosted(bin_edges(rows), _first_scores(rows, folds, classes), rate, classes)
    names = [(f, k) for f in folds for k in range(scores)]
    parts = "row_id long, fold int, only int, label double, weight double, bins binary, raw binary"

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, *_ = _arrays(b)
            bins = to_bins(x, model.edges)
            raw = np.stack([model.raw(f, bins) for f in folds], axis=1)
            yield pa.record_batch([pa.array(np.zeros(b.num_rows, np.int64)), b.column("fold"), b.column("only"), b.column("label"), b.column("weight"),
                                   pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary())],
                                  ["row_id", "fold", "only", "label", "weight", "bins", "raw"])

    base = write_stage(rows.where("weight > 0").mapInArrow(binned, parts))
    written = 0

    def unpack(b: pa.RecordBatch) -> tuple:
        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        raw = np.frombuffer(b"".join(b.column("raw").to_pylist())).reshape(b.num_rows, len(folds), scores)
        num = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
        return bins, raw, num("label"), num("weight"), num("fold"), num("only")

    def gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """Weight, gradient and hessian of the loss by score ``k``."""
        if not classes:
            return np.column_stack([w, w * (raw[:, 0] - y), w])
        p = model.shares(raw)[:, 1 if scores == 1 else k]
        return np.column_stack([w, w * (p - (y == (1 if scores == 1 else k))), w * p * (1 - p)])

    for it in range(n_iter):
        trees = {m: {"left": [-1], "right": [-1], "feature": [-1], "cut": [0], "missing_left": [False], "value": [0.0]} for m in names}
        known: dict = {m: {} for m in names}
        wanted = {m: [(None, 0)] for m in names}                              # (parent, node to count)
        hists: DataFrame | None = None
        while any(wanted.values()):
            hists = _evaluate(base, hists, unpack, gradients, model, written, folds, names, trees, wanted, min_rows, newton)
            for r in hists.select("m", "node", "split").collect():
                split = pickle.loads(r["split"])
                m = names[r["m"]]
                entry = known[m].setdefault(r["node"], {"depth": 0, "children": None})
                entry["split"], entry["total"] = split["best"], split["total"]
            wanted = {}
            for m in names:
                _, pending = replay(known[m], max_leaves, max_depth)
                t = trees[m]
                wanted[m] = []
                for n in pending:
                    s, size = known[m][n]["split"], len(t["left"])
                    t["feature"][n], t["cut"][n], t["missing_left"][n], t["left"][n], t["right"][n] = s["feature"], s["cut"], s["missing_left"], size, size + 1
                    for c, v in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0), ("missing_left", False), ("value", 0.0)):
                        t[c] += [v, v]
                    depth = known[m][n]["depth"] + 1
                    known[m][n]["children"] = [size, size + 1]
                    for c, total in ((size, s["left"]), (size + 1, s["right"])):
                        known[m][c] = {"depth": depth, "children": None, "split": None, "total": total}
                    if max_depth is None or depth < max_depth:
                        wanted[m].append((n, size if s["left"][0] <= s["right"][0] else size + 1))
        for f in folds:
            model.trees[f].append([_closed(trees[f, k], known[f, k], replay(known[f, k], max_leaves, max_depth)[0], classes, scores, newton)
                                   for k in range(scores)])
        if (it + 1) % RESTAGE == 0 and it + 1 < n_iter:
            def rescored(batches: Iterator[pa.RecordBatch], since: int = written) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        bins, raw, *_ = unpack(b)
                        new = raw + np.stack([_more(model, f, bins, since) for f in folds], axis=1)
                        yield b.set_column(b.schema.get_field_index("raw"), "raw", pa.array([r.tobytes() for r in new], pa.binary()))
            base, written = write_stage(base.mapInArrow(rescored, parts)), it + 1
    return model


def _more(model: Boosted, fold: int, bins: np.ndarray, since: int) -> np.ndarray:
    """Scores by the trees after the first ``since`` rounds, without the first scores."""
    return model.raw(fold, bins, since) - (model.start[fold] if not since else 0)


def _first_scores(rows: DataFrame, folds: list[int], classes: int | None) -> dict[int, np.ndarray]:
    """Per fold the mean label, the log odds, or the classes' log shares of the rows that train its model."""
    sums = rows.where("weight > 0").groupBy("fold", "only", "label" if classes else F.lit(0.0).alias("label")).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("s")).collect()
    out = {}
    for f in folds:
        mine = [r for r in sums if (r["only"] == f if r["only"] is not None else r["fold"] != f)]
        w = sum(r["w"] for r in mine) or 1.0
        if not classes:
            out[f] = np.array([sum(r["s"] for r in mine) / w])
            continue
        p = np.array([max(1e-9, sum(r["w"] for r in mine if int(r["label"]) == k) / w) for k in range(classes)])
        out[f] = np.array([np.log(p[1] / p[0])]) if classes == 2 else np.log(p)
    return out


def _evaluate(base, hists, unpack, gradients, model, written, folds, names, trees, wanted, min_rows, newton) -> DataFrame:
    """Histograms and best splits of the children the queues ask for: the wanted child is counted over the rows, its
    sibling is the parent's histogram less it.  A written table: m (place in ``names``), node, hist, split."""
    width = len(model.edges)
    ask = {names.index(m): v for m, v in wanted.items() if v}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            bins, raw, y, w, fold, only = unpack(b)
            for i, f in enumerate(folds):
                mine = [m for m in ask if names[m][0] == f]
                use = _trains(fold, only, f)
                if not mine or not use.any():
                    continue
                now = raw[use, i] + _more(model, f, bins[use], written)
                for m in mine:
                    stats = gradients(now, y[use], w[use], names[m][1])
                    at = route_bins(trees[names[m]], bins[use])
                    for parent, node in ask[m]:
                        inside = at == node
                        if inside.any():
                            h = histogram_of(bins[use][inside], stats[inside])
                            total[m, parent, node] = total.get((m, parent, node), 0) + h
        keys = list(total)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([-1 if k[1] is None else k[1] for k in keys], pa.int32()),
                               pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())],
                              ["m", "parent", "node", "hist"])

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, parent = int(key[0]), int(key[1])
        child = dict(ask[m] if parent >= 0 else [(-1, 0)])[parent]
        shape = (width, 256, 3)
        counted = np.zeros(shape)
        for raw in pdf["hist"][pdf["node"] >= 0]:
            counted = counted + np.frombuffer(raw).reshape(shape)
        found = {child: counted}
        if parent >= 0:
            whole = np.frombuffer(pdf["hist"][pdf["node"] < 0].iloc[0]).reshape(shape)
            left = trees[names[m]]["left"][parent]
            found[left + 1 if child == left else left] = np.where(np.abs(whole - counted) < 1e-12 * np.abs(whole), 0.0, whole - counted)
        out = [(m, n, h.tobytes(), pickle.dumps({"best": best_split(h, min_rows, 1e-3 if newton else 0.0, newton), "total": h[0].sum(axis=0)}))
               for n, h in found.items()]
        return pd.DataFrame(out, columns=["m", "node", "hist", "split"])

    partial = base.mapInArrow(count, "m int, parent int, node int, hist binary")
    if hists is not None:      # the parents' histograms, from the tables of earlier rounds
        parents = base.sparkSession.createDataFrame([(m, p) for m, v in ask.items() for p, _ in v], "m int, parent int")
        partial = partial.unionByName(hists.withColumnRenamed("node", "parent").join(F.broadcast(parents), ["m", "parent"])
                                      .select("m", "parent", F.lit(-1).alias("node"), "hist"))
    new = partial.groupBy("m", "parent").applyInPandas(choose, "m int, node int, hist binary, split binary")
    return write_stage(new if hists is None else new.unionByName(hists.join(F.broadcast(parents.withColumnRenamed("parent", "node")), ["m", "node"], "left_anti")))


def _closed(tree: dict, known: dict, opened: list[int], classes: int | None, scores: int, newton: bool) -> dict:
    """The tree with nodes that the queue did not open as leaves, and the leaves' Newton steps."""
    done = set(opened)
    t = {c: list(v) for c, v in tree.items()}
    for n in range(len(t["left"])):
        if n not in done:
            t["left"][n] = t["right"][n] = -1
        total = known[n]["total"] if n in known else np.zeros(3)
        step = -total[1] / total[2] if total[2] > 1e-12 else 0.0
        t["value"][n] = float(step * ((scores - 1) / scores if scores > 1 and not newton else 1.0))
    t["gain"] = [known[n]["split"]["gain"] if n in done else 0.0 for n in range(len(t["left"]))]
    return t


def predict_boosted(model: Boosted, rows: DataFrame, name: str) -> DataFrame:
    """Out-of-fold predictions of a boosted model, with the classes' probabilities."""
    return _predict(rows, sorted(model.trees), lambda f, x: model.shares(model.raw(f, to_bins(x, model.edges))), model.classes, name)


#: Parameters of the benchmark's boosted learners.
GRID = {
    "gradient_boosting": dict(n_iter=200, rate=0.05, max_leaves=None, max_depth=3, min_rows=1, newton=False),
    "hist_gradient_boosting": dict(n_iter=200, rate=0.1, max_leaves=31, max_depth=None, min_rows=20, newton=True),
}


def oof(name: str, df: DataFrame, folds: Sequence[int], classes: int | None, weight: str | None = None,
        train: dict[int, DataFrame] | None = None, row_id: str = "row_id", label: str = "label", **more) -> DataFrame:
    """Out-of-fold rows of ``extra_trees``, ``gradient_boosting`` or ``hist_gradient_boosting``, written once."""
    rows = training_rows(df, label=label, row_id=row_id, weight=weight, train=train)
    if name == "extra_trees":
        out = predict_extra_trees(extra_trees(rows, folds, classes, **more), rows, classes, name)
    else:
        out = predict_boosted(boost(rows, folds, classes, **(GRID[name] | more)), rows, name)
    return write_stage(out)
