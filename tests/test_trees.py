"""Tree learners against plain loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwear.operators import trees as tr


def table(spark, n=240, classes=3, missing=0.1, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0), [-0.4, 0.4]) if classes else 2 * x[:, 0] - np.abs(x[:, 1]) + 0.1 * rng.normal(size=n)
    if classes == 2:
        y = np.minimum(y, 1)
    x[rng.random(x.shape) < missing] = np.nan
    rows = [(i, i % 3, float(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, fold int, label double, vec array<double>").repartition(4), x, y


def test_best_split_equals_all_cuts():
    rng = np.random.default_rng(1)
    for newton in (True, False):
        bins = rng.integers(0, 6, size=(80, 3)).astype(np.uint8)
        bins[rng.random(bins.shape) < 0.2] = tr.MISSING
        stats = np.column_stack([np.ones(80), rng.normal(size=80), rng.random(80) + 0.1])
        got = tr.best_split(tr.histogram_of(bins, stats), 5, 1e-3, newton)
        best = None
        for j in range(3):
            for low in (False, True):
                for cut in range(255):
                    go = np.where(bins[:, j] == tr.MISSING, low, bins[:, j] <= cut)
                    a, b, t = stats[go].sum(0), stats[~go].sum(0), stats.sum(0)
                    if min(a[0], b[0]) < 5:
                        continue
                    v = lambda s: s[1] ** 2 / (s[2] if newton else s[0])
                    gain = v(a) + v(b) - v(t)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, j, low, cut)
        assert got["gain"] == pytest.approx(best[0]) and (got["feature"], got["missing_left"], got["cut"]) == best[1:]
    assert tr.best_split(tr.histogram_of(bins[:4], stats[:4]), 5, 0, True) is None


def best_first(bins, stats, max_leaves, min_rows):
    """A tree by a plain queue: list of (gain, feature, cut, rows left, rows right) in the order of opening."""
    queue, out, leaves = [np.arange(len(bins))], [], 1
    while leaves < max_leaves:
        options = [(s["gain"], -k, s) for k, idx in enumerate(queue) if (s := tr.best_split(tr.histogram_of(bins[idx], stats[idx]), min_rows, 1e-3, True))]
        if not options:
            break
        gain, k, s = max(options, key=lambda o: o[:2])
        idx = queue.pop(-k)
        b = bins[idx, s["feature"]]
        go = np.where(b == tr.MISSING, s["missing_left"], b <= s["cut"])
        queue += [idx[go], idx[~go]]
        out.append((round(gain, 6), s["feature"], s["cut"], int(go.sum()), int((~go).sum())))
        leaves += 1
    return sorted(out)


def test_best_first_boosting(spark):
    df, x, y = table(spark, classes=0)
    rows = tr.training_rows(df)
    m = tr.boost(rows, [0, 1, 2], None, n_iter=2, rate=0.5, max_leaves=8, min_rows=4)
    fold = np.arange(len(y)) % 3
    bins = tr.to_bins(x, m.edges)
    for f in range(3):
        use = fold != f
        assert m.start[f][0] == pytest.approx(y[use].mean())
        raw = np.full(use.sum(), y[use].mean())
        for k in range(2):
            stats = np.column_stack([np.ones(use.sum()), raw - y[use], np.ones(use.sum())])
            t = m.trees[f][k][0]
            at = tr.route_bins(t, bins[use])
            opened = [n for n in range(len(t["left"])) if t["left"][n] >= 0]
            inside = {n: set() for n in range(len(t["left"]))}
            for leaf in np.unique(at):
                assert t["value"][leaf] == pytest.approx(-stats[at == leaf, 1].sum() / (at == leaf).sum())
            parent = {c: n for n in opened for c in (t["left"][n], t["right"][n])}
            for i, leaf in enumerate(at):
                while True:
                    inside[leaf].add(i)
                    if leaf not in parent:
                        break
                    leaf = parent[leaf]
            got = sorted((round(t["gain"][n], 6), t["feature"][n], t["cut"][n], len(inside[t["left"][n]]), len(inside[t["right"][n]])) for n in opened)
            assert got == best_first(bins[use], stats, 8, 4) and len(opened) == 7
            raw = raw + 0.5 * np.asarray(t["value"])[at]


def test_multinomial_boosting(spark):
    df, x, y = table(spark)
    out = tr.oof("gradient_boosting", df, range(3), 3, n_iter=12, rate=0.3).collect()
    assert len(out) == len(y) and all(sum(r.shares) == pytest.approx(1) and r.y_pred == int(np.argmax(r.shares)) for r in out)
    assert np.mean([r.y_pred == r.y_true for r in out]) > 0.75
    two, _, y2 = table(spark, classes=2)
    out = tr.oof("hist_gradient_boosting", two, range(3), 2, n_iter=4, min_rows=5, max_leaves=6).collect()
    assert all(len(r.shares) == 2 and sum(r.shares) == pytest.approx(1) for r in out) and np.mean([r.y_pred == r.y_true for r in out]) > 0.75


def test_extra_trees(spark):
    df, x, y = table(spark, missing=0.0)
    rows = tr.training_rows(df)
    trees = tr.extra_trees(rows, [0, 1, 2], 3, n_trees=6)
    assert len(trees) == 18 and len({str(t["cut"]) for t in trees.values()}) == 18               # all distinct
    fold = np.arange(len(y)) % 3
    for (f, k), t in trees.items():
        use = fold != f
        xs, ys = x[use], y[use].astype(int)
        at = tr.route(t, xs)
        for leaf in np.unique(at):                                                             # grown out: pure leaves
            assert len(set(ys[at == leaf])) == 1 and t["value"][leaf][ys[at == leaf][0]] == 1
        chosen, cuts = tr.node_cuts(tr.SEED, f * 6 + k, 0, xs.min(0), xs.max(0), 2)             # the root by a plain loop
        def gini(z):
            c = np.bincount(z, minlength=3)
            return (c * c).sum() / max(1, c.sum())
        score = [gini(ys[xs[:, j] <= c]) + gini(ys[xs[:, j] > c]) for j, c in zip(chosen, cuts)]
        assert (t["feature"][0], t["cut"][0]) == (chosen[int(np.argmax(score))], cuts[int(np.argmax(score))])
    p = tr.predict_extra_trees(trees, rows, 3).collect()
    assert len(p) == len(y) and np.mean([r.y_pred == r.y_true for r in p]) > 0.6


def test_extra_trees_regression_and_synthetic_rows(spark):
    df, x, y = table(spark, classes=0, missing=0.0)
    out = tr.oof("extra_trees", df, range(3), None, n_trees=10).collect()
    err = np.mean([(r.y_pred - r.y_true) ** 2 for r in out])
    assert err < 0.5 * np.var(y)
    # training rows by fold: the same rows as the other folds give the same trees
    train = {f: df.where(F.col("fold") != f) for f in range(3)}
    again = {r.row_id: r.y_pred for r in tr.oof("extra_trees", df, range(3), None, n_trees=10, train=train).collect()}
    assert again == pytest.approx({r.row_id: r.y_pred for r in out})


def test_values_by_node_are_joined_without_a_scan_per_node(spark, monkeypatch):
    """Parts of several tasks give one row per node; a batch goes down a tree once a pass, however many nodes are open."""
    parts = [(np.array([2, 5]), np.array([[1.0, 4.0], [3.0, 0.0]]), np.array([[1.0], [2.0]])), (np.array([5, 7]), np.array([[2.0, 9.0], [8.0, 8.0]]), np.array([[4.0], [8.0]]))]
    ids, low, s = tr.merge_nodes(parts, (np.minimum, np.add))
    assert ids.tolist() == [2, 5, 7] and low.tolist() == [[1, 4], [2, 0], [8, 8]] and s.tolist() == [[1], [6], [8]]
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(rng.integers(3)), [float(v) if v > -1.5 else None for v in rng.normal(size=3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, fold int, label double, vec array<double>").repartition(3)
    trees = tr.extra_trees(tr.training_rows(df), [0, 1], 3, n_trees=2)
    for (f, _), t in trees.items():
        mine = [r for r in rows if r[1] != f]
        at = tr.route(t, np.array([[np.nan if v is None else v for v in r[3]] for r in mine]))
        for n in np.unique(at):                                          # every leaf's shares are those of its rows
            y = [r[2] for r, a in zip(mine, at) if a == n]
            assert np.allclose(t["value"][n], np.bincount(np.array(y, int), minlength=3) / len(y))
        assert len(np.unique(at)) > 50
