import numpy as np
from pyspark.sql import functions as F

from flankwear.llm import ann
from flankwear.llm.queries import op2_rotated_bit_codes


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in op2_rotated_bit_codes(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(ids[ids % 20 == 0])
    hits = 0
    for q, found in got.items():
        found.sort()
        score = np.zeros(len(v))
        x = v[ids == q][0]
        for d in range(v.shape[1]):
            score += v[:, d] * x[d]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({i for _, i, _ in found} & set(ids[order]))
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(s == score[ids == i][0] for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits >= 0.95 * 20 * len(got)


def test_whole_small_table(same_as_sql, small):
    assert len(same_as_sql("op2_rotated_bit_codes", small)) == 25 * 20


def test_blocks_give_the_same(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "ROWS", 70)
    monkeypatch.setattr(ann, "QUERIES", 9)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (40, [nan, nan]), (2, [1.0, 0.0]), (3, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS score", "'c' AS code", "4 AS rank")
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    alone = ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0)
    assert alone.collect() == [] and ann.nearest(df.where("vec_id < 0"), F.lit(True)).collect() == []


def test_error_bound_holds():
    """Nearly all estimates lie within the bound, and the bound is not vacuous."""
    rnd = np.random.default_rng(0)
    v, q = rnd.standard_normal((3000, 48)), rnd.standard_normal((20, 48))
    mean, turn = v.mean(axis=0), ann.rotation(ann.CODE_BITS, 48)
    bits, dist, own = ann.encode(v, mean, turn)
    code = (np.unpackbits(bits, axis=1)[:, :ann.CODE_BITS] * 2.0 - 1) / np.sqrt(ann.CODE_BITS)
    guess = (q @ mean)[:, None] + (q @ turn @ code.T) * (dist / own)
    sigma = np.sqrt((q * q).sum(axis=1))[:, None] * dist * np.sqrt((1 - own ** 2) / own ** 2 / (ann.CODE_BITS - 1))
    z = (guess - q @ v.T) / sigma
    assert abs(z.mean()) < 0.05 and (np.abs(z) <= ann.SIGMAS).mean() > 0.97
