"""Registered queries against their DuckDB twins on the smallest driver tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["a15_pass_features", "j01_label_passes", "w01_wear_rate", "a28_describe", "g02_welch", "t01_f21_kruskal",
        "e01_e04_classification_metrics", "m11_j10_knn_classifier", "u01_fuse", "v01_stratified_folds"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "etat" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, D)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dc = [x[0] for x in cur.description]
    assert sorted(dc) == cols
    idx = [dc.index(c) for c in cols]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert s == d
