import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwear.llm import langid as li
from flankwear.llm.queries import op8_language_mixture


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language_mixture(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) >= 0.97


def test_mixture_matches_brute_force_em():
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet(np.full(200, 0.05), size=3) + 1e-4
    logp = np.full((3, li.BUCKETS), -12.0)
    logp[:, :200] = np.log(p / p.sum(axis=1, keepdims=True))
    draw = np.concatenate([rnd.choice(200, 700, p=np.exp(logp[0, :200])), rnd.choice(200, 300, p=np.exp(logp[2, :200]))])
    idx, n = np.unique(draw, return_counts=True)
    got = li.mixture((idx, n.astype(float)), logp)
    pi = [0.5, 0.5]
    for _ in range(li.EM_ROUNDS):
        tot = [0.0, 0.0]
        for g in draw:
            w = [pi[0] * np.exp(logp[0, g]), pi[1] * np.exp(logp[2, g])]
            tot = [t + x / sum(w) for t, x in zip(tot, w)]
        pi = [t / len(draw) for t in tot]
    assert got[1] == 0 and np.allclose([got[0], got[2]], pi, atol=1e-3) and abs(pi[0] - 0.7) < 0.06


@pytest.fixture()
def corpus(spark):
    en = "the cat sat on the mat and looked at the other cats with some of their friends"
    de = "der hund lief über die straße und schaute nach den anderen hunden mit ihren freunden"
    rows = [(i, f"{en} {i}", "en") for i in range(30)] + [(100 + i, f"{de} {i}", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "1234 !!", None), (203, f"{en}. " * 10 + f"{de}. " * 5, None),
             (204, en, None), (204, en, None), (None, de, None), (205, (en + " ") * 3000, None), (206, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'a' AS lang_pred", "2 AS b")


def test_sets_and_edges(corpus):
    rows = li.identify(corpus).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == corpus.count()
    assert all(by[d][0]["lang_pred"] == "und" and by[d][0]["score"] == 0 and by[d][0]["languages"] == [] for d in (200, 201, 202))
    assert by[203][0]["languages"] == ["en", "de"] and 0.55 < by[203][0]["score"] < 0.75
    assert [r["languages"] for r in by[204]] == [["en"]] * 2 and by[None][0]["lang_pred"] == "de" and by[205][0]["score"] == 1
    kept = li.drop_unidentified(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == corpus.count() - 3


def test_nothing_to_learn_from(spark, corpus):
    none = li.identify(corpus, F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(empty).collect() == [] and li.drop_unidentified(empty).collect() == []


def test_sample_bounds(spark, monkeypatch):
    from flankwear.llm import langid
    rows = [(None, f"null id row {'abcdefghij'[k % 10] * (k + 1)}", "en") for k in range(400)] + [(1, "same row again", "de")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "FIT_ROWS", 40)
    names, logp = langid.language_model(df, F.lit(True))
    assert names == ["de", "en"]
    grams = langid.trigrams("null")[0]
    p = np.exp(logp[1])
    n = (p[grams] / p.min() * langid.SMOOTH - langid.SMOOTH).round()
    assert 10 <= n.max() <= 90                               # about 40 of the 400 rows without id, not none or all
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    assert langid.language_model(df, F.lit(True))[0] == ["en"]
