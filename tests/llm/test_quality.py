import pytest
from collections import Counter
from itertools import product

import numpy as np

from flankwear.llm import quality as q
from flankwear.llm.common import table


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["keep"] for r in q.classify(table(spark, sf, "documents")).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, sf, "labels").collect()]
    good = [got[d] for d, y in labels if y == 1]
    bad = [got[d] for d, y in labels if y == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.15


def test_em_matches_brute_force_rounds():
    """One plain loop over documents, classes and labellers gives the same estimates as the pattern table."""
    rnd = np.random.default_rng(0)
    docs = [[int(rnd.choice([0, 1, 2], p=[.1, .3, .6] if y == 0 else [.09, .01, .9])) for _ in q.STATS]
            for y in rnd.random(400) < 0.85]
    theta, share, post = q.fit_labellers(Counter(map(q.pattern, docs)), rounds=3)
    p = [0.98 if 1 not in v else 0.02 if v.count(1) >= 2 else 0.1 for v in docs]
    prior = [[0.1, 0.3, 0.6], [0.09, 0.01, 0.9]]
    for _ in range(3):
        t = [[[prior[c][x] * len(docs) / 100 + sum((pi if c else 1 - pi) for pi, v in zip(p, docs) if v[k] == x)
               for x in range(3)] for c in (0, 1)] for k in range(len(q.STATS))]
        t = [[[x / sum(row) for x in row] for row in lab] for lab in t]
        for lab in t:
            lab[1][1] = min(lab[1][1], q.FALSE_ALARM)
        s = (sum(p) + 9) / (len(p) + 10)
        p = []
        for v in docs:
            bad, good = 1 - s, s
            for k, x in enumerate(v):
                bad, good = bad * t[k][0][x], good * t[k][1][x]
            p.append(good / (good + bad))
    assert np.allclose(theta, t) and np.isclose(share, s)
    assert np.allclose([post[q.pattern(v)] for v in docs], p)


def test_clean_corpus_is_left_alone(spark):
    text = "The quick brown fox ran over the hill, and {} others saw it. Then they all went home to sleep."
    df = spark.createDataFrame([(i, text.format(i)) for i in range(300)], "doc_id long, text string")
    assert q.drop_bad(df).count() == 300


def test_repeated_texts_train_once_at_every_size(spark, monkeypatch):
    sound = "A plain sentence of several words, and one more that ends here. Number {}, as it happens, is all there is to it."
    once = [(i, sound.format(i)) for i in range(40)]
    many = once + [(100 + i, once[i % 20][1]) for i in range(400)]

    def sizes(rows):
        return q.quality_model(spark.createDataFrame(rows, "doc_id long, text string"))[2]

    monkeypatch.setattr(q, "fit_labellers", lambda counts: (None, None, dict.fromkeys(range(3 ** len(q.STATS)), 0.9)))   # only the sample differs
    assert np.allclose(sizes(once), sizes(many))         # below the bound
    monkeypatch.setattr(q, "FIT_ROWS", 60)               # 440 rows are above it, their 40 texts are not
    assert np.allclose(sizes(once), sizes(many))


def test_edges(spark):
    sound = "A plain sentence of several words, and one more that ends here."
    rows = [(1, None), (2, ""), (3, " \n"), (4, sound), (4, sound), (None, sound), (5, "spam " * 60000), (6, "ab"), (7, "!!! $$$ ### " * 50)]
    rows += [(10 + i, sound + f" Number {i}.") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'k' AS keep", "'p' AS pattern", "2 AS part")
    out = q.classify(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["score"], r["keep"]))
    assert len(out) == len(rows) and by[1] == by[2] == by[3] == [(0.0, False)]
    assert len(by[4]) == 2 and len(set(by[4])) == 1 and by[4][0][1] and by[None][0][1]
    assert not by[5][0][1] and not by[7][0][1]
    kept = q.drop_bad(df)
    assert kept.columns == df.columns and kept.where("doc_id >= 10").count() == 60
    assert kept.where("doc_id in (1, 2, 3, 5, 7)").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.classify(df).collect() == [] and q.drop_bad(df).collect() == []


def test_votes_cover_patterns():
    assert len({q.pattern(v) for v in product(range(3), repeat=len(q.STATS))}) == 3 ** len(q.STATS)


def test_sample_of_huge_corpora(spark, monkeypatch):
    from flankwear.llm import quality
    df = spark.createDataFrame([(k, f"plain words of text number {k} " * 8) for k in range(50)], "doc_id long, text string")
    monkeypatch.setattr(quality, "FIT_ROWS", 1e-9)            # as with far more texts than the sample can hold
    with pytest.raises(RuntimeError, match="FIT_ROWS"):
        quality.quality_model(df)
    assert int(12_000 / 1e13 * quality.DRAWS) > 0
