import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwear.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def loops(rows):
    """Leaf, subroot, root, proof and folded root of every row, by plain loops over whole levels."""
    def leaf(r, more=0):
        vals = [v if c != "n_chars" or v is None else v + more for c, v in zip(merkle.COLUMNS, r)]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def path(lv, k):
        return [(lv[d][k >> d ^ 1] if k >> d ^ 1 < len(lv[d]) else None, k >> d & 1) for d in range(len(lv) - 1)]

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    lv = {g: levels([leaf(r) for r in trees[g]]) for g in names}
    top = levels([lv[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for k, r in enumerate(trees[g]):
            steps = path(lv[g], k) + path(top, j)
            cur = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for sib, odd in steps:
                cur = h(cur) if sib is None else h(sib, cur) if odd else h(cur, sib)
            out.append((r[0], leaf(r), lv[g][-1][0], top[-1][0], h(*[s for s, _ in steps if s]), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n, langs=("en", None, "de", "\U0001F600", "￿", "")):
    return [(k, None if k % 5 == 0 else f"src{k % 3}", langs[0 if k % 3 else k % len(langs)], None if k % 7 == 0 else k,
             None if k % 11 == 0 else f"text {k} é\n") for k in range(n)]


def test_addresses_are_the_recursive_split():
    for levels in range(1, 9):
        seen = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(seen.tolist()) == list(range((1 << levels) - 1))
    # four levels: root and its children first, then four subtrees of three nodes each
    assert merkle.address(4, 1, np.arange(2)).tolist() == [1, 2]
    assert merkle.address(4, 2, np.arange(4)).tolist() == [3, 6, 9, 12]
    assert merkle.address(4, 3, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_trees_equal_loops(spark, height):
    rows = rows_of(61) + [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (4, "other", "en", 2, "y"), (7, "s", "en", None, "t" * 50_000)]
    got = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA).repartition(5), height).collect()
    assert sorted(map(tuple, got), key=repr) == loops(rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_trees(spark, n):
    for rows in ([r[:2] + ("en",) + r[3:] for r in rows_of(n)], [r[:2] + (f"l{r[0]}",) + r[3:] for r in rows_of(n)]):
        got = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA), 2).collect()
        assert sorted(map(tuple, got), key=repr) == loops(rows)


def test_stored_blocks_and_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(40), SCHEMA).withColumn("grp", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("root", F.lit("r"))
    leaves, tiers, forest = merkle.manifest(df, "lang", "doc_id", merkle.COLUMNS, height=2)
    assert len(tiers) == 3                                        # 28 or so leaves of one language: 7, 2 and 1 blocks
    for b in tiers[0].collect():
        assert len(b["nodes"]) == 32 * ((1 << b["levels"]) - 1) and b["nodes"][:32].hex() == b["top"]
    p = merkle.proofs(leaves, tiers, forest, 2).collect()
    assert len(p) == 40
    assert all(merkle.fold(r["digest"], r["sides"], r["siblings"]) == r["root"] for r in p)
    assert sorted(map(tuple, merkle.tamper_check(df, 2).collect()), key=repr) == loops(rows_of(40))


def test_empty_table(spark):
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(same_as_sql, small):
    assert same_as_sql("op12_merkle_manifest", small)
