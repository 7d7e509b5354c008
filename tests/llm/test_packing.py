import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flankwear.llm.common import table, tokenizer_path
from flankwear.llm.packing import pack, plan_sequences


def lay_out(plan, capacity):
    """Fill of every sequence; fails where items overlap, leave gaps or run over."""
    bins = defaultdict(list)
    for n, _, k, first, offset in plan:
        for i in range(k):
            bins[first + i].append((offset, n))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=300))
def test_plan_covers_every_rank_once(lengths):
    counts = Counter(lengths)
    plan = plan_sequences(counts, 60)
    lay_out(plan, 60)
    for n, c in counts.items():
        ranks = sorted(r for m, a, k, *_ in plan if m == n for r in range(a, a + k))
        assert ranks == list(range(c))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=200))
def test_plan_is_about_as_good_as_best_fit_item_by_item(lengths):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(60 - n)
    assert len(lay_out(plan_sequences(Counter(lengths), 60), 60)) <= len(gaps) * 1.1 + 1


def test_large_items_pair_at_most_twice():
    bins = lay_out(plan_sequences({35: 4, 30: 3, 25: 9, 21: 2}, 60), 60)
    assert all(len(x) <= 2 for x in bins.values())


def test_plan_does_not_grow_with_counts():
    counts = {n: 1000 + n for n in range(1, 2049)}
    small = plan_sequences(counts, 2048)
    big = plan_sequences({n: c * 10 ** 6 for n, c in counts.items()}, 2048)
    assert len(small) < 40_000 and len(big) < 40_000


def check_pieces(rows, texts, capacity=2048):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), capacity)):
            x = ids[a:a + capacity]
            want[d, p, a, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


def test_whole_small_table(spark, small):
    df = table(spark, small, "documents")
    bins = check_pieces(pack(df.repartition(5), tokenizer_path()).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])
    total = sum(n for items in bins.values() for _, n in items)
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "It's ÉÀ ﬁ Σ ΑΣ İ 12 \x85x\xa0y  <|endoftext|> <|ENDOFTEXT|>a<|startoftext|>"), (3, "dup"), (3, "dup"),
            (None, "no id"), (5, "wo rd, " * 9000), (6, "😀!!! don't"), (7, "x" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS part", "'z' AS nth", "4 AS base")
    check_pieces(pack(df, tokenizer_path()).collect(), rows)
    got = pack(df, tokenizer_path(), with_ids=True).where("doc_id = 6").first()
    assert len(got["ids"]) == got["length"] and got["ids"][-1] == 0


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
    with pytest.raises(AttributeError):
        pack(None, tokenizer_path())
