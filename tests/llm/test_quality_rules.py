import re

import pytest
from pyspark.sql import functions as F

from flankwear.llm import quality_rules as q

SCHEMA = "doc_id long, text string"


def plain(text):
    """All measures of a text by loops."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_lines": len(lines), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit),
            "n_stutters": sum(a == b for a, b in zip(w, w[1:])), "n_upper": sum("A" <= c <= "Z" for c in t),
            "n_lower": sum("a" <= c <= "z" for c in t), "n_digits": sum("0" <= c <= "9" for c in t)}


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "  lead and trail  ", "a b \U0001F600 é", "x " * 9, "x " * 8, "\n\n", "l1\nl1\n \nl1\nl2\n",
         "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h j b c d e f g h j", "# * $ % & | < >",
         "ABC DEF " * 12, "12 345 " * 15, " ".join(f"word{k}" for k in range(40)), "same line here\n" * 9,
         " ".join(f"w{k % 37}" for k in range(500)), "p\x00q r", "go go go stop " * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (None, "null id"), (3, "one"), (3, "one")], SCHEMA)


def test_measures_equal_loops(docs):
    rows = docs.select("text", *[f(F.col("text")).alias(m) for m, f in q.MEASURES.items()]).collect()
    for r in rows:
        assert {m: r[m] for m in q.MEASURES} == plain(r["text"]), r["text"]
    out, names = q.measures(docs)
    for r in out.collect():
        assert {m: r[n] for m, n in names.items()} == {m: plain(r["text"])[m] for m in q.BASE}


def test_verdicts_do_not_depend_on_the_order(docs):
    want = {}
    for t in TEXTS:
        m = plain(t)
        want[t] = not any(r.reject(m) for r in q.RULES)
    for order in (q.RULES, q.RULES[::-1]):
        out, by, kept = q.cascade(docs, order=order)
        for r in out.collect():
            assert r[kept] == want.get(r["text"], False)
            first = next((x.name for x in order if x.reject(plain(r["text"]))), None)
            assert r[by] == first
    got = q.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 3
    assert all(r["kept"] <= (not r["base_failed"]) for r in got)


def test_order_is_rejection_per_cost_of_what_is_left():
    # rule 1 rejects most, but at ten times the cost; rule 2 only rejects what rule 0 rejects as well
    assert q.cheapest_first({0b011: 4, 0b010: 6, 0b101: 5, 0: 100}, [1.0, 10.0, 1.0]) == [0, 1, 2]
    assert q.cheapest_first({}, [1.0, 2.0]) == [0, 1]
    assert q.cheapest_first({0b11: 1}, [2.0, 1.0]) == [1, 0]


def test_sampled_plan(spark, small):
    rules = q.plan(spark.read.parquet(f"{small}/documents.parquet"), sample_rows=100)
    assert sorted(r.name for r in rules) == sorted(r.name for r in q.RULES)


def test_empty_and_clashing_columns(spark, docs):
    assert q.quality_rules(docs.limit(0)).collect() == []
    odd = docs.select("doc_id", "text", F.lit(7).alias("n_words"), F.lit("x").alias("KEPT"), F.lit(1).alias("rejected_by"))
    out, names = q.measures(odd)
    assert names["n_words"] == "n_words_"
    out, by, kept = q.cascade(out, have=names, order=q.RULES)
    assert (by, kept) == ("rejected_by_", "kept_")
    for r in out.collect():
        assert (r["n_words"], r["KEPT"], r["n_words_"]) == (7, "x", plain(r["text"])["n_words"])
    assert set(q.quality_rules(odd).columns) >= {"doc_id", "n_words", "kept", "base_failed"}


def test_very_long_text(spark):
    text = " ".join(f"w{k % 60_000}" for k in range(120_000))
    r = q.quality_rules(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (120_000, 120_000, True)


def test_query_equals_sql(same_as_sql, small):
    assert same_as_sql("op11_rule_cascade", small)
