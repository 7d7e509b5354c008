import random
import re

from flankwear.llm import decontam as dc
from flankwear.llm.common import WORD_BREAK, table


def words(t):
    return [w for w in re.split(WORD_BREAK, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def brute(docs, items):
    """(doc_id, item_id, score) of pairs with a seed hit and a stretch of the minimum score on its diagonal."""
    seen, out = {}, set()
    for i, t in sorted(items):
        if len(w := words(t)) >= dc.SPAN:
            seen.setdefault(tuple(w), i)
    for d, t in docs:
        w = words(t)
        for v, item in seen.items():
            best = 0
            for diag in range(-len(v) + dc.SPAN, len(w) - dc.SPAN + 1):
                same = [w[j + diag] == v[j] if 0 <= j + diag < len(w) else None for j in range(len(v))]
                hit = any(all(same[j + p] for p in m) and None not in same[j:j + dc.SPAN] for m in dc.MASKS
                          for j in range(len(v) - dc.SPAN + 1))
                run = 0
                for s in same if hit else []:
                    run = 0 if s is None else max(0, run) + (1 if s else -dc.PENALTY)
                    best = max(best, run)
            if best >= dc.MIN_SCORE:
                out.add((d, item, best))
    return out


def run(docs, items):
    return {(r["doc_id"], r["item_id"], r["score"]) for r in dc.contaminated(docs, items).collect()}


def test_whole_small_table(spark, small):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and run(docs, items) == want
    left = {r["doc_id"] for r in dc.drop_contaminated(docs, items).collect()}
    assert left == {d for d, _ in rows} - {d for d, *_ in want}


def test_same_as_sql(same_as_sql, small):
    assert same_as_sql("op10_benchmark_decontamination", small)


def test_substitutions_and_edges(spark, tmp_path, same_as_sql):
    rnd = random.Random(1)
    item = [f"t{i}" for i in range(24)]
    other = [f"u{i}" for i in range(200)]

    def text(changed):
        body = [("zz" if k in changed else x) for k, x in enumerate(item)]
        return " ".join(rnd.sample(other, 30) + body + rnd.sample(other, 30))
    docs = [(1, text([])), (2, text([5])), (3, text([3, 12, 20])), (4, text(range(0, 24, 2))), (5, text(range(9, 24))),
            (6, "T0, T1! " + " ".join(item[2:])), (7, None), (8, ""), (9, text([])), (9, text([])), (None, text([])),
            (10, " ".join(other)), (11, "word " * 40000 + " ".join(item))]
    items = [(5, " ".join(item)), (7, " ".join(item)), (8, "too short"), (9, None), (10, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS k1", "'a' AS item", "2 AS h", "'q' AS w")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' AS d", "7 AS j")
    got = run(df, it)
    assert got == brute(docs, items)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    it.write.parquet(f"{tmp_path}/benchmark.parquet")
    same_as_sql("op10_benchmark_decontamination", str(tmp_path))
    assert {d for d, *_ in got} == {1, 2, 3, 6, 9, None, 11} and {i for _, i, _ in got} == {5}
    kept = dc.drop_contaminated(df, it)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 7, 8, 10]
    first = dc.contaminated(df, it).where("doc_id = 11").first()
    assert (first["first_word"], first["last_word"], first["matched"]) == (40000, 40023, 24)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    assert run(docs, items) == set() and run(some, items) == set()
    assert dc.drop_contaminated(some, items).count() == 1


def test_no_python_in_plan(spark, small):
    plan = dc.contaminated(table(spark, small, "documents"), table(spark, small, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_are_whole_sequences(spark, same_as_sql, tmp_path):
    items = [(1, "one two three four five six seven eight nine"), (2, "what is it now"), (3, "too short here"), (4, "WHAT is it, now!"), (5, None),
             (6, " ".join(f"w{k}" for k in range(20)))]
    docs = [(1, "a b one two three four five six seven eight nine c"), (2, "one two three four five six seven eight nin"),
            (3, "so what is it now and what is it now"), (4, "too short here"), (None, "what is it now"), (5, " ".join(f"w{k}" for k in range(20)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = same_as_sql("op10_benchmark_decontamination", str(tmp_path))
    out = {(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in
           dc.contaminated(*[spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")]).collect()}
    assert len(got) == 4 and out == {(1, 1, 9, 2, 10), (3, 2, 4, 1, 4), (None, 2, 4, 0, 3), (5, 6, 20, 0, 19)}
