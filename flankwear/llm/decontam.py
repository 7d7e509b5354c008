"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Texts become words (A-Z lower-cased; letters, digits and all characters beyond ASCII).  At every word
position a fixed mask selects ``SEED_WORDS`` of the next ``SPAN`` words and ignores the others; the hash
of the selected words is the seed, so a changed word at an ignored position does not matter, and three
masks ignore different positions.  Seeds of the test items meet seeds of the training texts in a join;
each hit fixes a diagonal (text position less item position), and around it, ``FLANK`` words to either
side, the aligned words are compared one by one.  The best stretch counts one for an equal word and
``PENALTY`` against a substituted one; a text overlaps an item where a stretch scores ``MIN_SCORE``.

All masks start with two adjacent selected words.  Bitmaps of fixed size (2^21 bits, whatever the
tables' sizes) over the items' word pairs and seeds drop almost all training positions before any
shuffle; a bitmap that fills up merely drops less.  Texts are matched by a 96-bit hash, so thousands of
copies of a text, or a third of all rows, are searched where they lie but verified once.

Items of ``LEAST`` to ``SPAN - 1`` words are too short for a mask: they are found as whole word sequences, one
seed per length, and score their number of words.

Defined results: null or wordless texts and items of fewer than ``LEAST`` words overlap with nothing; items
with equal words are reported once, under the smallest item_id; repeated rows give a result row each; a
null doc_id is carried along.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import ascii_words, bitmap, in_bitmap, stage

#: Selected positions of each mask; all start with 0, 1 and lie in a span of 10 words.
MASKS = ((0, 1, 3, 4, 6, 7, 9), (0, 1, 2, 5, 7, 8, 9), (0, 1, 4, 5, 6, 8, 9))
SPAN, SEED_WORDS = 10, 7
LEAST = 4                # shorter items are everyday phrases and left alone
FLANK = 64               # words to either side of a seed that are compared
PENALTY, MIN_SCORE = 2, 10


def seed(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(len(mask) * 1000 + sum(p * p for p in mask)), *[F.get(words, at + p) for p in mask])


def positions(df: DataFrame, carry: list[str]) -> DataFrame:
    """One row per word position that starts a whole span: carried columns, w, i and the pair hash."""
    return (df.select(*carry, "w", F.posexplode("w").alias("i", "w0"))
            .where(F.col("i") + SPAN <= F.size("w"))
            .withColumn("pair", F.xxhash64("w0", F.get("w", F.col("i") + 1))))


def seeds(pos: DataFrame, carry: list[str]) -> DataFrame:
    """One row per position and mask: carried columns, i, h."""
    each = F.explode(F.array(*[seed(F.col("w"), F.col("i"), m) for m in MASKS]))
    return pos.select(*carry, "i", each.alias("h"))


def _best_stretch(same: Column) -> Column:
    """Highest-scoring stretch of an array of booleans: struct(score, first, last, matched)."""
    def step(a: Column, x: Column) -> Column:
        cur = F.when(a["run"] > 0, a["run"]).otherwise(0) + F.when(x, 1).otherwise(-PENALTY)
        begin = F.when(a["run"] > 0, a["begin"]).otherwise(a["at"])
        hits = F.when(a["run"] > 0, a["hits"]).otherwise(0) + x.cast("int")
        more = cur > a["score"]
        return F.struct((a["at"] + 1).alias("at"), cur.alias("run"), begin.alias("begin"), hits.alias("hits"),
                        F.when(more, cur).otherwise(a["score"]).alias("score"),
                        F.when(more, begin).otherwise(a["first"]).alias("first"),
                        F.when(more, a["at"]).otherwise(a["last"]).alias("last"),
                        F.when(more, hits).otherwise(a["matched"]).alias("matched"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "run", "begin", "hits", "score", "first", "last", "matched")])
    return F.aggregate(same, zero, step)


def _text_key() -> list[Column]:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.hash(t).alias("k2")]


def _short_overlaps(docs: DataFrame, short: DataFrame) -> DataFrame | None:
    """Places of items of fewer than ``SPAN`` words as whole sequences: k1, k2, item_id, score, matched, first, last."""
    lengths = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())       # SPAN - LEAST at most
    if not lengths:
        return None
    whole = lambda w, at, n: F.xxhash64(F.lit(n), F.slice(w, at + 1, n))
    known = short.select("item_id", F.col("w").alias("v"), F.xxhash64(F.size("w"), "w").alias("h"),
                         F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("pair"))
    pairs, seeds_ = bitmap(known, "pair"), bitmap(known, "h")
    texts = docs.select(*_text_key(), ascii_words(F.col("text").cast("string")).alias("w"))
    at = (texts.select("k1", "k2", "w", F.posexplode("w").alias("i", "w0"))
          .where(in_bitmap(pairs, F.xxhash64("w0", F.get("w", F.col("i") + 1)))))
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.col("i") + n <= F.size("w"))
    each = at.select("k1", "k2", "i", F.explode(F.transform(fits, lambda n: F.struct(
        F.slice("w", F.col("i") + 1, n).alias("x"), whole(F.col("w"), F.col("i"), n).alias("h")))).alias("s"))
    hits = each.select("k1", "k2", "i", "s.x", "s.h").where(in_bitmap(seeds_, F.col("h"))).join(known, "h").where(F.col("x") == F.col("v"))
    n = F.size("v")
    return hits.select("k1", "k2", "item_id", n.alias("score"), n.alias("matched"), F.col("i").alias("first"), (F.col("i") + n - 1).alias("last"))


def text_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps of distinct texts with items: k1, k2 (text hash), item_id, score, matched, first_word, last_word."""
    every = stage(items.select(F.col("item_id").cast("bigint").alias("item_id"), ascii_words(F.col("text").cast("string")).alias("w"))
                  .where(F.size("w") >= LEAST).groupBy("w").agg(F.min("item_id").alias("item_id"))
                  .withColumn("item", F.xxhash64("w")))
    it = every.where(F.size("w") >= SPAN)
    item_pos = positions(it, ["item", "item_id"])
    item_seeds = stage(seeds(item_pos, ["item"]).withColumnRenamed("i", "j"))
    pairs, known = bitmap(item_pos, "pair"), bitmap(item_seeds, "h")

    texts = docs.select(*_text_key(), ascii_words(F.col("text").cast("string")).alias("w"))
    hits = (seeds(positions(texts, ["k1", "k2"]).where(in_bitmap(pairs, F.col("pair"))), ["k1", "k2"])
            .where(in_bitmap(known, F.col("h"))))
    diagonals = stage(hits.join(item_seeds, "h")
                      .groupBy("k1", "k2", "item", (F.col("i") - F.col("j")).alias("d"))
                      .agg(F.min("i").alias("lo"), F.max("i").alias("hi")))

    found = bitmap(diagonals, "k1")      # only texts with hits are shuffled, one row for each
    again = docs.select(*_text_key(), F.col("text").cast("string").alias("t")).where(in_bitmap(found, F.col("k1")))
    again = again.groupBy("k1", "k2").agg(F.first("t").alias("t")).select("k1", "k2", ascii_words(F.col("t")).alias("w"))
    both = diagonals.join(it.select("item", "item_id", F.col("w").alias("v")), "item").join(again, ["k1", "k2"])
    start = F.greatest(F.lit(0), F.col("d"), F.col("lo") - FLANK)
    stop = F.least(F.size("w"), F.size("v") + F.col("d"), F.col("hi") + SPAN + FLANK)
    same = F.zip_with(F.slice("w", start + 1, stop - start), F.slice("v", start - F.col("d") + 1, stop - start),
                      lambda a, b: a == b)
    best = both.select("k1", "k2", "item_id", start.alias("start"), _best_stretch(same).alias("b")).where(F.col("b.score") >= MIN_SCORE)
    best = best.select("k1", "k2", "item_id", "b.score", "b.matched", (F.col("start") + F.col("b.first")).alias("first"),
                       (F.col("start") + F.col("b.last")).alias("last"))
    if (short := _short_overlaps(docs, every.where(F.size("w") < SPAN))) is not None:
        best = best.unionByName(short)
    top = best.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("score", "matched", (-F.col("first")).alias("first"), "last")).alias("m"))
    return stage(top.select("k1", "k2", "item_id", "m.score", "m.matched", (-F.col("m.first")).alias("first_word"),
                            F.col("m.last").alias("last_word")))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row and overlapping item: doc_id, item_id, score, matched, first_word, last_word
    (the best stretch, in words of the document from 0).  Clean documents give no row."""
    found = text_overlaps(docs, items)
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_text_key()).where(in_bitmap(bitmap(found, "k1"), F.col("k1")))
    return keys.join(found, ["k1", "k2"]).drop("k1", "k2")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that overlap with no item, all columns unchanged; only suspected rows are shuffled."""
    found = text_overlaps(docs, items)
    k1, k2 = _text_key()
    hit = in_bitmap(bitmap(found, "k1"), k1)
    keys = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    cleared = docs.where(hit).join(keys, (k1 == keys["__k1"]) & (k2 == keys["__k2"]), "left_anti")
    return docs.where(~hit).unionByName(cleared)


def oracle_sql() -> str:
    """The same result in DuckDB text: every seed of every document, stretches from prefix sums."""
    def key(m: tuple[int, ...]) -> str:
        return "concat_ws(' ', " + ", ".join(f"w[i + {p + 1}]" for p in m) + ")"

    def seeds_of(src: str, ident: str) -> str:
        return " UNION ALL ".join(f"SELECT {ident}, i, {n} AS m, {key(m)} AS h FROM {src}" for n, m in enumerate(MASKS))

    words = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
ev AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {LEAST} GROUP BY w),
it AS (SELECT * FROM ev WHERE len(w) >= {SPAN}),
sh AS (SELECT d.rid, s.item_id, len(s.w) AS score, i AS first, i + len(s.w) - 1 AS last
       FROM (SELECT item_id, w FROM ev WHERE len(w) < {SPAN}) s, (SELECT rid, w, unnest(range(len(w))) AS i FROM d) d
       WHERE d.w[i + 1] = s.w[1] AND d.w[i + 1 : i + len(s.w)] = s.w),
dp AS (SELECT rid, w, i FROM d, unnest(range(greatest(0, len(w) - {SPAN - 1}))) AS u(i)),
ip AS (SELECT item_id, w, i FROM it, unnest(range(len(w) - {SPAN - 1})) AS u(i)),
ds AS ({seeds_of('dp', 'rid')}),
js AS ({seeds_of('ip', 'item_id')}),
g AS (SELECT rid, item_id, ds.i - js.i AS d, min(ds.i) AS lo, max(ds.i) AS hi FROM ds JOIN js USING (m, h) GROUP BY ALL),
a AS (SELECT g.rid, g.item_id, g.d, d.w, it.w AS v, greatest(0, g.d, lo - {FLANK}) AS s,
             least(len(d.w), len(it.w) + g.d, hi + {SPAN + FLANK}) AS e
      FROM g JOIN d USING (rid) JOIN it USING (item_id)),
c AS (SELECT rid, item_id, d, k, CASE WHEN w[k + 1] = v[k - d + 1] THEN 1 ELSE {-PENALTY} END AS x
      FROM a, unnest(range(s, e)) AS u(k)),
p AS (SELECT *, sum(x) OVER (PARTITION BY rid, item_id, d ORDER BY k) AS t FROM c),
q AS (SELECT *, least(0, min(t) OVER (PARTITION BY rid, item_id, d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS lowest,
             min(k) OVER (PARTITION BY rid, item_id, d) AS k0 FROM p),
b AS (SELECT rid, item_id, d, k0, max(t - coalesce(lowest, 0)) AS score, arg_max(coalesce(lowest, 0), (t - coalesce(lowest, 0), -k)) AS base,
             arg_max(k, (t - coalesce(lowest, 0), -k)) AS last FROM q GROUP BY ALL),
f AS (SELECT b.rid, b.item_id, b.d, b.score, b.last,
             greatest(coalesce(max(p.k) + 1, b.k0), CASE WHEN b.base = 0 THEN b.k0 ELSE 0 END) AS first
      FROM b LEFT JOIN p ON p.rid = b.rid AND p.item_id = b.item_id AND p.d = b.d AND p.k < b.last AND p.t = b.base
      WHERE b.score >= {MIN_SCORE} GROUP BY b.rid, b.item_id, b.d, b.score, b.last, b.base, b.k0),
r AS (SELECT rid, item_id, score, first, last, (score + {PENALTY} * (last - first + 1)) / {PENALTY + 1} AS matched FROM f
      UNION ALL SELECT rid, item_id, score, first, last, score FROM sh),
o AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY score DESC, matched DESC, first, last DESC) AS n FROM r)
SELECT doc_id, item_id, score::INTEGER AS score, matched::INTEGER AS matched, first::INTEGER AS first_word, last::INTEGER AS last_word
FROM o JOIN d USING (rid) WHERE n = 1"""
