"""License scan: exact set-similarity join of text blocks with templates, DataFrame functions only.

Texts become words (A-Z lower-cased; letters, digits and all characters beyond ASCII) and overlapping
blocks of ``2 * block`` words, one starting every ``block`` words, so that every stretch of up to
``block`` words lies whole in a block.  A block matches a template when it holds at least ``threshold``
of the template's distinct words:

* template words are ordered by their frequency in the whole corpus, rarest first (one counting pass over
  all documents; only template words are counted, so the table is as small as the templates);
* prefix filter: a matching block must hold one of the first ``size - need + 1`` words of the template;
  blocks meet templates in an equi-join on those words;
* length filter: the block must hold at least ``need`` words of the templates' vocabulary;
* positional filter: the block must hold at least ``need`` of them from the joining word on;
* each pair of block and template is verified once, at the rarest word that both share;
* a label is given only where the block also holds the template's telling phrases (name, kind and version)
  word by word, so that a notice of a neighbouring license is not taken for it.

Phrases are templates of threshold 1 whose words must also stand consecutively; every such place is
counted in the one block in whose first half it starts.

Templates are the caller's fixed list, so broadcasting them is bounded.  Defined results: null or wordless
text has no words and no labels; repeated rows give one row each; a null doc_id is carried along.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import WORD_BREAK, ascii_words

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short public notices and the labels this scan adds for them.
TEMPLATES = {
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Phrases without which a template's label is not given.
TELLING = {
    "cc-by-nc": ["cc by nc"],
    "gpl-3.0": ["general public license", "version 3"],
    "apache-2.0": ["apache license", "2 0"],
    "mit": ["mit license"],
    "mit-text": ["permission is hereby granted"],
    "bsd": ["source and binary forms"],
    "mpl-2.0": ["mozilla public license", "2 0"],
}
THRESHOLD = 0.8
BLOCK = 32               # words of a block's half at least; the longest template if that is longer


def _split(text: str) -> list[str]:
    return [w for w in re.split(WORD_BREAK, text.lower()) if w]


def template_rows(templates: dict[str, str], phrases: dict[str, str], threshold: float,
                  counts: dict[str, int]) -> list[tuple]:
    """(label, phrase words or null, distinct words rarest first, words a block needs)."""
    rows = []
    for label, text, phrase in [*((k, v, False) for k, v in templates.items()), *((v, k, True) for k, v in phrases.items())]:
        words = sorted(set(_split(text)), key=lambda w: (counts.get(w, 0), w))
        need = len(words) if phrase else math.ceil(threshold * len(words) - 1e-9)
        rows.append((label, _split(text) if phrase else None, words, need))
    return rows


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the given words in all documents (as many rows as words reach the driver)."""
    vocab = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    words = docs.select(F.explode(ascii_words(F.col("text").cast("string"))).alias("word"))
    hits = words.join(F.broadcast(vocab), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in hits.collect()}


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 threshold: float = THRESHOLD, block: int = BLOCK, telling: dict[str, list[str]] = TELLING) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base (places of phrases), first_word, last_word (their smallest
    and largest start), base_labels and labels (distinct, sorted, comma-joined), score (largest share of a matching
    template's words in a block; 0 without a match), n_blocks (matching blocks)."""
    vocabulary = sorted({w for t in [*templates.values(), *phrases] for w in _split(t)})
    counts = word_counts(docs, vocabulary)
    rows = template_rows(templates, phrases, threshold, counts)
    block = max(block, *[len(_split(t)) for t in [*templates.values(), *phrases]])
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index = [(w, pos, label, phrase, words, words[:pos], need, ranked[ranked.index(w):],
              [] if phrase else [f" {x} " for x in telling.get(label, [])])
             for label, phrase, words, need in rows for pos, w in enumerate(words[:len(words) - need + 1])]
    index = docs.sparkSession.createDataFrame(
        index, "word string, pos int, label string, phrase array<string>, t array<string>, earlier array<string>, "
               "need int, onward array<string>, telling array<string>")
    prefix = sorted({w for _, _, words, need in rows for w in words[:len(words) - need + 1]})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        ascii_words(F.col("text").cast("string")).alias("w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / block).cast("int"))
    blocks = F.filter(F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("w", k * block + 1, 2 * block).alias("b"))),
                      lambda x: F.arrays_overlap(x["b"], _strings(prefix)))
    blocks = F.when(F.arrays_overlap("w", _strings(prefix)), blocks)
    cut = (texts.select("doc_id", "row", F.size("w").alias("n_words"), F.explode_outer(blocks).alias("x"))
           .select("doc_id", "row", "n_words", "x.k", "x.b"))
    met = (cut.withColumn("word", F.explode_outer(F.array_intersect("b", _strings(prefix))))
           .join(F.broadcast(index), "word", "left"))
    held = F.array_intersect("b", _strings(vocabulary))
    fits = ((F.size(held) >= F.col("need"))                                             # length filter
            & (F.size(F.array_intersect(held, "onward")) >= F.col("need"))              # positional filter
            & (F.size(F.array_intersect("b", "earlier")) == 0))                         # at the first common word
    share = F.size(F.array_intersect("b", "t")) / F.size("t")
    told = F.forall("telling", lambda x: F.contains(F.concat(F.lit(" "), F.array_join("b", " "), F.lit(" ")), x))
    places = F.filter(F.sequence(F.lit(0), F.lit(block - 1)),
                      lambda i: F.slice("b", i + 1, F.size("phrase")) == F.col("phrase"))
    met = met.withColumn("share", F.when(fits & (F.size(F.array_intersect("b", "t")) >= F.col("need")) & told, share))
    met = met.withColumn("at", F.when(F.col("share").isNotNull() & F.col("phrase").isNotNull(), places))
    base = F.size("at") > 0
    own = F.col("share").isNotNull() & F.col("phrase").isNull()
    out = met.groupBy("row", "doc_id").agg(
        F.first("n_words").cast("bigint").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.size("at"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("k") * block + F.array_min("at"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("k") * block + F.array_max("at"))).cast("bigint").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"),                      # bounded by the templates
        F.collect_set(F.when(base | own, F.col("label"))).alias("all"),
        F.coalesce(F.max(F.when(base | own, F.col("share"))), F.lit(0.0)).alias("score"),
        F.count_distinct(F.when(own, F.col("k"))).alias("n_blocks"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"),
                      joined("all").alias("labels"), "score", "n_blocks")


def oracle_sql() -> str:
    """The same result in DuckDB text, by brute force: every block against every template."""
    sql_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    temps = ", ".join(f"('{k}', {sql_list(sorted(set(_split(v))))}, {sql_list(f' {x} ' for x in TELLING[k])}, {math.ceil(THRESHOLD * len(set(_split(v))) - 1e-9)})"
                      for k, v in TEMPLATES.items())
    phr = ", ".join(f"('{v}', {sql_list(_split(k))}, {len(_split(k))})" for k, v in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(label, words, telling, need) AS (VALUES {temps}),
p(label, words, n) AS (VALUES {phr}),
b AS (SELECT rid, k, w[k * {BLOCK} + 1 : k * {BLOCK} + {2 * BLOCK}] AS b
      FROM d, unnest(range(greatest(0, (len(w) + {BLOCK - 1}) // {BLOCK}))) AS u(k)),
m AS (SELECT rid, k, label, len(list_intersect(b, words)) / len(words)::DOUBLE AS share
      FROM b, t WHERE len(list_intersect(b, words)) >= need
        AND len(list_filter(telling, lambda x: contains(' ' || array_to_string(b, ' ') || ' ', x))) = len(telling)),
g AS (SELECT rid, i, label FROM (SELECT rid, w, i FROM d, unnest(range(len(w))) AS u(i)) x, p
      WHERE w[i + 1] = words[1] AND w[i + 1 : i + n] = words),
mg AS (SELECT rid, max(share) AS s, count(DISTINCT k) AS n_blocks, list(DISTINCT label) AS ls FROM m GROUP BY rid),
gg AS (SELECT rid, count(*) AS n_base, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS ls FROM g GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
       hi::BIGINT AS last_word, array_to_string(list_sort(coalesce(gg.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(gg.ls, []), coalesce(mg.ls, [])))), ',') AS labels,
       CASE WHEN gg.rid IS NOT NULL THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score,
       coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM d LEFT JOIN mg USING (rid) LEFT JOIN gg USING (rid)"""
