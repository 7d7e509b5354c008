"""Quality rules as a short-circuit cascade, DataFrame functions only.

A rule rejects a document by a few measures of its whole text.  What a rule costs and what it rejects is
estimated on a sample: the sample (about ``SAMPLE_ROWS`` rows drawn over the whole table, written once) is
run through every rule alone, whose time above a bare reading of the texts is its cost, and the patterns of
rejections (at most 2^rules rows) are counted.  The cascade then takes, again and again, the rule that
rejects most of what the rules before it leave, per cost, and evaluates the rules as branches of one CASE in
that order: a document meets no rule behind the first that rejects it.  The order decides how much work is
done and which rule's name a document gets (``rejected_by``), never whether it is kept.

``measures`` gives the plain measures of every text, for reports; rules use such columns where they exist.
Everything is a projection: rows stay where they lie, so no key can be hot, and a text of any length is one
row's arrays.

Defined results: null text counts as empty (no words: rejected by ``few_words``); repeated rows, tied and
null ids are rows of their own; an empty table gives no rows (the rules then keep their given order); columns
of the input named like a measure make the measure's name end in ``_``.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import LOWER, UPPER, free_name, stage

SAMPLE_ROWS = 1_000      # rows (expected) on which costs and rejections are estimated
WINDOW = 8               # words of a window that counts as repeated
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; the text has no white space at its ends after the trim, so that no piece is empty."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(word: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more; windows are compared by their 64-bit hashes."""
    n = F.size(word)
    starts = F.transform(word, lambda w: F.xxhash64(w))

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        fresh = lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        found = _let(at, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        return _let(found, lambda p: F.aggregate(fresh(p), F.lit(0), lambda a, x: a + x))

    def of(h: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))
        return _let(wins, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(F.lit(0)))

    return F.when(n > window, _let(starts, of)).otherwise(F.lit(0)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _count_of(chars: str) -> Callable[[Column], Column]:
    """Characters of a text that are in ``chars``."""
    def count(text: Column) -> Column:
        t = F.coalesce(text, F.lit(""))
        return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    return count


#: Measures by name, each an expression of the whole text.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("bigint"),
    "word_chars": lambda t: F.length(F.translate(F.coalesce(t, F.lit("")), SPACE, "")).cast("bigint"),
    "n_symbols": _count_of(SYMBOLS),
    "n_lines": lambda t: F.size(_lines(t)).cast("bigint"),
    "n_dup_lines": lambda t: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    "n_repeat_words": lambda t: repeated_words(words(t)),
    "n_stutters": lambda t: _let(words(t), lambda w: F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x))).cast("bigint"),
    "n_upper": _count_of(UPPER),
    "n_lower": _count_of(LOWER),
    "n_digits": _count_of(DIGITS),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``reject`` holds for its measures in ``needs`` (columns, or plain numbers in tests)."""
    name: str
    needs: tuple[str, ...]
    reject: Callable[[Any], Any]


#: Whole numbers only, so that every engine decides alike.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 10 > m["n_words"] * 3),
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20)),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: (m["n_dup_lines"] > 2) & (m["n_dup_lines"] * 10 > m["n_lines"] * 3)),
    Rule("stutters", ("n_words", "n_stutters"), lambda m: m["n_stutters"] * 5 > m["n_words"]),
    Rule("shouting", ("n_upper", "n_lower"), lambda m: m["n_upper"] > m["n_lower"]),
    Rule("digits", ("word_chars", "n_digits"), lambda m: m["n_digits"] * 10 > m["word_chars"] * 3),
)


def measures(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the ``BASE`` measures of every text, and the columns' names by measure."""
    names = {m: free_name(docs, m) for m in BASE}
    w = free_name(docs, "_words")
    out = docs.withColumn(w, words(F.col(text)))
    fast = {"n_words": F.size(w).cast("bigint"), "n_repeat_words": repeated_words(F.col(w))}
    return out.select(*[F.col(c) for c in docs.columns],
                      *[(fast[m] if m in fast else MEASURES[m](F.col(text))).alias(n) for m, n in names.items()]), names


def verdict(rule: Rule, text: Column, have: dict[str, Column]) -> Column:
    """Whether ``rule`` rejects a text; measures in ``have`` are taken from there, the others are evaluated."""
    values = F.struct(*[(have[m] if m in have else MEASURES[m](text)).alias(m) for m in rule.needs])
    return _let(values, rule.reject)


def cheapest_first(patterns: dict[int, int], costs: Sequence[float]) -> list[int]:
    """Order of rules: always the one that rejects most of what is left, per cost; ties by place.

    ``patterns`` counts sample rows by the set of rules that reject them (bit k: rule k)."""
    left, todo, order = dict(patterns), list(range(len(costs))), []
    while todo:
        gain = {k: sum(n for p, n in left.items() if p >> k & 1) / max(costs[k], 1e-9) for k in todo}
        best = max(todo, key=lambda k: (gain[k], -k))
        left = {p: n for p, n in left.items() if not p >> best & 1}
        todo.remove(best)
        order.append(best)
    return order


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
         seed: int = 11) -> list[Rule]:
    """The rules in cascade order, from costs and rejections on a sample of ``docs``."""
    n = docs.count()
    if not n:
        return list(rules)
    # on one stage table, so that a rule's time is its own and not that of reading the corpus
    sample = stage(docs.select(F.col(text).alias("text")).where(F.rand(seed) < min(1.0, sample_rows / n)))
    each = [verdict(r, F.col("text"), {}) for r in rules]

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(2):                                    # the first run also compiles
            begin = time.perf_counter()
            sample.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - begin)
        return best

    bare = seconds(F.length("text"))
    costs = [max(seconds(c) - bare, 1e-3) for c in each]
    bits = sum((c.cast("int") * (1 << k) for k, c in enumerate(each)), F.lit(0))
    counts = {r["p"]: r["n"] for r in sample.groupBy(bits.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [rules[k] for k in cheapest_first(counts, costs)]


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", have: dict[str, str] | None = None,
            order: Sequence[Rule] | None = None) -> tuple[DataFrame, str, str]:
    """``docs`` with the first rule (in cascade order) that rejects each document, null where none does, and whether
    it is kept; and the names of the two columns.  ``have`` names columns that hold measures already."""
    at = {m: F.col(c) for m, c in (have or {}).items()}
    by, kept = free_name(docs, "rejected_by"), free_name(docs, "kept")
    chain = F.lit(None).cast("string")
    for rule in reversed(order or plan(docs, rules, text)):
        chain = F.when(verdict(rule, F.col(text), at), F.lit(rule.name)).otherwise(chain)
    out = docs.withColumn(by, chain)
    return out.withColumn(kept, F.col(by).isNull()), by, kept


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document: doc_id, the ``BASE`` measures, base_failed, rejected_by, kept."""
    rows = docs.select("doc_id", "text")
    order = plan(rows)
    out, names = measures(rows)
    out, by, kept = cascade(out, have=names, order=order)
    failed = [r.reject({m: F.col(names[m]) for m in r.needs}) for r in RULES[:2]]
    return out.select("doc_id", *names.values(), (failed[0] | failed[1]).alias("base_failed"), by, kept)


def oracle_sql() -> str:
    """The query's digest of the same result in DuckDB text."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
x AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) > {WINDOW})),
a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM x) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM a) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR 5 * n_stutters > n_words OR n_upper > n_lower OR 10 * n_digits > 3 * word_chars) AS kept
FROM b"""
