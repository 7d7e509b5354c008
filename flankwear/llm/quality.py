"""Quality classifier by weak labels: overlapping heuristics, their accuracies by EM, a hashed linear scorer.

1. Eight heuristic labellers look at a whole text and vote good (2), bad (1) or abstain (0).  The votes of
   a document are one of 3^8 patterns, so Spark counts patterns over the whole corpus and only that table
   (at most 6,561 rows, whatever the corpus size) reaches the driver.
2. Expectation-maximisation on the pattern counts estimates, for every labeller, how often it casts each
   vote on good and on bad documents, and the share of good ones; labellers that overlap on a document
   correct each other.  Every pattern gets the posterior probability of being good.
3. A bounded sample (``FIT_ROWS`` distinct texts by their hash, in groups of ``PART_ROWS``) with posterior
   labels trains linear scorers over hashed byte trigrams and hashed bands of text statistics, one per
   group; their weights are averaged.  The scorer then scores every whole text.

The table ``labels`` is never used: it only measures the result in the tests.

Defined results: null text counts as empty; a text without words gets no vote, score 0 and is rejected;
repeated rows are scored alike, one row each; a null doc_id is carried along; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import slices

FIT_ROWS, PART_ROWS = 12_000, 2_000   # bound of the training sample, and rows of each group that trains by itself
DRAWS = 1 << 60                       # a text is drawn by a hash below its share of so many
BUCKETS = 1 << 15                     # hashed features
KEEP_SCORE = 0.5
FALSE_ALARM = 0.003                   # bound on P(labeller votes bad | good): its bad votes need extreme values
STATS = ("repeat", "distinct", "upper", "symbol", "table", "lines", "digit", "length")
#: Per statistic: vote good up to the first bound, bad from the second on ("distinct" and "length" the other way round).
BOUNDS = {"repeat": (0.02, 0.2), "distinct": (0.12, 0.05), "upper": (0.25, 0.5), "symbol": (0.03, 0.12),
          "table": (0.02, 0.2), "lines": (0.2, 0.6), "digit": (0.1, 0.6), "length": (2.5, 1.6)}
_FALLING = ("distinct", "length")
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_LETTER = np.r_[65:91, 97:123, 128:256]
_SYMBOL = np.array([c for c in range(33, 127) if chr(c) in "!#$%&*+<=>@^_`{|}~\\"])


def text_stats(raw: bytes) -> np.ndarray | None:
    """The eight statistics of a whole text, or None without words."""
    words = raw.split()
    if not words:
        return None
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, ink = len(words), max(1, int(c[33:].sum()))
    letters = max(1, int(c[_LETTER].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array([
        sum(map(eq, words, words[1:])) / n,                    # words that repeat the one before
        len(set(words)) / min(n, 400) if n >= 40 else 1.0,     # distinct words, of a text long enough
        c[_UPPER].sum() / letters if letters > 20 else 0.0,
        c[_SYMBOL].sum() / ink,
        c[124] / n,                                            # column bars
        1 - len(set(lines)) / len(lines),                      # repeated lines
        c[_DIGIT].sum() / ink,
        ink / n])                                              # mean word length in bytes


def votes(stats: np.ndarray | None) -> list[int]:
    """Vote of each labeller: 2 good, 1 bad, 0 abstains."""
    if stats is None:
        return [0] * len(STATS)
    out = []
    for name, v in zip(STATS, stats):
        good, bad = BOUNDS[name]
        if name in _FALLING:
            v, good, bad = -v, -good, -bad
        out.append(2 if v <= good else 1 if v >= bad else 0)
    return out


def pattern(v: list[int]) -> int:
    return sum(x * 3 ** k for k, x in enumerate(v))


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """EM over vote patterns: P(vote | class) per labeller (labeller, class, vote), P(good), posterior by pattern.

    Classes are 0 bad, 1 good.  The estimates carry a prior worth a hundredth of the corpus: a bad document
    has some symptoms and looks sound to the other labellers, a good one rarely has any; so a corpus
    without bad documents is not split in two.  ``FALSE_ALARM`` bounds bad votes on good documents.
    """
    pats = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in pats], float)
    v = (pats[:, None] // 3 ** np.arange(len(STATS))) % 3
    hot = np.eye(3)[v]                                         # pattern, labeller, vote
    bad, good = (v == 1).sum(1), (v == 2).sum(1)
    post = np.where(bad == 0, 0.98, np.where(bad >= 2, 0.02, 0.1))
    prior = np.array([[0.1, 0.3, 0.6], [0.09, 0.01, 0.9]]) * max(1.0, n.sum()) / 100   # class; abstain, bad, good
    theta, share = None, 0.9
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])               # class, pattern
        theta = np.einsum("cp,plv->lcv", w, hot) + prior[None]
        theta /= theta.sum(axis=2, keepdims=True)
        theta[:, 1, 1] = np.minimum(theta[:, 1, 1], FALSE_ALARM)
        share = (w[1].sum() + 9) / (n.sum() + 10)
        like = np.einsum("plv,lcv->pc", hot, np.log(theta)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -60, 60)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return theta, share, dict(zip(pats.tolist(), post.tolist()))


def features(raw: bytes, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text: byte trigrams by share, statistics by band; both parts have length one."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    idx, val = np.empty(0, np.int64), np.empty(0)
    if len(b) >= 3:
        h = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B))) + b[2:] * np.uint32(0xC2B2AE35)
        c = np.bincount((h ^ (h >> np.uint32(15))) % (BUCKETS - 256), minlength=BUCKETS - 256)
        idx = np.flatnonzero(c)
        val = np.sqrt(c[idx])
        val /= np.sqrt((val * val).sum())
    band = np.minimum(15, (np.log1p(np.maximum(0, stats) * 100) * 3).astype(np.int64))
    return np.r_[idx, BUCKETS - 256 + 16 * np.arange(len(STATS)) + band], np.r_[val, np.full(len(STATS), len(STATS) ** -0.5)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 6, steps: int = 6000) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer on soft labels; AdaGrad in row order, at least
    ``epochs`` rounds and ``steps`` updates."""
    epochs = max(epochs, -(-steps // max(1, len(rows))))
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    for _ in range(epochs):
        for (i, x), t in zip(rows, target):
            p = 1 / (1 + np.exp(-(w[i] @ x + w[-1])))
            d = (p - t) * x + 1e-6 * w[i]
            g[i] += d * d
            w[i] -= 0.5 * d / np.sqrt(g[i])
            g[-1] += (p - t) ** 2
            w[-1] -= 0.5 * (p - t) / np.sqrt(g[-1])
    return w


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def quality_model(docs: DataFrame) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """(P(vote | class) per labeller, posterior by vote pattern, weights of the scorer)."""
    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([pa.array([pattern(votes(text_stats(_raw(t)))) for t in batch.column("text").to_pylist()],
                                            pa.int32())], ["pattern"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = {r["pattern"]: r["n"] for r in texts.mapInArrow(cast_votes, "pattern int").groupBy("pattern")
              .agg(F.count(F.lit(1)).alias("n")).collect()}    # at most 3^8 rows
    theta, _, post = fit_labellers(counts)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, target = [], []
        for t in pdf.sort_values("order")["text"]:
            raw = _raw(t)
            if (s := text_stats(raw)) is not None:
                rows.append(features(raw, s))
                target.append(post[pattern(votes(s))])
        return pd.DataFrame({"w": [train(rows, np.array(target)).tolist()], "rows": [len(rows)]})

    # the sample: hashes below the share that makes FIT_ROWS distinct texts on average; a repeated text counts once
    texts = texts.withColumn("order", F.xxhash64("text", F.lit(6)))
    distinct = texts.select("order").distinct().count()
    share = min(1.0, FIT_ROWS / max(1, distinct))
    h = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(DRAWS))
    sample = texts.where(h < int(share * DRAWS)).dropDuplicates(["order"])
    groups = max(1, -(-min(FIT_ROWS, distinct) // PART_ROWS))
    fitted = sample.groupBy(F.pmod("order", F.lit(groups)).alias("part")).applyInPandas(fit, "w array<double>, rows long")
    parts = [(np.array(r["w"]), r["rows"]) for r in fitted.collect()]
    total = sum(n for _, n in parts)
    if not total and share < 1:
        raise RuntimeError("the drawn sample holds no text with words; raise FIT_ROWS")
    w = sum(w * n for w, n in parts) / total if total else np.zeros(BUCKETS + 1)
    return theta, post, w


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bad, n_good (votes), posterior (of the vote pattern), score (of the
    linear scorer, 0 to 1), keep (score of ``KEEP_SCORE`` or more)."""
    _, post, w = quality_model(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((post, w))          # fixed size: 3^8 posteriors, BUCKETS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, w = shared.value
        for batch in slices(batches):
            bad, good, p, s = [], [], [], []
            for t in batch.column("text").to_pylist():
                raw = _raw(t)
                stats = text_stats(raw)
                v = votes(stats)
                bad.append(v.count(1)), good.append(v.count(2))
                p.append(post.get(pattern(v), 0.5) if stats is not None else 0.0)
                if stats is None:
                    s.append(0.0)
                else:
                    i, x = features(raw, stats)
                    s.append(float(1 / (1 + np.exp(-np.clip(w[i] @ x + w[-1], -60, 60)))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(bad, pa.int32()), pa.array(good, pa.int32()),
                                   pa.array(p, pa.float64()), pa.array(s, pa.float64()),
                                   pa.array([x >= KEEP_SCORE for x in s], pa.bool_())],
                                  ["doc_id", "n_bad", "n_good", "posterior", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, n_bad int, n_good int, posterior double, score double, keep boolean")


def drop_bad(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score of ``KEEP_SCORE`` or more, all columns unchanged; no shuffle of texts."""
    _, _, w = quality_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            keep = []
            for t in batch.column("text").to_pylist():
                raw = _raw(t)
                stats = text_stats(raw)
                i, x = (None, None) if stats is None else features(raw, stats)
                keep.append(stats is not None and bool(1 / (1 + np.exp(-np.clip(w[i] @ x + w[-1], -60, 60))) >= KEEP_SCORE))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
