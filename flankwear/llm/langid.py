"""Language identification by mixtures: EM over n-gram likelihoods, language set by penalised likelihood.

A text is lower-cased; letters keep their code points and everything else is a blank.  Its units are the
hashed letter trigrams (word borders included).  Training counts trigrams per language on a bounded
sample of labelled rows (about ``FIT_ROWS`` documents per language, by a hash of id and text; rows that repeat
both count once) in Spark tasks; the model is a table of ``BUCKETS`` smoothed log probabilities for each of the
``MAX_LANGS`` most frequent labels (ties by name; rarer labels are never predicted), of fixed size.

For each document EM finds the proportions of the languages that explain its trigrams best.  Starting from
the best single language, the next one in order of its fitted proportion is taken in as long as the log
likelihood grows by more than ``PENALTY`` times the logarithm of the number of trigrams; so a few foreign
words do not count as a language, a passage does.  Texts of any length are reduced to trigram counts first.

Defined results: null text or text without a letter is ``und`` with score 0 (as is every text when nothing
is labelled); ties go to the language that sorts first; repeated rows are predicted alike, one row each; a
null doc_id is never held out and is carried along.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import slices

FIT_ROWS = 4_000         # labelled documents per language that train the model, on average
MAX_LANGS = 128          # labels that get a model, most frequent first
DRAWS = 1 << 60          # a row is drawn by a hash below its label's share of so many
BUCKETS = 1 << 15
SMOOTH = 0.5             # added to every trigram count
PENALTY = 4.0            # log-likelihood gain per language, times log(number of trigrams)
EM_ROUNDS = 40
MIN_SHARE = 0.35         # proportion the main language of a kept document has at least
_KIND: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters, blank otherwise."""
    if not _KIND:
        a = np.arange(0x110000, dtype=np.uint32)
        ok = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _KIND.append(np.where(ok, a, np.uint32(32)))
    return _KIND[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a whole text, or None without a letter."""
    if not text:
        return None
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[c]
    c = c[(c != 32) | np.r_[True, c[:-1] != 32]]               # runs of blanks count as one
    if len(c) < 3:
        return None
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    h = h[c[1:-1] != 32]                                       # the middle is a letter
    n = np.bincount((h ^ (h >> np.uint32(15))) % BUCKETS, minlength=BUCKETS)
    idx = np.flatnonzero(n)
    return idx, n[idx].astype(np.float64)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def language_model(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (language, bucket) from the labelled rows where ``train`` holds."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       train.alias("__train")).where("__train and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, int(min(1.0, FIT_ROWS / sizes[k]) * DRAWS))]) if names else None
    counts = np.zeros((len(names), BUCKETS))
    if names:
        draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(DRAWS))
        sample = (rows.where(draw < share[F.col("lang")]).withColumn("__th", F.xxhash64("text"))
                  .dropDuplicates(["doc_id", "lang", "__th"]).select("text", "lang"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in slices(batches):
                for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    if (g := trigrams(t)) is not None:
                        total.setdefault(k, np.zeros(BUCKETS))[g[0]] += g[1]
            for k, v in total.items():
                at = np.flatnonzero(v)
                yield pa.record_batch([pa.array([k] * len(at)), pa.array(at, pa.int32()), pa.array(v[at])], ["lang", "b", "n"])

        at = {k: i for i, k in enumerate(names)}
        # BUCKETS counts per language, whatever the corpus size
        table = sample.mapInArrow(count, "lang string, b int, n double").groupBy("lang", "b").agg(F.sum("n").alias("n"))
        rows_ = table.toArrow()
        counts[[at[k] for k in rows_["lang"].to_pylist()], rows_["b"].to_numpy()] = rows_["n"].to_numpy()
    counts += SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def mixture(grams: tuple[np.ndarray, np.ndarray], logp: np.ndarray) -> np.ndarray:
    """Proportion of each language in a text; 0 for those outside the selected set."""
    idx, n = grams
    lp = logp[:, idx]                                          # language, trigram
    best = lp.max(axis=0)
    like = np.exp(lp - best)
    single = lp @ n

    def em(members: np.ndarray) -> tuple[np.ndarray, float]:
        p, k = np.full(len(members), 1 / len(members)), like[members]
        for _ in range(EM_ROUNDS):
            mix = p @ k
            new = p * (k @ (n / mix)) / n.sum()
            done = np.abs(new - p).max() < 1e-4
            p = new
            if done:
                break
        return p, float(n @ np.log(p @ k) + n @ best)

    every = np.arange(len(logp))
    p, _ = em(every)
    first = int(single.argmax())
    out = np.zeros(len(logp))
    out[first] = 1.0
    chosen, value = [first], float(single[first])
    for k in sorted(every, key=lambda k: (-p[k], k)):
        if k == first or p[k] < 0.02:
            continue
        q, more = em(np.array(sorted([*chosen, k])))
        if more - value <= PENALTY * np.log(n.sum() + 1):
            break
        chosen, value = sorted([*chosen, int(k)]), more
        out[:] = 0
        out[chosen] = q
    return out


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (proportion of that language), languages and proportions
    (the selected set, largest first).  Learns from text and non-null lang where ``train`` holds."""
    names, logp = language_model(docs, F.lit(True) if train is None else train)
    shared = docs.sparkSession.sparkContext.broadcast((names, logp))   # BUCKETS values per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value
        for batch in slices(batches):
            pred, score, langs, shares = [], [], [], []
            for t in batch.column("text").to_pylist():
                g = trigrams(t) if names else None
                if g is None:
                    pred.append("und"), score.append(0.0), langs.append([]), shares.append([])
                    continue
                p = mixture(g, logp)
                order = [k for k in sorted(range(len(names)), key=lambda k: (-p[k], k)) if p[k] > 0]
                pred.append(names[order[0]]), score.append(float(min(1.0, p[order[0]])))
                langs.append([names[k] for k in order]), shares.append([float(p[k]) for k in order])
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                                  ["doc_id", "lang_pred", "score", "languages", "proportions"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id bigint, lang_pred string, score double, languages array<string>, "
                                    "proportions array<double>")


def drop_unidentified(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """Rows of ``docs`` with a main language of proportion ``MIN_SHARE`` or more, all columns unchanged; texts
    without letters and mixtures without a main language go.  Without any labelled row nothing is rejected
    but texts without letters."""
    names, logp = language_model(docs, F.lit(True) if train is None else train)
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for batch in slices(batches):
            grams = [trigrams(t) for t in batch.column("text").to_pylist()]
            keep = [g is not None and (not len(logp) or bool(mixture(g, logp).max() >= MIN_SHARE)) for g in grams]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
