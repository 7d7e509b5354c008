"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred on the mean, set to length one, padded with zeros to ``code_bits`` dimensions and turned
by a random rotation; the signs are packed into bits.  With two scalars per vector (its distance from the
mean and the inner product of the turned vector with its own code) the inner product of a query with a
code estimates the inner product with the vector, without bias, and the spread of that estimate is known:
every estimate comes with a bound of ``SIGMAS`` standard deviations.

Every row is indexed.  Queries and codes meet in blocks (``ROWS`` codes, ``QUERIES`` queries a task); in a
block, a candidate is reranked on its original vector, in double precision, only if its upper bound
reaches the ``k``-th largest lower bound seen there.  Blocks hand on their ``k`` best per query, and the
best of these are the result.  A true neighbour is lost only where its estimate errs by more than the
bound; recall against brute force is measured in the tests.

Defined results: vectors that are null, of another length than most, zero or with null or non-finite
components take no part, nor does a null vec_id; of rows that repeat a vec_id the vector that sorts first
counts; ties go to the smaller vec_id; a query alone has no neighbours; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankwear.llm.common import stage

CODE_BITS = 512
SIGMAS = 2.5
ROWS, QUERIES = 8192, 2048   # of one block
_STEP = 256                  # queries estimated at once


def rotation(bits: int, dim: int, seed: int = 7) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of ``bits`` dimensions (zeros padded behind play no part)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one per vec_id, all of one length."""
    v = F.col("embedding").cast("array<double>")
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .where(F.exists("v", lambda x: x != 0)))
    usual = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "d").limit(1).collect())
    rows = rows.where(F.size("v") == (usual[0]["d"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def encode(v: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, distance from the mean, inner product of each turned unit vector with its code."""
    c = v - mean
    dist = np.sqrt((c * c).sum(axis=1))
    unit = (c / np.where(dist, dist, 1)[:, None]) @ turn
    return np.packbits(unit > 0, axis=1), dist, np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])


def _dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components (equal vectors score alike)."""
    out = np.zeros(len(rows))
    for d in range(len(q)):
        out += rows[:, d] * q[d]
    return out


def search_block(ids: np.ndarray, v: np.ndarray, bits: np.ndarray, dist: np.ndarray, own: np.ndarray, mean: np.ndarray,
                 turn: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, sigmas: float = SIGMAS) -> tuple[list, int]:
    """The ``k`` best (query_id, vec_id, score) of one block per query, and how many vectors were reranked."""
    n_bits = turn.shape[1]
    code = (np.unpackbits(bits, axis=1)[:, :n_bits].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(n_bits))
    # a vector is mean + dist * unit; <unit, q> is estimated by <code, turned q> / own
    scale = np.where(own > 0, dist / np.where(own > 0, own, 1), 0)
    spread = dist * np.sqrt(np.maximum(0, 1 - own ** 2) / np.where(own > 0, own, 1) ** 2 / max(1, n_bits - 1))
    base, out, reranked = q @ mean, [], 0
    for s in range(0, len(q), _STEP):
        tq = (q[s:s + _STEP] @ turn).astype(np.float32)
        guess = base[s:s + _STEP, None] + (tq @ code.T).astype(float) * scale
        err = sigmas * np.sqrt((q[s:s + _STEP] ** 2).sum(axis=1))[:, None] * spread + 1e-6
        for j in range(len(tq)):
            other = ids != qids[s + j]
            low, high = (guess[j] - err[j])[other], (guess[j] + err[j])[other]
            if len(low) > k:
                floor = np.partition(low, len(low) - k)[len(low) - k]
                pick = np.flatnonzero(other)[high >= floor]
            else:
                pick = np.flatnonzero(other)
            score = _dots(v[pick], q[s + j])
            best = np.lexsort((ids[pick], -score))[:k]
            reranked += len(pick)
            out += [(int(qids[s + j]), int(ids[pick[b]]), float(score[b])) for b in best]
    return out, reranked


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, code_bits: int = CODE_BITS, sigmas: float = SIGMAS) -> DataFrame:
    """The ``k`` nearest vectors by inner product of every row where ``is_query`` (on vec_id) holds:
    query_id, rank (from 1), vec_id, score."""
    rows = stage(valid_vectors(vectors))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dim, n = head["d"] or 1, head["n"]
    sums = rows.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array([x or 0.0 for x in sums])
    bits = max(code_bits, dim)
    turn = rotation(bits, dim)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((mean, turn))                  # dim x code_bits numbers

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = shared.value
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            code, dist, own = encode(v, mean, turn)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array([x.tobytes() for x in code], pa.binary()),
                                   pa.array(dist), pa.array(own)], ["vec_id", "v", "code", "dist", "own"])

    codes = rows.mapInArrow(index, "vec_id bigint, v array<double>, code binary, dist double, own double")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    nq = queries.count()
    rb, qb = max(1, -(-n // ROWS)), max(1, -(-nq // QUERIES))
    left = (codes.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(rb)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qb - 1).cast("bigint")))))
    right = (queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)))
             .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rb - 1).cast("bigint")))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        mean, turn = shared.value
        code = np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1)
        found, _ = search_block(a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), code, a["dist"].to_numpy(),
                                a["own"].to_numpy(), mean, turn, b["query_id"].to_numpy(), np.stack(b["q"].to_numpy()), k, sigmas)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    # every block hands on k rows per query; the group limit cuts them again before the shuffle
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
