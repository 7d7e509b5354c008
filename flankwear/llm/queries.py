"""Registered queries of this subpackage: one ``opN_<name>`` per operator, and the pipeline.

Each query reads its whole table and returns the operator's full result; ``ORACLE`` holds the DuckDB
text where SQL can express it.  The others are tested against brute force in ``tests/llm``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwear.llm import chat, decontam, license_scan, merkle, quality_rules
from flankwear.llm.ann import nearest
from flankwear.llm.common import table, tokenizer_path
from flankwear.llm.decontam import contaminated
from flankwear.llm.html_text import extract_text
from flankwear.llm.langid import held_out, identify
from flankwear.llm.near_dup import near_duplicates
from flankwear.llm.packing import pack
from flankwear.llm.quality import classify
from flankwear.llm.repair import repair_damaged
from flankwear.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=0.8)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items, with the best stretch of each pair."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op10_benchmark_decontamination"] = decontam.oracle_sql()


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, linear score and decision of every document."""
    return classify(table(spark, sf_dir, "documents"))


@query
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the rows of one fold of four train nothing."""
    out = held_out(F.col("doc_id"))
    return identify(table(spark, sf_dir, "documents"), ~out).withColumn("held_out", out)


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


ORACLE["op9_license_scan"] = license_scan.oracle_sql()


@query
def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's perspective; spans as text, counted over the whole rendering."""
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    at = lambda c: (F.col("first_char") + c).cast("string")
    spans = F.transform("spans", lambda x: F.concat(at(x["start"]), F.lit("-"), at(x["end"])))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("n_turns", "n_own", "n_chars", "n_learn")]
    return out.select("conv_id", "part", "participant", *longs, F.array_join(spans, ",").alias("spans"), "rendered")


ORACLE["op7_perspective_rotation"] = chat.oracle_sql()


@query
def op2_rotated_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vec_id divisible by 20, against all rows."""
    out = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Brute force; products are summed in order of the components, as in the operator.
ORACLE["op2_rotated_bit_codes"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS score
      FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20"""


@query
def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to monolithic archives, normalised, and read back by offset."""
    records, _ = archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc_normaliser"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS f FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN f <> page_id OR (f IS NOT NULL AND page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to FROM m"""


@query
def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict of the rule cascade (the rejecting rule depends on measured costs)."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE["op11_rule_cascade"] = quality_rules.oracle_sql()


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash trees over all documents; leaf, proof and check of every one, a seventh of them tampered with."""
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


ORACLE["op12_merkle_manifest"] = merkle.oracle_sql()


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest edits that repair its structure."""
    return repair_damaged(table(spark, sf_dir, "conversations"))
