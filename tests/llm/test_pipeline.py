import pytest

import corpus_pipeline as cp
from flankwear.llm.common import table, tokenizer_path
from flankwear.llm.decontam import contaminated
from flankwear.llm.langid import identify
from flankwear.llm.near_dup import near_duplicates
from flankwear.llm.quality import classify


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "language_id", "near_dedup", "decontamination", "packing"]


def test_each_stage_on_its_own_input(spark, tmp_path):
    """Rows that each stage keeps, against the operator's decisions on the same input."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(path := f"{tmp_path}/{k}")
        out = spark.read.parquet(path)
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "packing":
            assert sorted({r["doc_id"] for r in out.collect()}) == ids
            break
        assert out.columns == docs.columns
        if name == "quality_classifier":
            want = {r["doc_id"] for r in classify(docs).where("keep").collect()}
        elif name == "language_id":
            want = {r["doc_id"] for r in identify(docs).where("score >= 0.35").collect()}
        elif name == "near_dedup":
            want = {r["doc_id"] for r in near_duplicates(docs, width=5).where("kept").collect()}
        else:
            want = set(ids) - {r["doc_id"] for r in contaminated(docs, table(spark, sf, "benchmark")).collect()}
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
        assert len(want) > 0.8 * len(ids)
        docs = out


@pytest.mark.parametrize("rows", [[], "edge"])
def test_run_on_odd_tables(spark, tmp_path, rows):
    sound = "A plain sentence of several words, and one more that ends here with number {}."
    leak = "It was a dark night when the seven sailors found an old map of the far northern islands."
    if rows:
        rows = [(1, None, "en"), (2, "", "en"), (None, sound.format(1), None), (3, sound.format(2), "en"), (3, sound.format(2), "en"),
                (4, "spam " * 50000, None), (5, sound.format(3) + " " + leak, "en")] \
            + [(10 + i, " ".join(f"{w}{chr(97 + i % 26)}" for w in sound.split()) + f" and then {i} more came by.", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string") \
        .selectExpr("*", "'s' AS source", "1L AS n_chars", "2 AS kept", "'x' AS __n", "3 AS length", "4 AS score")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    if not rows:
        assert out == []
    else:
        assert not {1, 2, 4, 5} & {*ids} and ids.count(3) == 1 and None in ids
        assert out[0]["sequence_id"] is not None and tokenizer_path()
