"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwear.session import write_stage

#: Word characters of the ASCII-aware word rule: letters, digits and every character beyond ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Size of a bitmap filter: 2^21 bits, 256 KB, whatever the table.
BITMAP_LONGS = 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces, so that only a few texts exist as Python strings at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file (installed alike on all machines)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder; readers see fixed files (executor loss is safe)."""
    return write_stage(df)


def ascii_words(text: Column) -> Column:
    """Words of a text (A-Z lower-cased) as an array; null or wordless text gives an empty array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bitmap(hashes: DataFrame, column: str) -> Column:
    """A fixed-size bitmap of a column of hashes as one literal (at most ``BITMAP_LONGS`` rows are collected)."""
    bit = F.pmod(F.col(column), F.lit(BITMAP_LONGS * 64))
    cells = (hashes.select((bit / 64).cast("int").alias("cell"), (bit % 64).cast("int").alias("b"))
             .groupBy("cell").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("v")))
    out = np.zeros(BITMAP_LONGS, np.int64)
    for r in cells.collect():
        out[r["cell"]] = r["v"]
    return F.lit(out)


def in_bitmap(bits: Column, h: Column) -> Column:
    bit = F.pmod(h, F.lit(BITMAP_LONGS * 64))
    cell = F.get(bits, (bit / 64).cast("int"))
    return F.call_function("shiftright", cell, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
