"""File sources (S01-S12).  Every reader is a plain ``spark.read`` with an
explicit schema where the reference relies on position, plus ``_metadata``
columns for keys that live in file names."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankwear.operators.signal_stats import CHANNELS
from flankwear.session import write_stage

SIGNAL_SCHEMA = T.StructType([T.StructField(c, T.DoubleType(), True) for c in CHANNELS])
# Name fragments that mark non-signal files.
SKIP_NAMES = r"(?i)(wear|features)"
PASS_FILE = r"c_(\d+)_(\d+)\.csv$"


def first_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, name, header): the first line of every file, without its carriage return or byte-order mark.

    Every file block is a task of its own that stops after its first few lines; blocks that don't begin a file are
    dropped.  The result (one row per file) is written once."""
    r = spark.read.option("recursiveFileLookup", "true")
    lines = (r.option("pathGlobFilter", glob) if glob else r).text(path if isinstance(path, str) else list(path))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
                         F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("header"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    # no two files share a task, and a task reads a handful of lines ahead
    alone = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
             "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    before = {k: spark.conf.get(k, None) for k in alone}
    try:
        for k, v in alone.items():
            spark.conf.set(k, v)
        out = write_stage(lines.mapInArrow(first, "file string, name string, at long, header string").where("at = 0"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out.select("file", "name", F.regexp_replace("header", "^\ufeff|\r$", "").alias("header"))


def _layouts(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> dict[str, list[str]]:
    """Header line -> files that start with it (file names only, as Spark's own listing holds them)."""
    out: dict[str, list[str]] = {}
    for r in first_lines(spark, path, glob).orderBy("file").collect():
        out.setdefault(r["header"], []).append(r["file"])
    return out


def _by_name(spark: SparkSession, files: dict[str, list[str]], infer: bool = False) -> list[DataFrame]:
    """One frame per distinct header, so files with another column order are never read by position."""
    return [spark.read.option("header", "true").option("inferSchema", str(infer).lower()).csv(names) for names in files.values()]


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_signals(spark: SparkSession, path: str, long: bool = True) -> DataFrame:
    """S01 + S02 + rule R1: recursive headerless CSV scan with the 7 named channels.

    Files named like wear / feature tables are pruned by name before they are read;
    ``i`` is the row index inside each file.  Samples arrive in file order, so the
    index is the row's place in its block plus the rows of the file's earlier blocks
    (a small table of counts): nothing is sorted.  The parsed rows are staged once,
    so both uses see the same ids.  NaN becomes NULL.  ``long`` unpivots to
    ``(…, channel, x)``.
    """
    df = (spark.read.schema(SIGNAL_SCHEMA).option("recursiveFileLookup", "true").option("header", "false").csv(path)
          .where(~F.col("_metadata.file_name").rlike(SKIP_NAMES))
          .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
                  F.monotonically_increasing_id().alias("_rid")))
    df = write_stage(df)
    blocks = df.groupBy("file", "_blk").agg(F.min("_rid").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    df = (df.join(blocks, ["file", "_blk"]).withColumn("i", F.col("_off") + F.col("_rid") - F.col("_r0"))
          .select(*CHANNELS, "file", "i"))
    for c in CHANNELS:
        df = df.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    if not long:
        return df
    return df.unpivot(["file", "i"], CHANNELS, "channel", "x")


def with_pass_key(df: DataFrame, file: str = "file") -> DataFrame:
    """``c_<tool>_<pass>.csv`` -> tool ``c<tool>``, passe int; other names dropped."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    t = F.regexp_extract(name, PASS_FILE, 1)
    p = F.regexp_extract(name, PASS_FILE, 2).try_cast("int")
    return df.withColumn("tool", F.concat(F.lit("c"), t)).withColumn("passe", p).where((t != "") & p.isNotNull())


def with_tool_dir(df: DataFrame, file: str = "file", out: str = "tool_dir") -> DataFrame:
    """Tool key from the parent directory."""
    return df.withColumn(out, F.element_at(F.split(F.col(file), "/"), -2))


def read_wear(spark: SparkSession, path: str, header: bool = False,
              required: Sequence[str] = ("cut", "flute_1", "flute_2", "flute_3")) -> DataFrame:
    """Wear files -> ``(tool, passe, vb1, vb2, vb3)`` (raw units).

    Headerless: coerce, drop all-empty rows (a text header row becomes empty and
    disappears); each file's own number of columns counts: 2 = (pass, vb), 4 or
    more = (pass, vb1..3), other files are skipped.  Headed: files are read by
    name, in any column order; a file without the required columns is skipped.
    Tool = file name without ``_wear``.
    """
    empty = spark.createDataFrame([], "tool string, passe int, vb1 double, vb2 double, vb3 double")
    files = _layouts(spark, path, "*wear*.csv")
    groups: dict[tuple[str, ...], list[DataFrame]] = {}
    if header:
        have = {h: [c.strip().strip('"') for c in h.split(",")] for h in files}
        good = {h: f for h, f in files.items() if set(required[:4]) <= set(have[h])}
        groups[tuple(required[:4])] = _by_name(spark, good)
    else:
        for h, names in files.items():
            n = len(h.split(","))
            if n == 2 or n >= 4:
                cols = [f"_c{i}" for i in range(min(n, 4))]
                d = spark.read.option("header", "false").schema(", ".join(f"_c{i} string" for i in range(n))).csv(names)
                groups.setdefault(tuple(cols), []).append(d)
    out = [empty]
    for cols, frames in groups.items():
        for d in frames:
            tool = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1), "_wear$", "")
            num = [F.expr(f"try_cast(trim(`{c}`) AS double)").alias(f"_n{i}") for i, c in enumerate(cols)]
            d = d.select(tool.alias("tool"), *num).na.drop("all", subset=[f"_n{i}" for i in range(len(cols))])
            vb = [F.col(f"_n{i}") if i < len(cols) else F.lit(None).cast("double") for i in (1, 2, 3)]
            out.append(d.select("tool", F.col("_n0").cast("int").alias("passe"), *[v.alias(f"vb{i + 1}") for i, v in enumerate(vb)]))
    return _stack(out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with inferred schema, or parquet by extension."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def read_experiments(spark: SparkSession, glob: str) -> DataFrame:
    """Many headed experiment CSVs, stacked by column name (files may order or hold columns differently);
    ``exp_id`` from the ``_NN.`` in the file name."""
    frames = _by_name(spark, _layouts(spark, glob), infer=True)
    if not frames:
        raise FileNotFoundError(f"no experiment file in {glob}")
    exp = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.", 1).try_cast("int")
    return _stack([d.withColumn("exp_id", exp) for d in frames])


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Stack the files that exist (by name, missing columns NULL); none -> error.  Only absent paths are
    skipped; a file that is there and can't be read raises."""
    present = []
    for p in paths:
        try:
            spark.read.text(p)           # resolves the path, reads nothing
            present.append(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not present:
        raise FileNotFoundError("none of the input files exist")
    return _stack([read_table(spark, p) for p in present])


def read_programs(spark: SparkSession, programs: dict[str, str]) -> DataFrame:
    """Parsed-program tables without the unnamed index column, tagged by program."""
    out = None
    for name, p in programs.items():
        d = read_table(spark, p)
        d = d.drop(*[c for c in d.columns if c in ("_c0", "Unnamed: 0") or c == ""]).withColumn("program", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def classify_source(schema: T.StructType) -> str:
    """Raw signals (6-7 numeric unnamed columns), feature table (>10 sensor-prefixed
    columns), mixed table, or unknown -- decided from the schema alone."""
    names = [f.name for f in schema.fields]
    numeric = [f for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(names) in (6, 7) and len(numeric) == len(names):
        return "raw_signals"
    sensor = [n for n in names if n.lower().startswith(("force_", "vib_", "ae_"))]
    if len(sensor) > 10:
        return "feature_table"
    if numeric and len(numeric) < len(names):
        return "mixed_table"
    return "unknown"


def probe_source(spark: SparkSession, path: str) -> str:
    """S11 on files: the first line tells whether there is a header; only then are types looked at, in the first
    file by name.  Wear and feature files beside raw signals do not count."""
    firsts = first_lines(spark, path)
    raw = firsts.where(~F.col("name").rlike(SKIP_NAMES))
    first = (raw if raw.limit(1).count() else firsts).orderBy("file").first()
    if first is None:
        return "unknown"
    cells = [c.strip().strip('"') for c in first["header"].split(",")]

    def number(c: str) -> bool:
        try:
            float(c)
        except ValueError:
            return False
        return True

    if all(map(number, cells)):          # no header: raw signals or unnamed numbers
        return classify_source(T.StructType([T.StructField(f"_c{i}", T.DoubleType()) for i in range(len(cells))]))
    kind = classify_source(spark.read.option("header", "true").option("inferSchema", "true").csv(first["file"]).schema)
    return "unknown" if kind == "raw_signals" else kind      # raw signals have no header


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON result / profile documents (one per line or multi-line)."""
    return spark.read.option("multiLine", "true").json(path)


def profile_maps_long(profile: DataFrame, column: str = "correlations") -> DataFrame:
    """One row per entry of a map column of a profile / result document."""
    return profile.select(F.explode(F.col(column)).alias("key", "value"))
