"""Queries: given tables written by the library's sinks and read back by its sources
(S01, S02, S05-S12, K01-K07).  Files go to a folder of their own below the shared
checkpoint folder; the twins read the tables directly."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flankwear.operators import evaluate as ev
from flankwear.operators import profile as pr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.sqlgen import present, r, with_ctes
from flankwear.session import checkpoint_dir
from flankwear.sources import files as fs
from flankwear.sources import sinks as sk


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _named_files(spark, df, path: str, header: bool) -> None:
    """One CSV file per value of the column ``file``, of that name (rows keep their order inside a file)."""
    df.write.mode("overwrite").partitionBy("file").option("header", str(header).lower()).csv(f"{path}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs_ = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs_.mkdirs(hadoop.Path(path))
    for part in fs_.globStatus(hadoop.Path(f"{path}-parts/file=*/part-*")):       # names only, no data
        name = part.getPath().getParent().getName().removeprefix("file=")
        fs_.rename(part.getPath(), hadoop.Path(f"{path}/{name}"))


@register("s01_s02_signal_files", f"""WITH s AS (SELECT 'c' || l_linenumber AS tool, CAST(month(l_shipdate) AS INTEGER) AS passe, l_orderkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_partkey, l_suppkey FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY tool, passe ORDER BY l_orderkey, l_partkey, l_suppkey) - 1 AS i FROM s),
l AS (SELECT tool, passe, i, unnest(['force_x', 'force_y', 'force_z', 'vib_x', 'vib_y', 'vib_z', 'ae']) AS channel,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_partkey::DOUBLE, l_suppkey::DOUBLE, l_orderkey::DOUBLE]) AS x FROM i)
SELECT tool, passe, channel, count(x) AS n, max(i) AS last_i, """ + r("sum(x)", "total") + ", " + r("sum(x * i)", "weighted") + " FROM l GROUP BY 1, 2, 3")
def q_s01(spark, d):
    """Line items as headerless passes (tool: line number, pass: month) beside wear and feature files, which are skipped."""
    li = b.table(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey"]
    rows = li.select(F.concat_ws("_", F.lit("c"), "l_linenumber", F.concat(F.month("l_shipdate").cast("string"), F.lit(".csv"))).alias("file"),
                     *[F.col(c).cast("double").alias(c) for c in cols])
    path = _folder(spark, "signals")
    _named_files(spark, rows.repartition("file").sortWithinPartitions("file", "l_orderkey", "l_partkey", "l_suppkey"), f"{path}/c1", False)
    others = rows.where(F.col("file").startswith("c_1_"))
    _named_files(spark, others.withColumn("file", F.concat(F.lit("c1_wear_"), "file")).repartition("file"), f"{path}/wear", False)
    _named_files(spark, others.withColumn("file", F.concat(F.lit("Features_"), "file")).repartition("file"), f"{path}/features", False)
    sig = fs.with_pass_key(fs.read_signals(spark, path))
    out = sig.groupBy("tool", "passe", "channel").agg(F.count("x").alias("n"), F.max("i").alias("last_i"), F.sum("x").alias("total"),
                                                      F.sum(F.col("x") * F.col("i")).alias("weighted"))
    return present(out)


_WEAR_SUMS = "count(vb1) AS n1, count(vb2) AS n2, count(vb3) AS n3, min(passe) AS first, max(passe) AS last, " + ", ".join(
    r(f"sum(vb{k})", f"s{k}") for k in (1, 2, 3))


def _wear_sums(df):
    return present(df.groupBy("tool").agg(*[F.count(f"vb{k}").alias(f"n{k}") for k in (1, 2, 3)], F.min("passe").alias("first"),
                                          F.max("passe").alias("last"), *[F.sum(f"vb{k}").alias(f"s{k}") for k in (1, 2, 3)]))


@register("s05_wear_files_headerless", with_ctes(b.RAW_WEAR_SQL) + f""", two AS (SELECT tool || 'b' AS tool, passe, vb1, NULL::DOUBLE AS vb2, NULL::DOUBLE AS vb3 FROM raw_wear)
SELECT tool, {_WEAR_SUMS} FROM (SELECT tool, passe, vb1, vb2, vb3 FROM raw_wear UNION ALL SELECT * FROM two) GROUP BY tool""")
def q_s05(spark, d):
    """Wear files of four and of two columns without a header; a file of three columns is skipped."""
    w = b.raw_wear(spark, d)
    path = _folder(spark, "wear")
    for k, cols in (("", ["passe", "vb1", "vb2", "vb3"]), ("b", ["passe", "vb1"]), ("x", ["passe", "vb1", "vb2"])):
        df = w.select(F.concat("tool", F.lit(f"{k}_wear.csv")).alias("file"), *cols)
        _named_files(spark, df.repartition("file"), f"{path}/kind{k}", False)
    return _wear_sums(fs.read_wear(spark, path))


@register("s06_wear_files_headed", with_ctes(b.RAW_WEAR_SQL) + f"SELECT tool, {_WEAR_SUMS} FROM raw_wear GROUP BY tool")
def q_s06(spark, d):
    """Headed wear files whose columns are ordered differently; one without the required columns is skipped."""
    w = b.raw_wear(spark, d).select(F.concat("tool", F.lit("_wear.csv")).alias("file"), F.col("passe").alias("cut"),
                                    *[F.col(f"vb{k}").alias(f"flute_{k}") for k in (1, 2, 3)])
    path = _folder(spark, "wear")
    _named_files(spark, w.where("file < 'c3'").repartition("file"), f"{path}/a", True)
    _named_files(spark, w.where("file >= 'c3'").select("file", "flute_3", "cut", "flute_1", "flute_2").repartition("file"), f"{path}/b", True)
    _named_files(spark, w.where("file < 'c1'").select(F.concat(F.lit("other_"), "file").alias("file"), "cut", "flute_1").repartition("file"), f"{path}/c", True)
    return _wear_sums(fs.read_wear(spark, path, header=True))


@register("s08_experiment_files", "SELECT CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS exp_id, o_orderpriority AS level, n, price FROM (SELECT o_orderpriority, count(*) AS n, "
          + r("sum(o_totalprice)", "price") + " FROM orders GROUP BY 1)")
def q_s08(spark, d):
    """One headed file per order priority, the later ones with their columns in another order, stacked by name."""
    o = b.table(spark, d, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    rows = o.select(F.concat(F.lit("experiment_0"), first, F.lit(".csv")).alias("file"), F.col("o_orderpriority").alias("level"),
                    F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("key"))
    path = _folder(spark, "experiments")
    _named_files(spark, rows.where(first <= "2").repartition("file"), f"{path}/a", True)
    _named_files(spark, rows.where(first > "2").select("file", "key", "price", "level").repartition("file"), f"{path}/b", True)
    back = fs.read_experiments(spark, path)
    return present(back.groupBy("exp_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price")))


@register("s10_programs", "SELECT l_returnflag AS program, count(*) AS n, 2 AS n_columns, " + r("sum(l_quantity)", "quantity") + " FROM lineitem GROUP BY 1")
def q_s10(spark, d):
    """A table per program (return flag) with an unnamed index column, which goes."""
    li = b.table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("Unnamed: 0"), "l_returnflag", "l_linestatus",
                                              F.col("l_quantity").cast("double").alias("l_quantity"))
    path, programs = _folder(spark, "programs"), {}
    for p in [r_["l_returnflag"] for r_ in li.select("l_returnflag").distinct().collect()]:
        sk.write_fused(li.where(F.col("l_returnflag") == p).drop("l_returnflag"), f"{path}/{p}", "csv")
        programs[p] = f"{path}/{p}"
    back = fs.read_programs(spark, programs)
    return present(back.groupBy("program").agg(F.count(F.lit(1)).alias("n"), F.lit(len(back.columns) - 1).alias("n_columns"),
                                               F.sum("l_quantity").alias("quantity")))


@register("s11_source_kinds", "SELECT * FROM (VALUES ('signals', 'raw_signals'), ('numbers', 'unknown'), ('lineitem', 'mixed_table')) t(name, kind)")
def q_s11(spark, d):
    """Kinds of folders of files: raw signals beside a wear file, headed numbers, a mixed table."""
    li = b.table(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey"]
    nums = li.select(F.concat(F.lit("c_1_"), F.month("l_shipdate").cast("string"), F.lit(".csv")).alias("file"), *[F.col(c).cast("double").alias(c) for c in cols])
    path = _folder(spark, "sources")
    _named_files(spark, nums.repartition("file"), f"{path}/signals/c1", False)
    _named_files(spark, nums.select(F.lit("c1_wear.csv").alias("file"), "l_quantity", "l_tax").repartition("file"), f"{path}/signals/wear", True)
    sk.write_fused(nums.drop("file"), f"{path}/numbers", "csv")
    sk.write_fused(li, f"{path}/lineitem", "csv")
    kinds = [(n, fs.probe_source(spark, f"{path}/{n}")) for n in ("signals", "numbers", "lineitem")]
    return spark.createDataFrame(kinds, "name string, kind string")


@register("k02_balanced_table", """WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1)
SELECT class, n, """ + r("round(sum(n) OVER () / (count(*) OVER () * n), 4)", "weight") + " FROM c")
def q_k02(spark, d):
    """Line items with their class weights as a balanced table, written and read back."""
    from flankwear.operators import balance as ba
    li = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("class"))
    w = ba.class_weights(li, "class").select("class", "weight")
    sk.write_balanced(li.join(w, "class").withColumn("is_synthetic", F.lit(False)), path := _folder(spark, "balanced"))
    back = spark.read.parquet(path).where(~F.col("is_synthetic"))
    return present(back.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


@register("k07_saved_model", "SELECT count(*) AS n, count(*) AS n_same FROM lineitem")
def q_k07(spark, d):
    """A fitted model saved, loaded and asked again: every prediction is the same."""
    from pyspark.ml.regression import LinearRegressionModel

    from flankwear.operators import models as mo
    li = b.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_tax").cast("double").alias("t"),
                                              F.col("l_extendedprice").cast("double").alias("label"))
    t = mo.assemble(li, ["q", "t"])
    m = mo.make_model("linear_regression", "regression").fit(t)
    sk.save_model(m, path := _folder(spark, "model"))
    again = LinearRegressionModel.load(path).transform(m.transform(t).withColumnRenamed("prediction", "first"))
    return again.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("first") == F.col("prediction"), 1)).alias("n_same"))


@register("s07_csv_tables_s09_k03", "SELECT o_orderstatus, count(*) AS n, " + r("sum(o_totalprice)", "price")
          + ", min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def q_csv(spark, d):
    """Orders in two CSV tables with columns in another order, stacked by name; an absent path is skipped."""
    o = b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = _folder(spark, "csv")
    sk.write_fused(o.where("o_orderkey % 2 = 0"), f"{path}/even", "csv")
    sk.write_fused(o.where("o_orderkey % 2 <> 0").select("o_totalprice", "o_orderkey", "o_orderstatus"), f"{path}/odd", "csv")
    back = fs.read_many(spark, [f"{path}/even", f"{path}/absent", f"{path}/odd"])
    return present(back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"),
                                                     F.min("o_orderkey").cast("bigint").alias("first_key")))


@register("k01_partitioned_features", "SELECT l_returnflag AS tool, count(*) AS n, " + r("avg(l_quantity)", "mean_quantity")
          + " FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def q_k01(spark, d):
    """A feature table partitioned by tool, read back for two of three tools."""
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tool"), "l_quantity")
    sk.write_features(li, path := _folder(spark, "features"))
    back = spark.read.parquet(path).where("tool <> 'N'")
    return present(back.groupBy(F.col("tool").cast("string").alias("tool")).agg(F.count(F.lit(1)).alias("n"),
                                                                               F.avg("l_quantity").alias("mean_quantity")))


@register("k05_k06_result_tables", with_ctes(b.OOF_CLASS_SQL) + "SELECT model, count(*) AS n, "
          + r("avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)", "accuracy") + " FROM oof GROUP BY 1")
def q_k05(spark, d):
    """Predictions and metrics written as result tables, the summary as CSV, and joined again."""
    oof = b.oof_classification(spark, d)
    metrics = ev.accuracy(oof)
    path = _folder(spark, "results")
    sk.write_results(oof, metrics, spark.createDataFrame([("{}",)], "meta string"), path)
    sk.write_summary(spark.read.parquet(f"{path}/metrics"), f"{path}/summary")
    n = spark.read.parquet(f"{path}/oof").groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    acc = fs.read_table(spark, f"{path}/summary").select("model", F.col("accuracy").cast("double").alias("accuracy"))
    return present(n.join(acc, "model"))


@register("s12_k04_profile_document", "SELECT 'l_returnflag' AS target_column, count(*) AS n_rows FROM lineitem")
def q_k04(spark, d):
    """A dataset profile written as a document and read back."""
    prof = pr.profile_table(b.table(spark, d, "lineitem"), target="l_returnflag")
    sk.write_profile(prof, path := _folder(spark, "profile"), "profile")
    return fs.read_profile(spark, path).select("target_column", F.col("n_rows").cast("bigint").alias("n_rows"))
