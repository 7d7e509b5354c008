"""Class balancing and fold assignment."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flankwear.operators.ordering import with_position

SEED = 42


def class_weights(df: DataFrame, y: str, digits: int = 4) -> DataFrame:
    """Balanced weights n / (k · n_c) per class (per-class table is tiny)."""
    c = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return (c.withColumn("n", F.sum("n_c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
            .withColumn("weight", F.round(F.col("n") / (F.col("k") * F.col("n_c")), digits)))


def recommend_strategy(ratio, n) -> "F.Column":
    """Ratio < 1.5 none; < 5 weights; n < 500 weights; else smote."""
    r, m = F.col(ratio) if isinstance(ratio, str) else ratio, F.col(n) if isinstance(n, str) else n
    return (F.when(r < 1.5, "none").when(r < 5, "class_weight").when(m < 500, "class_weight").otherwise("smote"))


def strategy_table(df: DataFrame, y: str) -> DataFrame:
    """B02 on data: imbalance ratio and row count -> recommended strategy."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    s = c.agg((F.max("n_c") / F.min("n_c")).alias("imbalance_ratio"), F.sum("n_c").alias("n"))
    return s.withColumn("strategy", recommend_strategy("imbalance_ratio", "n"))


def encode_weights(weights: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key class weights from label text to the encoded index."""
    return weights.join(mapping.withColumnRenamed("label", "class"), "class", "inner") \
        .select("label_idx", "class", "weight")


def with_weights(df: DataFrame, y: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach ``weightCol`` for pyspark.ml from the per-class table (tiny, broadcast)."""
    return df.join(weights.select(F.col("class").alias(y), F.col("weight").alias(out)), y, "left")


def balance(df: DataFrame, task: str, y: str) -> DataFrame:
    """Regression passes through; classification gets class weights."""
    if task == "regression":
        return df
    return with_weights(df, y, class_weights(df, y))


def _hash_order(row_id: str, seed: int) -> "F.Column":
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def stratified_folds(df: DataFrame, y: str, k: int = 5, seed: int = SEED, row_id: str = "row_id",
                     name: str = "fold") -> DataFrame:
    """Within each class rows are ordered by md5(seed|row_id) and dealt round-robin
    into ``k`` folds (sizes differ by at most one per class).  Skew-safe positions."""
    d = df.withColumn("_h", _hash_order(row_id, seed))
    p = with_position(d, [y], ["_h"], name="_pos")
    return p.withColumn(name, (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def kfolds(df: DataFrame, k: int = 5, seed: int = SEED, row_id: str = "row_id", name: str = "fold") -> DataFrame:
    """Shuffled k-fold by hash order (global positions, skew-safe)."""
    d = df.withColumn("_h", F.unhex(_hash_order(row_id, seed)))             # as bytes, which sort like their text
    p = with_position(d, [], ["_h"], name="_pos", drop=["_h"])
    return p.withColumn(name, (F.col("_pos") % k).cast("int")).drop("_pos")


def group_folds(df: DataFrame, group: str, name: str = "fold") -> DataFrame:
    """Leave-one-group-out; fold = index of the group in sorted order."""
    g = df.select(group).distinct()
    g = with_position(g, [], [group], name=name).withColumn(name, F.col(name).cast("int"))
    return df.join(g, group, "left")  # one row per group on the right


def n_splits(df: DataFrame, y: str | None, k: int = 5) -> DataFrame:
    """Fold count capped by the smallest class (or by n), at least 2."""
    if y is None:
        return df.agg(F.greatest(F.lit(2), F.least(F.lit(k), F.count(F.lit(1)))).alias("n_splits"))
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    return c.agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("n_c"))).alias("n_splits"))


def holdout(df: DataFrame, test_size: float = 0.15, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Exactly ceil(test_size · n) rows, lowest md5(seed|row_id), flagged ``is_test``."""
    d = df.withColumn("_h", _hash_order(row_id, seed))
    p = with_position(d, [], ["_h"], name="_pos", count_name="_n")
    return p.withColumn("is_test", F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_size))).drop("_h", "_pos", "_n")
