"""Distribution summaries and tests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.functions.pvalues import chi2_sf, t_two_sided
from flankwear.operators.ordering import exact_quantiles, tied_ranks
from flankwear.session import write_stage


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast, bounded by construction)."""
    return df.withColumn("_k1", F.lit(1)).join(F.broadcast(one_row.withColumn("_k1", F.lit(1))), "_k1").drop("_k1")


def histogram(df: DataFrame, col: str, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (per ``by`` level); last bin closed."""
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    v = df.where(F.col(col).isNotNull()).select(*by, col)
    j = v.join(rng, by) if by else with_scalars(v, rng)
    w = (F.col("_hi") - F.col("_lo")) / n
    k = F.when(w == 0, 0).otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / w), F.lit(n - 1))).cast("int")
    h = j.withColumn("bin", k).groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return h.select(*by, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / n).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / n).alias("bin_hi"), "count")


def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the fences), mean, outliers."""
    by = list(by)
    v = df.select(*by, F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    q = exact_quantiles(v, by, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("_lo", F.col("q1") - 1.5 * F.col("iqr")).withColumn("_hi", F.col("q3") + 1.5 * F.col("iqr"))
    j = v.join(q, by)  # one row per group on the right
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    agg = j.groupBy(*by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"), F.count(F.when(~inside, 1)).alias("n_outliers"))
    return agg


def avg_rank(df: DataFrame, col: str) -> DataFrame:
    """Average rank (1-based, ties averaged) of each distinct value, with tie size."""
    v = df.select(F.col(col).alias("_x")).where(F.col("_x").isNotNull())
    c = v.groupBy("_x").agg(F.count(F.lit(1)).alias("ties"))
    return tied_ranks(c, [], "_x", name="avg_rank").select(F.col("_x").alias(col), "avg_rank", "ties")


def kruskal(df: DataFrame, col: str | Sequence[str], by: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H of each column across the levels of ``by`` and its χ² p-value; all columns
    are ranked by their distinct values in one long table.  Where all values are tied (or there is one value) H and p are NULL."""
    cols = [col] if isinstance(col, str) else list(col)
    wide = df.select(F.col(by).alias("_g"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).where(F.col("_g").isNotNull())
    d = wide.unpivot(["_g"], [f"c{i}" for i in range(len(cols))], "_c", "_x").where(F.col("_x").isNotNull())
    # ties share the mean of their ranks; a value's rows of one level count together
    cnt = write_stage(d.groupBy("_c", "_g", "_x").agg(F.count(F.lit(1)).alias("_n")))
    ranks = tied_ranks(cnt.groupBy("_c", "_x").agg(F.sum("_n").alias("ties")), ["_c"], "_x")
    rs = cnt.join(ranks, ["_c", "_x"]).groupBy("_c", "_g").agg(F.sum(F.col("_n") * F.col("rank")).alias("R"), F.sum("_n").alias("n_g"))
    tot = rs.groupBy("_c").agg(F.sum("n_g").alias("N"), F.sum(F.col("R") * F.col("R") / F.col("n_g")).alias("S"), F.count(F.lit(1)).alias("k"))
    ties = ranks.groupBy("_c").agg(F.sum(F.pow(F.col("ties"), 3) - F.col("ties")).alias("T"))
    N = F.col("N").cast("double")
    h = tot.join(ties, "_c") \
        .withColumn("H0", F.try_divide(F.lit(12.0), N * (N + 1)) * F.col("S") - 3 * (N + 1)) \
        .withColumn("C", 1 - F.try_divide(F.col("T"), N * N * N - N)) \
        .withColumn("H", F.try_divide("H0", "C"))
    name = F.element_at(F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"c{i}"), F.lit(c))]), F.col("_c"))
    return h.select(name.alias("column"), "k", F.col("N").alias("n"), "H", chi2_sf(F.col("H"), F.col("k") - 1).alias("p"))


def linreg(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept, Pearson r and the two-sided p of the slope.
    A perfect fit has p 0; under three points or without spread p is NULL."""
    by = list(by)
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                            F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r"))))
    perfect = (F.col("n") > 2) & (1 - F.col("r") * F.col("r") <= 0)
    return g.withColumn("p", F.when(perfect, 0.0).when(F.col("n") > 2, t_two_sided(t, F.col("n") - 2)))
