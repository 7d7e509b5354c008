"""Skew-safe order statistics, one plan at every size.

A window ``row_number() OVER (PARTITION BY g ORDER BY v)`` or Spark's exact
``percentile`` aggregate sends every row of a group to one task.  When one
group holds a large share of the data that task becomes the whole job.  The
helpers here instead range-partition on ``(group, value)`` -- the range
partitioner samples the composite key, so a hot group is cut into many
ordered slices -- and turn per-slice counts into exact global positions.
Only a small table of slice counts (one row per slice and group) is joined
back; the data itself is never gathered per group.

The sliced projection is read twice (slice counts, then the join back).  Two
evaluations of a range exchange sample independently and can disagree on
slice bounds (and an in-memory cache does not pin them either), so the
sliced projection is written once as a parquet stage in the shared
checkpoint folder (``spark.checkpoint.dir``): both readers see the same rows,
and a lost executor re-reads the files instead of re-slicing.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankwear.session import write_stage

def _ns_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` treating NULL keys as equal (a NULL group is a group too)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_r_{k}" for k in keys])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  name: str = "pos", count_name: str | None = None,
                  slices: int | None = None, stage_input: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position of each row inside its ``keys`` group, ordered by ``order``.

    Equivalent to ``row_number() - 1`` over ``partitionBy(keys).orderBy(order)``
    (ties broken arbitrarily), but no task ever holds more than its slice of the
    sorted rows.  If ``count_name`` is given the group size is added as well.  The
    range partitioner samples its input in a separate pass; ``stage_input`` writes
    an expensive input (e.g. an aggregate) once so that pass does not recompute it.
    Columns that only order the rows can be left out of the written slices (``drop``).
    """
    keys = list(keys)
    if stage_input:
        df = write_stage(df)
    sort_cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    # without an explicit count AQE may merge neighbouring (small) slices; merged
    # slices are still contiguous ranges, which is all the offsets rely on
    rp = df.repartitionByRange(slices, *sort_cols) if slices else df.repartitionByRange(*sort_cols)
    s = (rp.sortWithinPartitions(*sort_cols)
         .withColumn("_slice", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = write_stage(s.drop(*drop))
    blocks = s.groupBy("_slice", *keys).agg(F.min("_mid").alias("_m0"),
                                             F.count(F.lit(1)).alias("_bn"))
    # one row per slice and group; without keys one row per slice, dealt by a constant
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.col("_slice") < 0)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    cols = ["_slice", *keys, "_m0", "_off"]
    if count_name:
        blocks = blocks.withColumn(count_name, F.sum("_bn").over(whole))
        cols.append(count_name)
    # without keys the offsets are one row per slice, so the rows stay where they are
    out = _ns_join(s, blocks.select(*cols) if keys else F.broadcast(blocks.select(*cols)), ["_slice", *keys], "inner")
    return (out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_slice", "_mid", "_m0", "_off"))


def tied_ranks(counts: DataFrame, keys: Sequence[str], value: str, ties: str = "ties", name: str = "rank") -> DataFrame:
    """Average rank (1-based) of each distinct value inside its ``keys`` group, from a table of one row per group and
    value with the number of its rows.  Rows of a common value are counted before anything is sorted, so the slices are
    cut among distinct values and no task holds a value's rows."""
    keys = list(keys)
    rp = write_stage(counts).repartitionByRange(*[F.col(c) for c in (*keys, value)])
    s = write_stage(rp.withColumn("_slice", F.spark_partition_id()))
    blocks = s.groupBy("_slice", *keys).agg(F.sum(ties).alias("_bn"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.col("_slice") < 0)
    before = lambda w, order, c: F.coalesce(F.sum(c).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_off", before(whole, "_slice", "_bn")).drop("_bn")
    inside = s.withColumn("_in", before(Window.partitionBy("_slice", *keys), value, ties))
    out = _ns_join(inside, blocks, ["_slice", *keys], "inner")
    return out.withColumn(name, F.col("_off") + F.col("_in") + (F.col(ties) + 1) / 2).drop("_slice", "_off", "_in")


#: Rank error of the bracketing sketch is 1 / ACCURACY of a group's rows; brackets reach twice as far to either side.
ACCURACY = 10_000
#: Brackets are broadcast up to so many groups (one row of some 100 bytes each); beyond, the join goes by key.
BROADCAST_GROUPS = 100_000


def _holds_nan(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.typeName() in ("double", "float")


def bracket_aggs(df: DataFrame, value: str, probs: Sequence[float]) -> list[Column]:
    """Aggregates of the first scan: ``__n`` values, ``__nan`` of them NaN, and ``__b``, the bracket of every probability
    (lower and upper end) from one mergeable sketch per group."""
    v = F.col(value)
    nan = F.count(F.when(F.isnan(v), 1)) if _holds_nan(df, value) else F.lit(0).cast("bigint")
    ends = [min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in probs for s in (-1, 1)]
    return [F.count(v).alias("__n"), nan.alias("__nan"), F.percentile_approx(v, ends, ACCURACY).alias("__b")]


def quantiles_in(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], brackets: DataFrame) -> DataFrame:
    """Exact quantiles from brackets (a written table: keys, ``__n``, ``__nan``, ``__b``) and one more scan of ``df``.

    Every row becomes a cell of its group: its own value inside a bracket, else the gap between brackets it lies in.
    Cells are counted with partial aggregation, so a gap costs one row per task, a value tied a billion times too,
    and about 4 / ACCURACY of a group's rows per probability are shuffled; running counts over a group's cells are
    the ranks.  Groups of fewer than ``2 * ACCURACY`` rows are cells as a whole.  A rank that falls into a gap (the
    sketch was off, or the group holds NaN) sends its group through ``sorted_quantiles``."""
    keys = list(keys)
    n_groups, worst = brackets.agg(F.count(F.lit(1)), F.max("__nan")).first()
    small = F.col("__n") < 2 * ACCURACY
    v = F.col("__v")
    rows = df.select(*keys, F.col(value).alias("__v")).where(v.isNotNull())
    side = F.broadcast(brackets) if n_groups <= BROADCAST_GROUPS else brackets
    rows = _ns_join(rows, side.select(*keys, "__n", "__b"), keys, "inner")
    ends = [(F.col("__b")[2 * j], F.col("__b")[2 * j + 1]) for j in range(len(probs))]
    inside = small
    for lo, hi in ends:
        inside = inside | ((v >= lo) & (v <= hi))
    below = [F.when(hi < v, hi) for _, hi in ends]
    gap = F.greatest(*below) if len(below) > 1 else below[0]
    cells = (rows.select(*keys, "__n", F.when(inside, v).otherwise(gap).alias("__cell"), (~inside).alias("__gap"))
             .groupBy(*keys, "__cell", "__gap").agg(F.count(F.lit(1)).alias("__rows"), F.first("__n").alias("__n")))
    run = Window.partitionBy(*keys).orderBy(F.col("__cell").asc_nulls_first(), "__gap").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__end", F.sum("__rows").over(run))
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("__n") - 1)
        at = lambda r: F.max(F.when(~F.col("__gap") & (r < F.col("__end")) & (r >= F.col("__end") - F.col("__rows")), F.col("__cell")))
        lo, hi, frac = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        aggs.append((lo + frac * (hi - lo)).alias(name))
    out = cells.groupBy(*keys).agg(*aggs)
    if worst:
        lost = brackets.where("__nan > 0").select(*keys)
    else:
        missed = F.lit(False)
        for name in probs:
            missed = missed | F.col(name).isNull()
        out = write_stage(out)                                # one row per group
        lost = out.where(missed).select(*keys)
        if lost.isEmpty():
            return out
    found = _ns_join(out, lost, keys, "left_anti")
    return found.unionByName(sorted_quantiles(_ns_join(df, lost, keys, "left_semi"), keys, value, probs))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles (numpy default / ``quantile_cont``) per group, exact, in two scans of ``df``: a
    sketch brackets every quantile, and only the rows in brackets are ranked.  No copy of the rows is written.

    ``probs`` maps output column name -> probability.  NULL values are ignored; a group with no values yields no row
    (callers left-join); NaN sorts last."""
    if not keys:
        return exact_quantiles(df.select(F.lit(0).alias("__all"), value), ["__all"], value, probs).drop("__all")
    v = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    brackets = write_stage(v.groupBy(*keys).agg(*bracket_aggs(v, "__v", list(probs.values()))))
    return quantiles_in(v, keys, "__v", probs, brackets)


def sorted_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                     probs: dict[str, float], slices: int | None = None) -> DataFrame:
    """``exact_quantiles`` by positions in range slices (one sort and one staged copy of the rows)."""
    keys = list(keys)
    v = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    r = with_position(v, keys, ["_v"], "_pos", "_n", slices)
    wanted = []
    for p in probs.values():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        wanted += [F.floor(h), F.ceil(h)]
    r = r.where(F.array_contains(F.array(*[w.cast("bigint") for w in wanted]), F.col("_pos")))
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.max(F.when(F.col("_pos") == F.floor(h), F.col("_v")))
        hi = F.max(F.when(F.col("_pos") == F.ceil(h), F.col("_v")))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + frac * (hi - lo)).alias(name))
    return r.groupBy(*keys).agg(*aggs)


def approx_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                     probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Bounded-memory quantile sketch per group (``percentile_approx``)."""
    names = list(probs)
    q = F.percentile_approx(F.col(value), [float(probs[n]) for n in names], accuracy)
    out = df.groupBy(*keys).agg(q.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def neighbourhood(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                  offsets: Sequence[int]) -> DataFrame:
    """Values at ``pos + o`` for each offset ``o`` as columns ``<col>_at_<o>``.

    Each row is copied once per offset to the position that needs it and the
    copies are grouped on ``(keys, pos)``: one balanced shuffle, no window over
    a whole group.  Offsets use ``m`` for minus in names (``x_at_m1``).
    """
    keys = list(keys)
    offs = sorted(set(offsets) | {0})
    e = (df.select(*keys, pos, *cols)
         .withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offs])))
         .withColumn("_t", F.col(pos) - F.col("_o")))
    aggs = [F.max((F.col("_o") == 0).cast("int")).alias("_self")]
    for c in cols:
        for o in offs:
            tag = f"m{-o}" if o < 0 else str(o)
            aggs.append(F.max(F.when(F.col("_o") == o, F.col(c))).alias(f"{c}_at_{tag}"))
            aggs.append(F.max((F.col("_o") == o).cast("int")).alias(f"_has_{c}_{tag}"))
    g = e.groupBy(*keys, "_t").agg(*aggs).where(F.col("_self") == 1)
    return g.withColumnRenamed("_t", pos).drop("_self")
