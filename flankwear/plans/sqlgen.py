"""Small helpers to spell the DuckDB oracle text (string building only)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 7  # significant digits kept when comparing with the oracle
FLOOR = 1e-9  # |x| below this is reported as 0
TIE = 1.0 + 1e-11  # nudges exact decimal ties the same way in both engines


def _sig(c):
    a = F.abs(c)
    d = F.lit(DIGITS - 1) - F.floor(F.log10(a))
    p = F.pow(F.lit(10.0), F.abs(d))
    y = c * F.lit(TIE)
    v = F.when(d >= 0, F.round(y * p, 0) / p).otherwise(F.round(y / p, 0) * p)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(a < FLOOR, F.lit(0.0)).otherwise(v) + F.lit(0.0)


def present(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Round floating columns (all, or ``only``) to DIGITS significant digits (oracle comparison)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only):
            c = _sig(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sig_sql(expr: str) -> str:
    """DuckDB spelling of ``present`` for one expression."""
    x = f"CAST({expr} AS DOUBLE)"
    d = f"({DIGITS - 1} - floor(log10(abs({x}))))"
    p = f"power(10.0, abs({d}))"
    y = f"({x} * {TIE!r})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) < {FLOOR!r} THEN 0.0 "
            f"WHEN {d} >= 0 THEN round({y} * {p}) / {p} ELSE round({y} / {p}) * {p} END + 0.0)")


def r(expr: str, alias: str) -> str:
    return f"{sig_sql(expr)} AS {alias}"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def moments_sql(src: str, keys: Sequence[str], x: str = "x", eps: str = "1e-12", name: str = "feat") -> str:
    """Per-group A01-A14 in DuckDB (population skew/kurt spelled from moments) as CTE ``name``."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = g.{c}" for c in keys)
    sql = f"""g0 AS (SELECT {k}, count({x}) AS n, avg({x}) AS mu FROM {src} GROUP BY {k}),
mom AS (
  SELECT {', '.join('g.' + c for c in keys)}, g.n, g.mu,
         stddev_pop(s.{x}) AS std, sqrt(avg(s.{x} * s.{x})) AS rms, max(abs(s.{x})) AS mx,
         max(s.{x}) - min(s.{x}) AS p2p,
         avg(power(s.{x} - g.mu, 2)) AS m2, avg(power(s.{x} - g.mu, 3)) AS m3, avg(power(s.{x} - g.mu, 4)) AS m4,
         sum(s.{x} * s.{x}) AS energy, avg(s.{x} * s.{x}) AS energy_mean, avg(abs(s.{x})) AS mabs,
         quantile_cont(s.{x}, 0.25) AS p25, quantile_cont(s.{x}, 0.75) AS p75
  FROM {src} s JOIN g0 g ON {on}
  GROUP BY {', '.join('g.' + c for c in keys)}, g.n, g.mu),
feat AS (
  SELECT {k}, n, mu AS mean, std, rms, mx AS max, p2p,
         CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) END AS skew,
         CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurt,
         CASE WHEN rms IS NULL THEN NULL WHEN rms > {eps} THEN mx / rms ELSE 0.0 END AS crest,
         rms / (mabs + {eps}) AS shape, energy, p25, p75, p75 - p25 AS iqr, energy_mean
  FROM mom)"""
    if name == "feat":
        return sql
    return (sql.replace("g0 AS", f"{name}_g0 AS").replace("JOIN g0 g", f"JOIN {name}_g0 g")
            .replace("mom AS", f"{name}_mom AS").replace("FROM mom", f"FROM {name}_mom")
            .replace("feat AS", f"{name} AS"))
