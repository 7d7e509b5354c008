"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Every query reads whole driver tables through ``bindings``; floating outputs
are rounded by ``present`` (Spark) and ``r`` (SQL) to the same digits.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"flankwear.plans.{m}")


MODULES = ["q_files", "q_signals", "q_profile", "q_fusion", "q_spectral", "q_eval", "q_models", "q_grid", "q_stream"]
