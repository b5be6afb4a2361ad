"""All named queries: name -> (Spark builder, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cuelake.session import tune

MODULES = ("q_sources", "q_align", "q_qc", "q_text", "q_memory", "q_routing", "q_lifecycle", "q_export",
           "q_infer", "q_records", "q_streams")


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            if key in self.builders:
                raise ValueError(f"duplicate query {key}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(tune(spark), sf_dir)

            self.builders[key] = run
            if sql is not None:
                self.sql[key] = sql
            return fn
        return add


REG = Registry()
_loaded = False


def _load() -> Registry:
    global _loaded
    if not _loaded:
        for m in MODULES:
            try:
                import_module(f"cuelake.plans.{m}")
            except ModuleNotFoundError as e:
                if f"plans.{m}" not in str(e):
                    raise
        _loaded = True
    return REG


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_load().builders)


def oracle_sql() -> dict[str, str]:
    return dict(_load().sql)
