"""All registered queries: name -> (Spark builder over Views, DuckDB text or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factbase.plans.fixtures import Views

MODULES = ["catalog_core", "catalog_docs", "catalog_merge", "catalog_serve", "catalog_chat", "catalog_jobs"]


def registered() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"factbase.plans.{name}").QUERIES)
    return out


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Views(spark, sf_dir))
    return {name: bind(build) for name, (build, _) in registered().items()}


def duck_queries() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registered().items() if sql}
