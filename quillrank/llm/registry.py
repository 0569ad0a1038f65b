"""The queries of the operators in this subpackage, beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load_all() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(f"quillrank.llm.{name}")


MODULES = ["decontaminate", "host_rules", "url_filter", "site_templates", "language", "compression_quality", "recompression", "parity_join", "pieces", "context_mixing", "histogram_sort", "collocations", "filter_audit"]
