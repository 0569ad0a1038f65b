"""Every query of the engine over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL body that gives the same rows. Views are added as CTEs."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add


def with_views(body: str) -> str:
    """The SQL with the views it names, and those they name, in front as CTEs."""
    from quillrank.registry.views_sql import VIEWS

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in needed]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head) :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def load_all() -> None:
    from quillrank.registry import (  # noqa: F401
        chats,
        clinical,
        limits,
        pipelines,
        repertory,
        retrieval,
        text,
        validation,
    )
    from quillrank.registry import saving  # noqa: F401  (reads the SQL of the rules)
