"""Named queries and the independent SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliploom.sources.tables import DUCK_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the fixture views it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in DUCK_VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in ordered:
                visit(DUCK_VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({DUCK_VIEWS[name]})" for name in ordered)
    return f"WITH {head}\nSELECT * FROM (\n{body}\n) AS result"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.module = fn.__module__.rsplit('.', 1)[-1]
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle.strip())
        return fn

    return register
