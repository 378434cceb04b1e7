"""Named queries, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.sources.adapters import VIEW_NAMES, Tables, duckdb_view

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None
    digits: dict[str, int]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        # Engines add floating point numbers in different orders.
        return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in self.digits.items()})


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, **digits: str) -> Callable[[Build], Build]:
    """Register ``build(tables)`` under ``name``; ``oracle`` may use adapter view names.

    ``r6="a b"`` compares the columns ``a`` and ``b`` to six decimal places.
    """
    places = {c: int(key[1:]) for key, columns in digits.items() for c in columns.split()}

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        sql = _rounded(with_views(oracle), places) if oracle else None
        REGISTRY[name] = Query(name, build, sql, places)
        return build

    return add


def _rounded(sql: str, places: dict[str, int]) -> str:
    if not places:
        return sql
    columns = ", ".join(f"round({c}, {d}) + 0.0 as {c}" for c, d in places.items())
    return f"select * replace ({columns}) from (\n{sql}\n)"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the adapter views it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEW_NAMES:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(duckdb_view(view))
                if view not in needed:
                    needed.append(view)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{v} as (\n{duckdb_view(v)}\n)" for v in needed)
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
