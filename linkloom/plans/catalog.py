"""Registry of named queries: what to run, what it covers, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query. ``covers`` lists inventory ids, ``sql`` is its check."""
    def add(fn: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, tuple(covers.split()), _with_wide_integers(fn), sql)
        return fn
    return add


def _with_wide_integers(fn: Run) -> Run:
    """All integer results as BIGINT, so that both engines agree on the schema."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        narrow = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "smallint", "tinyint")}
        if not narrow:
            return df
        return df.select(*[F.col(c).cast("bigint").alias(c) if c in narrow else F.col(c) for c in df.columns])
    return run


def load() -> dict[str, Query]:
    from linkloom.plans import (  # noqa: F401
        queries_changes, queries_files, queries_graph, queries_insights, queries_scalars, queries_streams,
    )
    return CATALOG
