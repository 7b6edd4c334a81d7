"""Helpers of this subpackage: sessions, and components by stars."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.stars import least_of, star_components

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with its columns called ``names`` under other names, so an operator can add its own; and what to select
    from the result to get the columns of ``rows`` back as they were."""
    other = {c: f"_own_{c}" if c in names else c for c in rows.columns}
    renamed = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in other.items()])
    return renamed, [F.col(f"`{o}`").alias(c) for c, o in other.items()]


__all__ = ["PACKAGE_ROOT", "least_of", "set_aside", "star_components", "table"]
