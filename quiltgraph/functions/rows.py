"""Turning arrays inside a row into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[str], array: Column, position: str = "_pos") -> DataFrame:
    """One row per element, its fields as columns after ``keep`` and ``position``.

    The outer form keeps the optimizer from copying the array expression into a
    ``size > 0`` filter below, which would compute an expensive array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, "_e"))
    return rows.filter(F.col(position).isNotNull()).select(*keep, position, "_e.*")
