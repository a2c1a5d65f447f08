"""Helpers that shape a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that later filters and scores read it ready-made.

    A plain projection would be copied into every expression that uses it, filters
    included; a one-element generator is where the optimizer stops copying.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
