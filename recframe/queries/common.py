"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_RATIOS = ("watch_percentage",)

REGISTRY: dict[str, Callable] = {}


def query(name: str):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE / FLOAT column (the oracle rounds the same way) but
    plain ratios, which both engines compute alike to the last bit and round apart."""
    cols = []
    for f in df.schema.fields:
        if f.name in PLAIN_RATIOS:
            cols.append(F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
