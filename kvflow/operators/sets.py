"""Set operations over collections of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols or df.columns).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_copies else a.subtract(b)
