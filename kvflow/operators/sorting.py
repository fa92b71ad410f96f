"""Sorts with a defined order, and their validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .partition import global_index


def total_sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range partitioned and sorted: partition i precedes partition i + 1."""
    return df.orderBy(*order)


def partition_sort(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows of a key together and in order, as a grouped iteration would see them."""
    by = [F.col(k) for k in keys]
    return (df.repartition(partitions, *by) if partitions else df.repartition(*by)).sortWithinPartitions(*keys, *order)


def secondary_sort(df: DataFrame, first: str, order: list[Column | str]) -> DataFrame:
    """``rank``: place of each row within its first key, in the given order."""
    return global_index(df, order, [first]).withColumnRenamed("_i", "rank")


def sort_with(df: DataFrame, *rules: Column) -> DataFrame:
    """A comparator of one's own: ``place`` of each row by the rules in turn, each an expression that sorts."""
    named = [r.alias(f"_r{i}") for i, r in enumerate(rules)]
    indexed = global_index(df.select("*", *named), [f"_r{i}" for i in range(len(rules))])
    return indexed.withColumnRenamed("_i", "place").drop(*[f"_r{i}" for i in range(len(rules))])


def by_frequency(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct keys by falling count, ties by key."""
    counted = frequencies(df, key).orderBy(F.col("n").desc(), F.col(key))
    return counted if limit is None else counted.limit(limit)


def frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def log_sort(df: DataFrame, line_col: str, columns: list[int], separator: str) -> DataFrame:
    """Lines in lexical order of the chosen 0-based columns."""
    parts = F.split(F.col(line_col), re.escape(separator))
    return df.orderBy(*[F.try_element_at(parts, F.lit(c + 1)).asc_nulls_first() for c in columns])


def validate_order(df: DataFrame, key: str, partition: Column | None = None, position: Column | None = None) -> DataFrame:
    """Misplaced rows of a sorted dataset, and partitions that begin before an earlier one ends.

    Each partition is checked on its own; only its first and last key are compared across partitions. Returns rows
    (kind, part, previous, key); none if the order holds."""
    placed = df.select(F.col(key).alias("key"), (F.spark_partition_id() if partition is None else partition).alias("part"), (F.monotonically_increasing_id() if position is None else position).alias("pos"))
    lagged = placed.withColumn("previous", F.lag("key").over(W.partitionBy("part").orderBy("pos")))
    inside = lagged.where("key < previous").select(F.lit("misorder").alias("kind"), "part", "previous", "key")
    ends = placed.groupBy("part").agg(F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    across = ends.withColumn("previous", F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    return inside.unionByName(across.where("first < previous").select(F.lit("bad split").alias("kind"), "part", "previous", F.col("first").alias("key")))
