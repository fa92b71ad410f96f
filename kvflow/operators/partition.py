"""Partitioners, samplers and a global row index without a single-task window."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvflow.plans.store import written


def _placed(df: DataFrame, order: list, ranges: int | None) -> tuple[DataFrame, Column]:
    """Rows dealt by ranges of the order (as many as the session's shuffle partitions, or ``ranges``), sorted and
    numbered in their range (``_at``), and written once; the column that tells the range."""
    ranged = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    # the upper bits of the id are the range, the lower 33 the place in it
    return written(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges"), F.shiftright("_at", 33)


def _lifted(placed: DataFrame, part: Column, total: Column) -> DataFrame:
    """``placed`` with ``_lift``: the total of the ranges before, one row a range."""
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    lifts = placed.groupBy(part.alias("_p")).agg(total.alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    return placed.join(F.broadcast(lifts), part == F.col("_p"))


def _numbered(placed: DataFrame, part: Column) -> DataFrame:
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return _lifted(placed, part, F.count("*")).withColumn("_i", place + F.col("_lift") + 1).drop("_p", "_at", "_lift")


def numbered(ordered: DataFrame) -> DataFrame:
    """``_i``: 1-based row number of a sorted table, whose partitions follow each other."""
    return _numbered(written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered"), F.shiftright("_at", 33))


def global_index(df: DataFrame, order: list, within: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``_i``: 1-based row number in a total order, over all rows or within groups (nulls are a group).

    Ranges are written once, so that counting and lifting by the rows of the ranges before read the same ranges and the
    input is computed once. No task sees more than a range: a group with most of the rows is spread over ranges, too,
    and its rows are numbered from its first one."""
    out = _numbered(*_placed(df, [*(within or []), *order], ranges))
    if not within:
        return out
    first = out.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(within)]).agg(F.min("_i").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(within)])
    return out.join(first, same).withColumn("_i", (F.col("_i") - F.col("_first") + 1).cast("int")).select(*df.columns, "_i")


def running_total(df: DataFrame, order: list, value: str, ranges: int | None = None) -> DataFrame:
    """``_run``: the sum of ``value`` over all rows up to and with each, in a total order."""
    placed, part = _placed(df, order, ranges)
    lifted = _lifted(placed, part, F.sum(value))
    upto = F.sum(value).over(W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return lifted.withColumn("_run", upto + F.col("_lift")).drop("_p", "_at", "_lift")


def hash_partition(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    return df.repartition(partitions, *keys)


def range_of(key: Column, cuts: list) -> Column:
    """Number of cuts at or below the key: equal keys go right."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key))


def range_left_of(key: Column, cuts: list) -> Column:
    """Number of cuts below the key: equal keys go left."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < key))


def range_partition(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(partitions, *keys)


def first_of_splits(df: DataFrame, n: int, order: list[str], split: Column) -> DataFrame:
    """Split sampler: the first n records of each split in the given order."""
    return df.withColumn("_s", split).withColumn("_i", F.row_number().over(W.partitionBy("_s").orderBy(*order))).where(F.col("_i") <= n).drop("_s", "_i")


def random_sample(df: DataFrame, frequency: float, seed: int) -> DataFrame:
    return df.sample(frequency, seed)


def interval_sample(df: DataFrame, numerator: int, denominator: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Row i (from 1) is kept if ceil(f i) exceeds ceil(f (i - 1)), f = numerator / denominator; the first always is."""
    up = lambda c: F.floor((c * numerator + (denominator - 1)) / F.lit(denominator))
    indexed = global_index(df, order, within)
    return indexed.where(up(F.col("_i")) > up(F.col("_i") - 1)).drop("_i")


def split_points(samples: list, partitions: int) -> list:
    """At most ``partitions`` - 1 rising cut points that share the samples evenly: the values at the quantiles, each
    above the cut before."""
    count = Counter(samples)
    values = sorted(count)
    upto = list(accumulate(count[v] for v in values))
    quantiles = [(2 * len(samples) * i + partitions) // (2 * partitions) for i in range(1, partitions)]
    places = accumulate((bisect_right(upto, q) for q in quantiles), lambda last, at: max(last + 1, at))
    return [values[p] for p in places if p < len(values)]


def sampled_cuts(df: DataFrame, key: str, partitions: int, most: int = 100_000) -> list:
    """Cut points of the keys' digest sample of about ``most`` rows at most (every key, if there are no more)."""
    from .filters import md5_sample

    frequency = max(1, -(-df.count() // most))
    return split_points([r[0] for r in md5_sample(df.select(key), key, frequency).collect()], partitions)


def keep_percent(df: DataFrame, percent: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Row i appears ceil(p i) - ceil(p (i - 1)) times: none, once, or more than once for p above 100 %."""
    up = lambda c: F.floor((c * percent + 99) / F.lit(100))
    copies = (up(F.col("_i")) - up(F.col("_i") - 1)).cast("int")
    return global_index(df, order, within).withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).drop("_i", "_c")
