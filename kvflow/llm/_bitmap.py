"""Rows that surely are not among some keys, told by a bitmap in a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.operators.filters import bloom_filter, might_contain

from ._names import own, unused
from ._store import written

#: Bits of the largest bitmap that is sent to tasks (8 MB).
MOST_BITS = 1 << 26


def told_apart(rows: DataFrame, row_key: list[Column], keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among ``keys`` (written), and those whose key surely is not: told in a projection, so
    the texts of the latter are never shuffled. A bitmap too small to tell anything lets all through."""
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(10, (10 * n).bit_length()))
    if 4 * n > bits:
        return rows, rows.where("false")
    words = written(bloom_filter(keys.select(F.xxhash64(*key).alias("k")), "k", bits), "bitmap").scalar()  # one row
    maybe = unused("maybe", rows)
    flagged = rows.withColumn(maybe, might_contain(words, F.xxhash64(*row_key), bits))
    return flagged.where(F.col(maybe)).select(*own(rows)), flagged.where(~F.col(maybe)).select(*own(rows))
