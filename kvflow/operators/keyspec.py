"""Unix-sort style key specs: ``-k pos1[,pos2]`` with ``n`` and ``r``, compiled to expressions.

A region runs over the bytes of the whole key from ``f.c`` (1-based) to ``f.c`` (character 0: the field's end), or to
the key's end without a second position; it is not clamped to its field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeySpec:
    field: int
    char: int = 1
    end_field: int | None = None
    end_char: int = 0
    numeric: bool = False
    reverse: bool = False


def parse(spec: str) -> list[KeySpec]:
    out = []
    for m in re.finditer(r"-k\s*(\d+)(?:\.(\d+))?([nr]*)(?:,(\d+)(?:\.(\d+))?([nr]*))?", spec):
        flags = m[3] + (m[6] or "")
        out.append(KeySpec(int(m[1]), int(m[2] or 1), int(m[4]) if m[4] else None, int(m[5] or 0), "n" in flags, "r" in flags))
    rest = re.sub(r"-k\s*[\d.,nr]+", "", spec)
    if out and (set(rest) & set("nr")):
        out = [KeySpec(k.field, k.char, k.end_field, k.end_char, k.numeric or "n" in rest, k.reverse or "r" in rest) for k in out]
    return out


def region(key: Column, k: KeySpec, separator: str = "\t") -> Column:
    """The key's region as a string, null if its first field is missing."""
    octets = key.cast("binary")
    parts = F.split(key, re.escape(separator))
    sizes = F.transform(parts, lambda p: F.octet_length(p) + len(separator.encode()))
    start_of = lambda f: F.aggregate(F.slice(sizes, 1, f - 1), F.lit(0), lambda a, s: a + s)  # noqa: E731  0-based
    begin = start_of(k.field) + (k.char - 1)
    if k.end_field is None:
        end = F.octet_length(key)
    elif k.end_char:
        end = F.least(start_of(k.end_field) + k.end_char, F.octet_length(key))
    else:
        end = F.when(F.size(parts) >= k.end_field, start_of(k.end_field) + F.octet_length(F.try_element_at(parts, F.lit(k.end_field)))).otherwise(F.octet_length(key))
    text = F.substring(octets, begin + 1, F.greatest(end - begin, F.lit(0))).cast("string")
    return F.when(F.size(parts) >= k.field, text)


def region_number(key: Column, k: KeySpec, separator: str = "\t") -> Column:
    """The number that the region begins with, 0 without one, null if the first field is missing."""
    c = region(key, k, separator)
    number = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(-?[0-9]*(?:\.[0-9]*)?)", 1)
    return F.when(c.isNotNull(), F.coalesce(F.nullif(number, F.lit("")).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")))


def sort_columns(key: Column, spec: str, separator: str = "\t") -> list[Column]:
    """Order-by columns; no spec: the whole key. A missing region sorts first (last under ``r``)."""
    specs = parse(spec)
    if not specs:
        return [key.desc() if "r" in spec else key.asc()]
    out = []
    for k in specs:
        c = region(key, k, separator)
        if k.numeric:
            c = region_number(key, k, separator)
        out.append(c.desc_nulls_last() if k.reverse else c.asc_nulls_first())
    return out


def sort_by_spec(df: DataFrame, key_col: str, spec: str, separator: str = "\t") -> DataFrame:
    return df.orderBy(*sort_columns(F.col(key_col), spec, separator))


def partition_by_spec(df: DataFrame, key_col: str, spec: str, partitions: int, separator: str = "\t") -> DataFrame:
    """Rows whose regions agree share a partition."""
    regions = [F.coalesce(region(F.col(key_col), k, separator), F.lit("")) for k in parse(spec)] or [F.col(key_col)]
    return df.repartition(partitions, *regions)
