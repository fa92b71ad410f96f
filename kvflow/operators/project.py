"""Per-record transforms as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default token delimiters.
TOKEN_DELIMITERS = r"[ \t\n\r\f]+"


def tokens(text: Column, delimiters: str = TOKEN_DELIMITERS) -> Column:
    """Array of non-empty tokens."""
    return F.filter(F.split(text, delimiters), lambda t: t != "")


def token_counts(df: DataFrame, text_col: str, delimiters: str = TOKEN_DELIMITERS) -> DataFrame:
    """(token, n): one partial count a partition and token, then one shuffle of counts."""
    return df.select(F.explode(tokens(F.col(text_col), delimiters)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def regex_tokens(df: DataFrame, text_col: str, pattern: str, group: int = 0) -> DataFrame:
    """(match): one row per find of ``pattern``."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group))).alias("match"))


def swapped(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value change places."""
    return df.select(F.col(value).alias("key"), F.col(key).alias("value"))


def split_first(line: Column, separator: str = "\t") -> tuple[Column, Column]:
    """Key and value at the first separator; without one the whole line is the key and the value is empty."""
    at = F.instr(line, separator)
    key = F.when(at > 0, F.substring(line, 1, at - 1)).otherwise(line)
    value = F.when(at > 0, F.substring(line, at + len(separator), F.length(line))).otherwise("")
    return key, value


def fields(line: Column, separator: str) -> Column:
    """Fields of a delimited line without trailing empty ones; the separator is a regular expression."""
    bare = F.regexp_replace(line, f"(?:{separator})+\\z", "")
    return F.when((bare == "") & (line != ""), F.array().cast("array<string>")).otherwise(F.split(bare, separator))


def parse_ranges(spec: str, open_allowed: bool = False) -> list[tuple[int, int | None]]:
    """``"6,5,1-3,7-"`` to inclusive 0-based ranges, in the order given; an end of None is open."""
    out: list[tuple[int, int | None]] = []
    for part in filter(None, spec.split(",")):
        m = re.fullmatch(r"(\d+)(-(\d*))?", part.strip())
        if not m:
            raise ValueError(f"not a field or range: {part!r}")
        if m[2] is None:
            out.append((int(m[1]), int(m[1])))
        elif m[3]:
            out.append((int(m[1]), int(m[3])))
        elif open_allowed:
            out.append((int(m[1]), None))
        else:
            raise ValueError("an open range is only for values")
    return out


def selected(parts: Column, ranges: list[tuple[int, int | None]], separator: str) -> Column | None:
    """The chosen fields joined by the separator; a missing field is empty but keeps its place."""
    if not ranges:
        return None
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))
    pieces: list[Column] = []
    for lo, hi in ranges:
        if hi is None:
            pieces.append(F.slice(parts, lo + 1, F.greatest(F.size(parts) - lo, F.lit(0))))
        else:
            pieces.append(F.array(*[at(i) for i in range(lo, hi + 1)]))
    return F.array_join(F.concat(*pieces), separator)


def field_select(df: DataFrame, line_col: str, map_spec: str, reduce_spec: str | None = None, separator: str = "-") -> DataFrame:
    """``key_fields:value_fields`` on lines; a reduce spec selects again from key and value fields joined."""
    parts = fields(F.col(line_col), re.escape(separator))
    both = map_spec.partition(":")
    key = selected(parts, parse_ranges(both[0]), separator)
    value = selected(parts, parse_ranges(both[2], True), separator)
    if reduce_spec is not None:
        joined = F.concat_ws(separator, *[c for c in (key, value) if c is not None])
        again, both = fields(joined, re.escape(separator)), reduce_spec.partition(":")
        key = selected(again, parse_ranges(both[0]), separator)
        value = selected(again, parse_ranges(both[2], True), separator)
    absent = F.lit(None).cast("string")
    return df.select((absent if key is None else key).alias("key"), (absent if value is None else value).alias("value"))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per-record steps one after another; Catalyst fuses them into one stage."""
    for step in steps:
        df = step(df)
    return df


def document_operations(df: DataFrame, line_col: str) -> DataFrame:
    """``docid op text`` lines to (doc, op, text); an update is a delete and an insert, an unknown op an insert."""
    parts = F.split(F.col(line_col), " ", 3)
    op = F.lower(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    ops = F.when(op.isin("d", "del", "delete"), F.array(F.lit("delete"))).when(op.isin("u", "upd", "update"), F.array(F.lit("delete"), F.lit("insert"))).otherwise(F.array(F.lit("insert")))
    return df.select(F.element_at(parts, 1).alias("doc"), F.explode(ops).alias("op"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("text"))
