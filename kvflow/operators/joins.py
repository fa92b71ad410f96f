"""N-way keyed joins: inner, outer, override, user-defined; a composable expression; tagged joins.

A source is a DataFrame; its row travels as one struct column per source, so an absent side (null struct) differs from
a side of nulls. Null keys never join.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _packed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*[c for c in df.columns if c != key] or [F.lit(1).alias("one")]).alias(name))


def inner(key: str, **sources: DataFrame) -> DataFrame:
    """key and one struct per source: the cross product per key of all sources that all have it."""
    return reduce(lambda a, b: a.join(b, "key"), [_packed(df, key, n) for n, df in sources.items()])


def outer(key: str, **sources: DataFrame) -> DataFrame:
    """As :func:`inner`, with null for sources that lack the key."""
    return reduce(lambda a, b: a.join(b, "key", "full"), [_packed(df, key, n) for n, df in sources.items()])


def override(key: str, *sources: DataFrame) -> DataFrame:
    """Per key only the rows of the last source that has it, all of them. Sources share their columns.

    The winner of a key is a map-side combined aggregate joined back, so a hot key is never gathered in one task."""
    tagged = [df.where(F.col(key).isNotNull()).withColumn("src", F.lit(i)) for i, df in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    winner = union.groupBy(key).agg(F.max("src").alias("src"))
    return union.join(winner, [key, "src"], "left_semi")


def present(joined: DataFrame, condition: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """User-defined join: rows of an outer join whose presence flags meet a condition."""
    flags = {c: F.col(c).isNotNull() for c in joined.columns if c != "key"}
    return joined.where(condition(flags))


def semi(key: str, left: DataFrame, right: DataFrame, absent: bool = False) -> DataFrame:
    """Rows of the left source whose key the right one has (``absent``: lacks): presence without the other side's rows."""
    return left.where(F.col(key).isNotNull()).join(right.select(key), key, "left_anti" if absent else "left_semi")


class JoinExpression:
    """``op(tbl(name), op(...), ...)`` with inner, outer, override and registered operators, over named sources."""

    TOKEN = re.compile(r"\s*([A-Za-z_][\w.]*|[(),])")

    def __init__(self, key: str, sources: dict[str, DataFrame], define: dict[str, Callable[[dict[str, Column]], Column]] | None = None):
        self.key, self.sources, self.define, self.n = key, sources, define or {}, 0

    def run(self, text: str) -> DataFrame:
        tokens, at = [], 0
        while at < len(text.rstrip()):
            m = self.TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            tokens.append(m[1])
            at = m.end()
        self.tokens = tokens
        out = self._node()
        if self.tokens:
            raise ValueError(f"left over: {self.tokens}")
        return out

    def _take(self, want: str | None = None) -> str:
        if not self.tokens or want and self.tokens[0] != want:
            raise ValueError(f"expected {want or 'a name'}, got {self.tokens[:1]}")
        return self.tokens.pop(0)

    def _node(self) -> DataFrame:
        name = self._take()
        self._take("(")
        if name == "tbl":
            source = self._take()
            self._take(")")
            return self.sources[source]
        parts = [self._node()]
        while self.tokens and self.tokens[0] == ",":
            self._take()
            parts.append(self._node())
        self._take(")")
        if name == "override":
            return override(self.key, *parts)
        self.n += 1
        named = {f"s{self.n}_{i}": p for i, p in enumerate(parts)}
        if name == "inner":
            joined = inner(self.key, **named)
        elif name == "outer":
            joined = outer(self.key, **named)
        elif name in self.define:
            joined = present(outer(self.key, **named), self.define[name])
        else:
            raise ValueError(f"no such operator: {name}")
        return joined.withColumnRenamed("key", self.key)


def tagged_join(left: DataFrame, right: DataFrame, key: str, combine: Callable[[Column, Column], Column], cap: int | None = None, order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Two-tag join on a group key: a row of ``combine(left, right)`` for each pair of a group, dropped where null.

    ``cap`` keeps the first so many rows of each tag and group, in the given total orders."""
    sides = [left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())]
    if cap is not None:
        if order is None:
            raise ValueError("a cap needs a total order")
        sides = [df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*o))).where(F.col("_n") <= cap).drop("_n") for df, o in zip(sides, order)]
    joined = _packed(sides[0], key, "l").join(_packed(sides[1], key, "r"), "key", "full")
    return joined.select("key", combine(F.col("l"), F.col("r")).alias("value")).where("value is not null")


def tagged_join_many(key: str, combine: Callable[[dict[str, Column]], Column], **tags: DataFrame) -> DataFrame:
    """(key, value): ``combine`` of one row of each tag, for every choice of rows of a group (null for a tag without
    rows); null results are dropped."""
    joined = outer(key, **tags)
    return joined.select("key", combine({t: F.col(t) for t in tags}).alias("value")).where("value is not null")


def replicated_join(df: DataFrame, small: DataFrame, key: str, how: str = "inner", most_rows: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A join with a side that is sent to every task if it has at most ``most_rows`` rows and about ``most_bytes`` bytes
    as text, else a shuffled one."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))
    measured = small.limit(most_rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    fits = measured["n"] <= most_rows and measured["size"] <= most_bytes
    return df.join(F.broadcast(small) if fits else small.hint("merge"), key, how)


def many_join(op: str, key: str, *sources: DataFrame) -> DataFrame:
    """One operator (inner, outer or override) over any number of sources, as a command line names it."""
    if op == "override":
        return override(key, *sources)
    return {"inner": inner, "outer": outer}[op](key, **{f"s{i}": s for i, s in enumerate(sources)})
