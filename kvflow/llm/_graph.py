"""Connected components by alternating stars: no links, labels or components ever meet on one node."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, written


def forest(pairs) -> list[tuple[int, int]]:
    """(node, least node of its tree) for the given links: fewer links with the same components."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up if root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        if len(held) > 200_000:
            held = forest(held)
    held = forest(held)
    u, v = zip(*held) if held else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large star: a node's greater neighbours hang on its least one; small star: its lesser
    neighbours and itself do. Hot nodes: minima combine on the map side, and both sides of the join can be split."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    moved = seen.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(moved.where("u <> v").distinct(), "star")
    drop(least)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a, b) of longs to (id, root): root is the least id of the component; ids without a link are absent."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(pairs.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    check = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
    seen = check(now)
    for _ in range(max_rounds):
        large = _star(now, True)
        small = _star(large, False)
        drop(now)
        drop(large)
        now, before, seen = small, seen, check(small)
        if seen == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
