"""K-means over tables (a driver loop that holds k centroids only) and over one-problem-per-line text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(df: DataFrame, cols: list[str], centroids: list[tuple[float, ...]]) -> DataFrame:
    """``cluster``: the nearest centroid, ties to the lowest; the centroids travel inside the expression."""
    squared = F.array(*[sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, row)), F.lit(0.0)) for row in centroids])
    return df.withColumn("cluster", (F.array_position(squared, F.array_min(squared)) - 1).cast("int"))


def step(df: DataFrame, cols: list[str], centroids: list[tuple[float, ...]]) -> DataFrame:
    """cluster and the mean of each column, one row per non-empty cluster."""
    return assign(df, cols, centroids).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))


def kmeans(df: DataFrame, cols: list[str], centroids: list[tuple[float, ...]], rounds: int = 100, settled: float | None = 1.0) -> DataFrame:
    """cluster, columns, n after ``rounds`` or when every centroid moved ``settled`` or less; an empty cluster keeps
    its centroid as null."""
    now = [tuple(map(float, c)) for c in centroids]
    last = None
    for _ in range(rounds):
        last = {r["cluster"]: r for r in step(df, cols, now).collect()}  # k rows
        new = [tuple(last[k][c] for c in cols) if k in last else now[k] for k in range(len(now))]
        moved = max((np.hypot.reduce(np.subtract(a, b)) if len(cols) > 1 else abs(a[0] - b[0]) for a, b in zip(now, new)), default=0.0)
        now = new
        if settled is not None and moved <= settled:
            break
    rows = [(k, *(now[k] if last is None or k in last else (None,) * len(cols)), last[k]["n"] if last and k in last else 0) for k in range(len(now))]
    return df.sparkSession.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in cols) + ", n long")


def _solve(line: str, dims: int, rounds: int, settled: float | None) -> list[tuple]:
    x = np.array(line.split(), float)
    k, n = int(x[0]), int(x[1])
    c = x[2 : 2 + dims * k].reshape(k, dims)
    p = x[2 + dims * k : 2 + dims * (k + n)].reshape(-1, dims)
    for _ in range(rounds):
        d = ((p[:, None, :] - c[None, :, :]) ** 2).sum(2)
        at = np.where(np.isnan(d), np.inf, d).argmin(1)  # the first of equal ones; an empty cluster attracts nothing
        size = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=p[:, j], minlength=k) for j in range(dims)], 1)
        new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], np.nan)
        moved = np.sqrt(((new - c) ** 2).sum(1))
        c = new
        if settled is not None and not (moved > settled).any():
            break
    return [(j, *(None if np.isnan(v) else float(v) for v in c[j])) for j in range(k)]


def kmeans_lines(df: DataFrame, line_col: str, dims: int, rounds: int | None = None, settled: float | None = None) -> DataFrame:
    """Lines ``k n centroids points`` to (key, cluster, x[, y]); key is the line. 1-D runs 10 rounds, 2-D until moves
    of at most 1.0 or 100 rounds and truncates its means; an empty cluster is null."""
    rounds = rounds or (10 if dims == 1 else 100)
    settled = settled if settled is not None else (None if dims == 1 else 1.0)
    names = ["x", "y"][:dims]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(line, *r) for line in b.column(0).to_pylist() if line and line.strip() for r in _solve(line, dims, rounds, settled)]
            cols = list(zip(*out)) if out else [[]] * (2 + dims)
            kinds = [pa.string(), pa.int32(), *[pa.float64()] * dims]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "cluster", *names])

    out = df.select(line_col).mapInArrow(work, "key string, cluster int, " + ", ".join(f"{n} double" for n in names))
    return out if dims == 1 else out.select("key", "cluster", *[F.col(n).try_cast("int").alias(n) for n in names])
