"""Vector columns as fixed-width bytes, and small clusterings on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
            x = np.array(v, "<f8") if i is not None and v and None not in v else None
            most = np.abs(x).max() if x is not None else 0
            if not 0 < most < np.inf:  # also false if a component is not a number
                out.append(None)
                continue
            if not 1e-140 < most < 1e140:  # a power of two changes no digit and no cosine, but squares then fit in doubles
                x = np.ldexp(x, -int(np.frexp(most)[1]))
            out.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "x"])


def packed_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: every row, with its vector as little-endian doubles, or null if it cannot be compared: it or its id is
    null, it is empty or zero, or has a null or non-finite component. Vectors of extreme magnitude are scaled by a power
    of two."""
    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_checked, "vec_id long, x binary")


def matrix(column: pa.Array | list) -> np.ndarray:
    items = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(items), "<f8").reshape(len(items), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sample(vectors: DataFrame, bound: int) -> dict[int, np.ndarray]:
    """At most ``bound`` vectors, chosen by a hash of their id, as unit rows by dimension."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("x").toArrow().column("x").to_pylist()
    by_dim: dict[int, list[bytes]] = {}
    for x in got:
        by_dim.setdefault(len(x) // 8, []).append(x)
    return {d: unit(matrix(x)) for d, x in by_dim.items()}


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centroids; ties go to the lower one, empty ones are set anew on the points worst served."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float64)
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(-d[np.arange(len(x)), at], kind="stable")[: empty.size]]
    return c
