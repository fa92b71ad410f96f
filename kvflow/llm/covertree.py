"""Embedding near-dedup by dual traversal of cover trees: exact pairs with cosine at or above a threshold.

Cosine >= c is a chord of at most sqrt(2 - 2c) between unit vectors, so the triangle inequality prunes. The top level
is a net of pivots from a bounded sample; every distinct vector joins its nearest pivot's cell, and cells are dealt in
blocks of at most ``block`` vectors; there are more pivots for more rows, up to ``most_top``. Each block gets a cover tree: nested nets of radius 1, 1/2, 1/4, ... in which a
node covers a contiguous range of points within its measured radius. Blocks of two cells meet unless the pivots'
distance exceeds both cell radii plus the threshold; consecutive blocks form groups, and a block is shipped once to
each pair of groups in which it may find links. Where blocks meet, the trees are traversed together: a pair of nodes
is dropped if their distance exceeds both radii plus the threshold, taken whole if distance plus radii lies below it
(so a dense group costs a few node pairs, not all pairs), else replaced by the pairs of their children; at the last
level the cosine is computed in double precision.

Copies are compared once and counted by weight. Links leave a task as counts per vector and a spanning forest, never
as pairs. Defined cases: null, zero and non-finite vectors and null ids link with nothing (n_links 0, component of
their own); vectors of different length never link; repeated rows link as copies; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components, forest
from ._store import drop, written
from ._vectors import matrix, packed_vectors, sample, unit

#: Slack of the bounds: rounding never decides a pruning (the first level is in single precision).
SLACK = 1e-3


def pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first points: prefixes of this order are nested nets of falling radius."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(most, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


class CoverTree:
    """Levels of (centre, radius, first point, end) over points put in tree order; the last level is the points."""

    def __init__(self, u: np.ndarray, depth: int = 7):
        order = np.arange(len(u))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        groups, reach = [order], 1.0
        for _ in range(depth):
            nodes = []
            for g in groups:
                nodes += [g] if len(g) == 1 else self._net(u, g, reach)
            self.levels.append(self._level(u, nodes))
            groups, reach = nodes, reach / 2
            if all(len(g) == 1 for g in groups):
                break
        self.order = np.concatenate(groups) if groups else order
        n = np.arange(len(u))
        self.levels.append((n, np.zeros(len(u)), n, n + 1))
        # a node's centre is its first point, so centres are places in the order, too
        self.u = u[self.order]

    @staticmethod
    def _net(u: np.ndarray, g: np.ndarray, reach: float) -> list[np.ndarray]:
        out, least = [], 1 - reach * reach / 2  # the cosine of a chord of length reach
        rest, x = g, u[g]
        while len(rest):
            near = x @ x[0] >= least
            near[0] = True
            out.append(rest[near])
            rest, x = rest[~near], x[~near]
        return out

    @staticmethod
    def _level(u: np.ndarray, nodes: list[np.ndarray]):
        ends = np.cumsum([len(g) for g in nodes])
        starts = ends - [len(g) for g in nodes]
        radius = np.array([0.0 if len(g) == 1 else np.sqrt(np.maximum(0, 2 - 2 * (u[g] @ u[g[0]]).min())) for g in nodes])
        return starts, radius, starts, ends


def _from(levels: list, t: float) -> list:
    """The levels to traverse: a coarse net that gathers hardly any points cannot prune, and only widens the bounds."""
    s, reach = 0, 1.0
    while s < len(levels) - 2 and reach > t and len(levels[s + 1][0]) <= 1.25 * len(levels[s][0]):
        s, reach = s + 1, reach / 2
    return levels[s:]


def _children(level, below) -> tuple[np.ndarray, np.ndarray]:
    """For each node: the range of nodes below it."""
    return np.searchsorted(below[2], level[2]), np.searchsorted(below[2], level[3])


def _pairs(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the ranges [a0, a1) x [b0, b1), for each entry."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[at] + k // nb[at], b0[at] + k % nb[at]


def dual_traversal(ta: CoverTree, tb: CoverTree, xa: np.ndarray, xb: np.ndarray, wa: np.ndarray, wb: np.ndarray, cosine: float):
    """Links between the points of two trees (in tree order), or within one if they are the same object: weight linked
    to each point of a, of b, and spanning (place in a, place in b). A point counts itself once in its own tree."""
    same = ta is tb
    t = np.sqrt(2 - 2 * cosine)
    ca, cb = np.r_[0, np.cumsum(wa)], np.r_[0, np.cumsum(wb)]
    da, db = np.zeros(len(wa) + 1, np.int64), np.zeros(len(wb) + 1, np.int64)
    links_a: list[np.ndarray] = []
    links_b: list[np.ndarray] = []
    la, lb = _from(ta.levels, t), _from(tb.levels, t)
    depth = max(len(la), len(lb))
    la = la + [la[-1]] * (depth - len(la))
    lb = lb + [lb[-1]] * (depth - len(lb))
    whole_a, whole_b = np.zeros(len(wa), bool), np.zeros(len(wb), bool)

    def take(level_a, level_b, i, j):
        np.add.at(da, level_a[2][i], cb[level_b[3][j]] - cb[level_b[2][j]])
        np.add.at(da, level_a[3][i], -(cb[level_b[3][j]] - cb[level_b[2][j]]))
        other = np.flatnonzero(i != j) if same else np.arange(len(i))
        np.add.at(db, level_b[2][j[other]], (ca[level_a[3][i]] - ca[level_a[2][i]])[other])
        np.add.at(db, level_b[3][j[other]], -(ca[level_a[3][i]] - ca[level_a[2][i]])[other])
        links_a.append(level_a[0][i])
        links_b.append(level_b[0][j])
        # every point of a node taken whole is linked to the other node's centre; once a node is enough
        for level, other_level, k, o, seen, ends, others in ((level_a, level_b, i, j, whole_a, links_a, links_b), (level_b, level_a, j, i, whole_b, links_b, links_a)):
            wide, first = np.unique(k[level[3][k] - level[2][k] > 1], return_index=True)
            o = o[level[3][k] - level[2][k] > 1][first]
            for node, centre in zip(wide.tolist(), other_level[0][o].tolist()):
                lo, hi = level[2][node], level[3][node]
                if not seen[lo:hi].all():
                    seen[lo:hi] = True
                    ends.append(np.arange(lo, hi))
                    others.append(np.full(hi - lo, centre))

    i = j = np.zeros(0, np.int64)
    fa, fb = ta.u.astype(np.float32), tb.u.astype(np.float32)
    for k in range(depth):
        A, B = la[k], lb[k]
        if k == 0:  # all pairs of the top nets, by blocks of a matrix product
            found = []
            centres = fb[B[0]].T.copy()
            least = lambda r: np.float32(1) - (np.float32(t + SLACK) + r.astype(np.float32)) ** 2 / 2  # noqa: E731  the cosine of a chord
            wide_b = np.flatnonzero(B[1])
            for lo in range(0, len(A[0]), 256):
                dot = fa[A[0][lo : lo + 256]] @ centres
                near = dot >= least(np.zeros(1))
                ra = A[1][lo : lo + 256]
                wide_a = np.flatnonzero(ra)
                near[wide_a] |= dot[wide_a] >= least(ra[wide_a, None] + B[1][None, :])
                near[:, wide_b] |= dot[:, wide_b] >= least(ra[:, None] + B[1][None, wide_b])
                found.append(np.stack(np.nonzero(near)) + [[lo], [0]])
            i, j = np.concatenate(found, 1) if found else (i, j)
            if same:
                i, j = i[i <= j], j[i <= j]
        else:
            a0, a1 = _children(la[k - 1], A) if la[k] is not la[k - 1] else (np.arange(len(A[0])), np.arange(len(A[0])) + 1)
            b0, b1 = _children(lb[k - 1], B) if lb[k] is not lb[k - 1] else (np.arange(len(B[0])), np.arange(len(B[0])) + 1)
            i, j = _pairs(a0[i], a1[i], b0[j], b1[j])
            if same:
                i, j = i[i <= j], j[i <= j]
        left_i, left_j = [], []
        for lo in range(0, len(i), 200_000):
            p, q = i[lo : lo + 200_000], j[lo : lo + 200_000]
            x, y = A[0][p], B[0][q]
            if k == depth - 1:
                dot = (xa[x] * xb[y]).sum(1)
                ok = dot / (np.sqrt((xa[x] * xa[x]).sum(1)) * np.sqrt((xb[y] * xb[y]).sum(1))) >= cosine
                if same:
                    ok |= x == y
                take(A, B, p[ok], q[ok])
                continue
            d = np.sqrt(np.maximum(0, 2 - 2 * (ta.u[x] * tb.u[y]).sum(1)))
            if same:
                d[x == y] = 0
            r = A[1][p] + B[1][q]
            whole = d + r < t - SLACK
            if whole.any():
                take(A, B, p[whole], q[whole])
            more = ~whole & (d <= t + r + SLACK)
            left_i.append(p[more])
            left_j.append(q[more])
        if k < depth - 1:
            i, j = (np.concatenate(left_i), np.concatenate(left_j)) if left_i else (i[:0], j[:0])
    ends = [(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (links_a, links_b)]
    return np.cumsum(da)[:-1], np.cumsum(db)[:-1], ends[0], ends[1]


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b.column("x").to_pylist()
            cell, far = [""] * len(xs), [0.0] * len(xs)
            dims = np.array([len(x) // 8 for x in xs])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in shared.value:  # a length that the sample lacks: one cell of its own, never pruned
                    for i in at:
                        cell[i], far[i] = f"{d}:0", 2.0
                    continue
                s = unit(matrix([xs[i] for i in at])) @ shared.value[d].T
                for i, c, v in zip(at, s.argmax(1), s.max(1)):
                    cell[i], far[i] = f"{d}:{c}", float(np.sqrt(max(0.0, 2 - 2 * v)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), b.column("x"), pa.array(cell), pa.array(far)], names=["rep", "n", "x", "cell", "far"])

    return assign


def numbered(cells: dict[str, tuple[float, int, int]], bound: int) -> tuple[dict[str, int], list[int]]:
    """The number of each cell's first block, and the group of each block: consecutive blocks of one vector length until
    they hold ``bound`` rows. ``cells``: radius, blocks and rows of each."""
    first, group, held, last = {}, [], 0, None
    for name in sorted(cells, key=lambda c: [int(x) for x in c.split(":")]):
        _, blocks, rows = cells[name]
        first[name], dim = len(group), name.split(":")[0]
        for _ in range(blocks):
            new = last is None or dim != last or held + rows / blocks > bound
            group.append((group[-1] + 1 if group else 0) if new else group[-1])
            held, last = (0 if new else held) + rows / blocks, dim
    return first, group


def _meet(shared, cells: dict[str, tuple[float, int, int]], first: dict[str, int], group: list[int], cosine: float):
    """Blocks (rows sorted by block) to one row for each pair of groups in which they may find links: the pair, the
    block's number and those of the blocks it may link with."""
    t = np.sqrt(2 - 2 * cosine)

    def partners(cell: str, x: np.ndarray) -> list[int]:
        d = cell.split(":")[0]
        out = []
        for other, (radius, blocks, _) in cells.items():
            if not other.startswith(d + ":"):
                continue
            if other != cell and int(d) in shared.value:
                gap = np.sqrt(max(0, 2 - 2 * (x @ shared.value[int(d)][int(other.split(":")[1])]).max()))
                if gap > radius + t + SLACK:  # no point of this block comes near the other cell
                    continue
            out += range(first[other], first[other] + blocks)
        return out

    def emit(cell, block, rep, n, xs):
        me = first[cell] + block
        x = matrix(xs)
        tree = CoverTree(unit(x))
        o = tree.order
        packed = pickle.dumps((np.array(rep)[o], np.array(n)[o], x[o], tree.levels), protocol=5)
        by_group: dict[int, list[int]] = {}
        for you in partners(cell, tree.u):
            by_group.setdefault(group[you], []).append(you)
        for other, blocks in by_group.items():
            yield (f"{min(group[me], other)}-{max(group[me], other)}", me, blocks, packed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            if held:
                c, k, rep, n, xs = zip(*held)
                for row in emit(c[0], k[0], rep, n, list(xs)):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.list_(pa.int32())), pa.array([row[3]], pa.binary())], names=["pair", "me", "partners", "packed"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("cell", "block", "rep", "n", "x"))):
                if held and held[0][:2] != r[:2]:
                    yield from flush()
                    held = []
                held.append(r)
        yield from flush()

    return meet


def _link(cosine: float, group: list[int]):
    """The blocks of a pair of groups to counts (kind 0) and spanning links (kind 1). Holds the blocks of two groups."""

    def unpack(packed):
        ids, n, x, levels = pickle.loads(packed)
        tree = CoverTree.__new__(CoverTree)  # built where the block was made
        tree.levels, tree.u = levels, unit(x)
        return ids, n, x, tree

    def between(one: tuple, other: tuple) -> pa.RecordBatch:
        (ia, wa, xa, ta), (ib, wb, xb, tb) = one, other
        na, nb, ea, eb = dual_traversal(ta, tb, xa, xb, wa, wb, cosine)
        if tb is ta:
            na, nb = na + nb, nb[:0]
        a, b = [], []
        for ids, n in ((ia, na), (ib[: len(nb)], nb)):
            at = np.flatnonzero(n)
            a += ids[at].tolist()
            b += n[at].tolist()
        kind = [0] * len(a)
        tree = forest(zip(ia[ea].tolist(), ib[eb].tolist()))
        a += [u for u, _ in tree]
        b += [v for _, v in tree]
        return pa.RecordBatch.from_arrays([pa.array(kind + [1] * len(tree), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def work(pair: str, held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        lo, hi = map(int, pair.split("-"))
        opened = {k: unpack(packed) for k, (_, packed) in held.items()}
        for i in (k for k in held if group[k] == lo):
            for j in (k for k in held if group[k] == hi):
                if (lo != hi or i <= j) and j in held[i][0] and i in held[j][0]:
                    yield between(opened[i], opened[j])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                pair, me, partners, packed = (batch.column(c)[k].as_py() for c in ("pair", "me", "partners", "packed"))
                if pair != now and held:
                    yield from work(now, held)
                    held = {}
                now = pair
                held[me] = (set(partners), packed)
        if held:
            yield from work(now, held)

    return link


def embedding_components(table: DataFrame, *, cosine: float = 0.9, top: int = 16, most_top: int = 512, block: int = 4096, group_blocks: int = 8, sample_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = table.sparkSession
    rows = written(packed_vectors(table, id_col, vector_col).withColumn("key", F.md5("x")), "vectors")
    distinct = written(rows.where("x is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")), "distinct")
    n = distinct.count()
    # more pivots for more rows: at most ``most_top`` for each vector length in the bounded sample
    net = {d: pivots(x, max(top, min(most_top, n // (2 * block)))) for d, x in sample(distinct.withColumnRenamed("rep", "vec_id"), sample_rows).items()}
    shared = spark.sparkContext.broadcast(net)
    celled = written(distinct.select("rep", "n", "x").mapInArrow(_assign(shared), "rep long, n long, x binary, cell string, far double"), "cells")
    # one row a cell: bounded by the pivots
    cells = {r["cell"]: (r["radius"], -(-r["rows"] // block), r["rows"]) for r in celled.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows")).collect()}
    first, group = numbered(cells, max(block // 2, min(group_blocks * block, n // 12)))
    sizes = F.create_map(*[F.lit(v) for c, (_, blocks, _) in sorted(cells.items()) for v in (c, blocks)]) if cells else None
    dealt = celled.withColumn("block", F.pmod(F.xxhash64("rep"), F.element_at(sizes, F.col("cell")) if cells else F.lit(1)).cast("int"))
    met = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_meet(shared, cells, first, group, cosine), "pair string, me int, partners array<int>, packed binary")
    found = written(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(_link(cosine, group), "kind int, a long, b long"), "links")
    drop(celled)
    counts = found.where("kind = 0").groupBy("a").agg((F.sum("b") - 1).alias("links"))
    roots = connected_components(found.where("kind = 1").select("a", "b"))
    per_rep = distinct.select("key", "rep").join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("id"), "left")
    per_rep = written(per_rep.select("key", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "reps")
    drop(distinct, found)
    out = rows.select("vec_id", "key").join(per_rep, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
