"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

The index (centroids and codebooks, a few MB) is fitted on a sample of at most ``sample_rows`` vectors; every valid row
is indexed: its nearest cell, and a code of ``parts`` bytes for its residual in units of the cell's own spread, so a
dense cell is resolved as finely as a wide one. There are about as many cells as the root of the rows, as far as the
sample can fit them. A query probes its nearest cells: the least number that finds ``aim`` of the true neighbours in the
sample, and further ones where these hold too few other rows. Asymmetric distance tables rank the codes of a probed
cell; the ``rerank`` best of all cells are joined with their vectors and rescored exactly.

Only codes travel: cells, in an order in which near ones follow each other, are packed into chunks of bounded rows
(larger cells are split by row), queries into blocks by their home cells, and a chunk goes to the blocks that probe it.
A row whose approximate score is below the ``rerank``-th best of the query's probed rows of the sample cannot be among
the ``rerank`` best of all, so it is left out at once: what a block gives out is bounded, and no candidate is lost.
Vectors of a length that the sample lacks are searched exactly, in blocks.

Defined cases: null and zero vectors, those with null or non-finite components, and null ids take no part, neither as
query nor as candidate; only vectors of one length are compared; rows of the query's own id are no candidates; repeated
rows of one id ask once, with the least of their vectors, and are candidates each; ties go to the smaller id; extra
columns are not read; a table without usable vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import drop, written
from ._vectors import kmeans, matrix, packed_vectors, sample, unit


class Index:
    """Coarse centroids, the spread of each cell and residual codebooks, for one vector length."""

    def __init__(self, centroids: np.ndarray, spread: np.ndarray, books: list[np.ndarray], probes: int = 0):
        self.centroids, self.spread, self.books, self.probes = centroids, spread, books, probes
        self.cuts = np.linspace(0, centroids.shape[1], len(books) + 1).astype(int)

    @staticmethod
    def fit(x: np.ndarray, cells: int, parts: int, aim: float, neighbours: int) -> Index:
        centroids = kmeans(x, max(1, min(cells, len(x) // 8)), 8)
        centroids = centroids[chain(centroids)]
        home = nearest(centroids, x, 1)[:, 0]
        residual = x - centroids[home]
        n = np.maximum(1, np.bincount(home, minlength=len(centroids)))
        spread = np.sqrt(np.bincount(home, weights=(residual**2).sum(1), minlength=len(centroids)) / n)
        spread[spread < 1e-9] = 1.0
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        scaled = residual / spread[home][:, None]
        out = Index(centroids, spread, [kmeans(scaled[:, a:b], 256, 6) for a, b in zip(cuts, cuts[1:])])
        out.probes = out._calibrated(x, home, aim, neighbours)
        return out

    def plain(self) -> tuple:
        """As plain values, for a broadcast."""
        return self.centroids, self.spread, self.books, self.probes

    def _calibrated(self, x: np.ndarray, home: np.ndarray, aim: float, neighbours: int) -> int:
        cells = len(self.centroids)
        if len(x) <= neighbours:
            return cells
        queries = x[:: max(1, len(x) // 256)]
        s = queries @ x.T
        s[s > 1 - 1e-12] = -2  # the query itself
        true = np.argsort(-s, 1)[:, :neighbours]
        place = np.argsort(nearest(self.centroids, queries, cells), 1)  # of each cell in each query's order
        depth = np.sort(place[np.arange(len(queries))[:, None], home[true]].ravel())
        return int(depth[min(len(depth) - 1, int(np.ceil(aim * len(depth))) - 1)]) + 1

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = (x - self.centroids[cell]) / self.spread[cell][:, None]
        out = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            out[:, m] = ((book * book).sum(1)[None, :] - 2 * r[:, self.cuts[m] : self.cuts[m + 1]] @ book.T).argmin(1)
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part the inner products of its code words with the queries: (256, queries)."""
        return [(book @ q[:, a:b].T).astype(np.float32) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])]

    def scores(self, tables: list[np.ndarray], q: np.ndarray, which: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of the rows of one cell with the queries ``which``: (rows, queries)."""
        out = np.zeros((len(codes), len(which)), np.float32)
        for table, code in zip(tables, codes.T):
            out += table[:, which][code]
        return out * np.float32(self.spread[cell]) + (q[which] @ self.centroids[cell]).astype(np.float32)


def nearest(centroids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    d = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    return d.argmin(1)[:, None] if k == 1 else np.argsort(d, 1, kind="stable")[:, :k]


def chain(c: np.ndarray) -> np.ndarray:
    """An order in which each point is followed by the nearest one left."""
    left, out = np.arange(1, len(c)), [0]
    while len(left):
        at = int(((c[left] - c[out[-1]]) ** 2).sum(1).argmin())
        out.append(int(left[at]))
        left = np.delete(left, at)
    return np.array(out)


def by_cell(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cells, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if len(part):
            yield int(cells[part[0]]), part


def _dims(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    xs = batch.column("x").to_pylist()
    return xs, np.array([len(x) // 8 for x in xs], np.int64)


def _index(shared):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = {d: Index(*plain) for d, plain in shared.value.items()}
        for b in batches:
            xs, dims = _dims(b)
            for d, ix in fitted.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    u = unit(matrix([xs[i] for i in at]))
                    c = nearest(ix.centroids, u, 1)[:, 0]
                    codes = [r.tobytes() for r in ix.codes(u, c)]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("vec_id").take(take), pa.array([d] * len(at), pa.int32()), pa.array(c, pa.int32()), pa.array(codes, pa.binary())], names=["row", "vec_id", "dim", "cell", "codes"])

    return index


def packed(sizes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the consecutive chunks of each cell: cells share a chunk until it holds ``bound`` rows, and a
    larger cell has chunks of its own."""
    first, number, now, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > bound:
            now, held = now + 1, 0
        first[i], number[i] = now, max(1, -(-n // bound))
        held += n
        if held >= bound:
            now, held = now + int(number[i]), 0
    return first, number


def _probe(shared, layout, known, neighbours: int, rerank: int):
    """Queries to one row for each chunk they probe: the probed cells of it, and the score below which a row of the
    probed cells cannot be among the ``rerank`` best. ``known`` has cells and codes of the sample."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = {d: Index(*plain) for d, plain in shared.value.items()}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                xs, dims = _dims(b)
                own = np.array(b.column("own").to_pylist(), np.int64)
                for d, ix in fitted.items():
                    at = np.flatnonzero(dims == d)
                    if not len(at):
                        continue
                    u = unit(matrix([xs[i] for i in at]))
                    held, first, number, block, blocks = layout.value[d]
                    order = nearest(ix.centroids, u, len(ix.centroids))
                    enough = (held[order].cumsum(1) < (own[at] + neighbours)[:, None]).sum(1) + 1
                    depth = np.minimum(np.maximum(enough, ix.probes), order.shape[1])
                    probed = np.zeros(order.shape, bool)
                    for i, (cs, k) in enumerate(zip(order, depth.tolist())):
                        probed[i, cs[:k]] = True
                    asked = np.array(b.column("row").to_pylist(), np.int64)[at]
                    cells, codes = known.value[d]
                    tables, rows = ix.tables(u), np.full((len(cells), len(at)), -np.inf, np.float32)
                    for c, of in by_cell(cells):
                        which = np.flatnonzero(probed[:, c])
                        if len(which):
                            rows[np.ix_(of, which)] = ix.scores(tables, u, which, c, codes[of])
                    out = []
                    for i, j in enumerate(at.tolist()):
                        k = rerank + int(own[j])  # rows of the query's own id are no candidates
                        floor = float(np.partition(rows[:, i], -k)[-k]) if len(cells) >= k else -np.inf
                        cs = np.flatnonzero(probed[i] & (held > 0))
                        home = int(block[order[i, 0]] + asked[i] % blocks[order[i, 0]])
                        chunk = np.concatenate([np.arange(first[c], first[c] + number[c]) for c in cs] or [np.zeros(0, np.int64)])
                        cell = np.repeat(cs, number[cs])
                        for n, part in by_cell(chunk):
                            out.append((j, d, n, home, floor, cell[part].tolist()))
                    row, dim, chunk, home, floor, cell = zip(*out) if out else [()] * 6
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("vec_id").take(take), b.column("x").take(take), *(pa.array(v, t) for v, t in ((dim, pa.int32()), (chunk, pa.int64()), (home, pa.int64()), (floor, pa.float32()), (cell, pa.list_(pa.int32()))))], names=["q", "query_id", "x", "dim", "chunk", "block", "floor", "cells"])

    return probe


PROBES = "q long, query_id long, x binary, dim int, chunk long, block long, floor float, cells array<int>"
CANDIDATES = "q long, row long, vec_id long, about float"


def best_codes(ix: Index, q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, probed: list[list[int]], ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, rerank: int):
    """(query, row, score) numbers of each query's ``rerank`` best codes in one chunk, by asymmetric distance."""
    asks: dict[int, list[int]] = {}
    for i, cs in enumerate(probed):
        for c in cs:
            asks.setdefault(c, []).append(i)
    tables = ix.tables(q)
    query, row, score = [], [], []
    for c, of in by_cell(cells):
        which = np.array(asks.get(c, ()), np.int64)
        if len(which):
            s = ix.scores(tables, q, which, c, codes[of])
            r, k = np.nonzero((s >= floor[which][None, :]) & (ids[of][:, None] != query_ids[which][None, :]))
            query.append(which[k])
            row.append(of[r])
            score.append(s[r, k])
    if not query:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float32)
    query, row, score = np.concatenate(query), np.concatenate(row), np.concatenate(score)
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = place < rerank
    return query[keep], row[keep], score[keep]


def _search(shared, rerank: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]]
        if rows.num_rows and queries.num_rows:
            ix = Index(*shared.value[rows.column("dim")[0].as_py()])
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            row, ids, cells = (np.asarray(rows.column(c)) for c in ("row", "vec_id", "cell"))
            for lo in range(0, queries.num_rows, 256):
                part = queries.slice(lo, 256)
                q = unit(matrix(part.column("x").to_pylist()))
                asked, query_ids, floor = (np.asarray(part.column(c)) for c in ("q", "query_id", "floor"))
                k, r, s = best_codes(ix, q, query_ids, floor, part.column("cells").to_pylist(), ids, cells, codes, rerank)
                for held, v in zip(out, (asked[k], row[r], ids[r], s)):
                    held.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float32())
        return pa.table([pa.array(np.concatenate(v), t) for v, t in zip(out, kinds)], names=["q", "row", "vec_id", "about"])

    return search


FOUND = "query_id long, vec_id long, score double"


def exact(query_id: int, q: bytes, ids: list[int], xs: list[bytes], neighbours: int) -> list[tuple[int, int, float]]:
    """The nearest rows by cosine on the original vectors, ties to the smaller id."""
    x, y = matrix(xs), np.frombuffer(q, "<f8")
    score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum()))
    best = np.lexsort((np.array(ids), -score))[:neighbours]
    return [(query_id, ids[i], float(score[i])) for i in best]


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def _rescored(neighbours: int):
    """Rows sorted by query, the query itself first: its nearest candidates. Holds the candidates of one query."""

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs, out = None, [], [], []
        for b in batches:
            for q, is_query, vec_id, x in zip(*(b.column(c).to_pylist() for c in ("q", "asks", "vec_id", "x"))):
                if is_query:
                    if ids:
                        out += exact(now[0], now[1], ids, xs, neighbours)
                    now, ids, xs = (vec_id, x), [], []
                else:
                    ids.append(vec_id)
                    xs.append(x)
            if len(out) > 10_000:
                yield _found(out)
                out = []
        if ids:
            out += exact(now[0], now[1], ids, xs, neighbours)
        yield _found(out)

    return rescored


def _exact_block(neighbours: int):
    def block(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        ids, xs = rows.column("vec_id").to_pylist(), rows.column("x").to_pylist()
        for q, y in zip(queries.column("vec_id").to_pylist(), queries.column("x").to_pylist()):
            mine = [i for i, v in enumerate(ids) if v != q]
            if mine:
                out += exact(q, y, [ids[i] for i in mine], [xs[i] for i in mine], neighbours)
        return pa.Table.from_batches([_found(out)])

    return block


def _rare(vectors: DataFrame, asked: DataFrame, neighbours: int, block: int) -> DataFrame:
    """The exact search of vectors whose length the sample lacks: blocks of rows against blocks of queries."""
    size = lambda df, name: df.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    dealt = size(vectors, "rows").join(size(asked, "asks"), "dim")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(dealt, "dim").select("dim", F.pmod(F.xxhash64("row"), F.col("rows")).cast("int").alias("r"), spread("asks").alias("a"), "vec_id", "x")
    right = asked.join(dealt, "dim").select("dim", spread("rows").alias("r"), F.pmod(F.xxhash64("row"), F.col("asks")).cast("int").alias("a"), "vec_id", "x")
    keys = ["dim", "r", "a"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_exact_block(neighbours), FOUND)


def nearest_neighbours(
    table: DataFrame, queries: DataFrame | None = None, *, every: int = 50, neighbours: int = 5, parts: int = 32, sample_rows: int = 16_384, most_cells: int = 2048,
    aim: float = 0.98, rerank: int = 128, chunk: int = 65_536, least_chunk: int = 1024, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows by cosine. Queries default to ids divisible by ``every``."""
    spark = table.sparkSession
    dim = (F.octet_length("x") / 8).cast("int")
    vectors = written(packed_vectors(table, id_col, vector_col).where("x is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("dim", dim), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0) if queries is None else packed_vectors(queries, id_col, vector_col).where("x is not null").withColumn("dim", dim)
    asked = asked.groupBy("vec_id").agg(F.min("x").alias("x"), F.count("*").alias("own")).withColumn("dim", dim)
    if queries is not None:  # rows of the table that have the query's id
        asked = asked.drop("own").join(vectors.groupBy("vec_id").agg(F.count("*").alias("own")), "vec_id", "left").fillna(0, ["own"])
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    samples = sample(vectors, sample_rows)
    dims = [F.lit(d) for d in samples] or [F.lit(-1)]
    total = {r["dim"]: r["n"] for r in vectors.where(F.col("dim").isin(*dims)).groupBy("dim").agg(F.count("*").alias("n")).collect()}
    fitted = {d: Index.fit(x, min(most_cells, int(np.ceil(np.sqrt(total[d])))), parts, aim, neighbours) for d, x in samples.items()}
    shared = spark.sparkContext.broadcast({d: ix.plain() for d, ix in fitted.items()})  # bounded by the sample
    homes = {d: nearest(fitted[d].centroids, x, 1)[:, 0] for d, x in samples.items()}
    known = spark.sparkContext.broadcast({d: (homes[d], fitted[d].codes(x, homes[d])) for d, x in samples.items()})  # bounded by the sample
    index = written(vectors.where(F.col("dim").isin(*dims)).mapInArrow(_index(shared), "row long, vec_id long, dim int, cell int, codes binary"), "index")
    # rows of each cell, and which chunks they are in: one entry a cell
    counted = {(r["dim"], r["cell"]): r["n"] for r in index.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    asking = asked.where(F.col("dim").isin(*dims)).mapInArrow(_index(shared), "row long, vec_id long, dim int, cell int, codes binary")
    queried = {(r["dim"], r["cell"]): r["n"] for r in asking.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    layout, chunks, blocks = {}, 0, 0
    for d, ix in fitted.items():
        held = np.array([counted.get((d, c), 0) for c in range(len(ix.centroids))], np.int64)
        first, number = packed(held, max(least_chunk, min(chunk, total[d] // 64)))
        home, homes_of = packed(np.array([queried.get((d, c), 0) for c in range(len(ix.centroids))], np.int64), block)
        layout[d] = held, first + chunks, number, home + blocks, homes_of
        chunks, blocks = int((first + number).max()) + chunks, int((home + homes_of).max()) + blocks
    placed = [(d, c, int(f), int(n)) for d, (_, first, number, *_) in layout.items() for c, (f, n) in enumerate(zip(first, number))]
    cells = spark.createDataFrame(placed, "dim int, cell int, first long, number long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # queries are few bytes, but much work each
    probes = written(asked.where(F.col("dim").isin(*dims)).repartition(tasks, "row").mapInArrow(_probe(shared, spark.sparkContext.broadcast(layout), known, neighbours, rerank), PROBES), "probes")
    chunked = index.join(F.broadcast(cells), ["dim", "cell"]).withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("row"), F.col("number")))  # at most ``most_cells`` rows a length
    left = chunked.join(probes.select(*[F.col(k).alias(k) for k in ("chunk", "block")]).distinct(), "chunk")
    keys = ["chunk", "block"]
    rough = left.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_search(shared, rerank), CANDIDATES)
    best = W.partitionBy("q").orderBy(F.col("about").desc(), "vec_id", "row")
    candidates = written(rough.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("q", "row"), "candidates")
    drop(index, probes)
    pairs = candidates.join(vectors, "row").select("q", F.lit(False).alias("asks"), "vec_id", "x")
    both = pairs.unionByName(asked.select(F.col("row").alias("q"), F.lit(True).alias("asks"), "vec_id", "x"))
    found = both.repartition("q").sortWithinPartitions("q", F.col("asks").desc()).mapInArrow(_rescored(neighbours), FOUND)
    rare = ~F.col("dim").isin(*dims)
    found = found.unionByName(_rare(vectors.where(rare), asked.where(rare), neighbours, block))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
