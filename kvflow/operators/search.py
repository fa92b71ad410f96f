"""Numeric and combinatorial jobs: quasi-Monte-Carlo pi, exact cover (sudoku, pentomino boards), generators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def halton(index: Column, base: int) -> Column:
    """Radical inverse of index in a base."""
    start = F.struct(index.cast("long").alias("i"), F.lit(1.0 / base).alias("f"), F.lit(0.0).alias("v"))
    digits = 64 if base == 2 else 40
    turn = lambda a, _: F.struct(F.floor(a["i"] / base).cast("long").alias("i"), (a["f"] / base).alias("f"), (a["v"] + (a["i"] % base) * a["f"]).alias("v"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(digits), F.ceil(F.log(float(base), F.greatest(index, F.lit(1)).cast("double"))).cast("int") + 1)))
    return F.aggregate(steps, start, turn, lambda a: a["v"])


def pi_estimate(spark: SparkSession, points: int) -> DataFrame:
    """n_inside, n_total and pi from Halton points (bases 2 and 3) in the unit square around the circle."""
    at = spark.range(1, points + 1)
    x, y = halton(F.col("id"), 2) - 0.5, halton(F.col("id"), 3) - 0.5
    inside = F.sum(F.when(x * x + y * y <= 0.25, 1).otherwise(0))
    return at.agg(inside.cast("long").alias("n_inside"), F.count("*").alias("n_total")).withColumn("pi", 4.0 * F.col("n_inside") / F.col("n_total"))


def exact_cover(rows: dict[str, set], columns: set, optional: frozenset = frozenset()) -> Iterator[list[str]]:
    """All choices of rows that cover every column once (optional ones at most once)."""
    uses = {c: {r for r, cells in rows.items() if c in cells} for c in columns | optional}

    def search(chosen: list[str]):
        need = [c for c in uses if c not in optional]
        if not need:
            yield list(chosen)
            return
        column = min(need, key=lambda c: (len(uses[c]), str(c)))
        for r in sorted(uses[column]):
            removed = {}
            for c in rows[r]:
                for other in uses[c]:
                    for k in rows[other]:
                        if k != c and k in uses:
                            uses[k].discard(other)
                removed[c] = uses.pop(c)
            chosen.append(r)
            yield from search(chosen)
            chosen.pop()
            for c in reversed(list(removed)):
                uses[c] = removed[c]
            for c in rows[r]:
                for other in uses[c]:
                    for k in rows[other]:
                        if k != c and k in uses:
                            uses[k].add(other)

    yield from search([])


def sudoku_rows(board: str, box_rows: int, box_cols: int) -> tuple[dict[str, set], set]:
    """Exact-cover rows of a board: symbols separated by blanks, lines by newlines, '?' for an empty cell."""
    lines = [line.split() for line in board.strip().splitlines()]
    n = box_rows * box_cols
    rows = {}
    for y in range(n):
        for x in range(n):
            given = lines[y][x]
            for v in range(1, n + 1) if given == "?" else [int(given)]:
                box = (y // box_rows) * (n // box_cols) + x // box_cols
                rows[f"{y} {x} {v}"] = {("cell", y, x), ("row", y, v), ("col", x, v), ("box", box, v)}
    return rows, {c for cells in rows.values() for c in cells}


def solve_sudokus(df: DataFrame, board_col: str, box_rows: int = 3, box_cols: int = 3) -> DataFrame:
    """(board, solution): one row per solution, boards spread over tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for board in b.column(0).to_pylist():
                n = box_rows * box_cols
                for chosen in exact_cover(*sudoku_rows(board, box_rows, box_cols)):
                    grid = [[0] * n for _ in range(n)]
                    for y, x, v in (map(int, r.split()) for r in chosen):
                        grid[y][x] = v
                    out.append((board, "\n".join(" ".join(map(str, r)) for r in grid)))
            a, s = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(s, pa.string())], names=["board", "solution"])

    return df.select(F.col(board_col).alias("board")).mapInArrow(work, "board string, solution string")


#: The twelve pentominoes, as rows of cells.
PENTOMINOES = {
    "F": [".##", "##.", ".#."], "I": ["#####"], "L": ["#...", "####"], "N": [".###", "##.."], "P": ["##", "##", "#."], "T": ["###", ".#.", ".#."],
    "U": ["#.#", "###"], "V": ["#..", "#..", "###"], "W": ["#..", "##.", ".##"], "X": [".#.", "###", ".#."], "Y": ["..#.", "####"], "Z": ["##.", ".#.", ".##"],
}


def placements(width: int, height: int, pieces: dict[str, list[str]]) -> dict[str, set]:
    """Every distinct placement of every piece, turned and mirrored, as exact-cover rows."""
    out: dict[str, set] = {}
    for name, art in pieces.items():
        shape = {(y, x) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"}
        seen = set()
        for _ in range(2):
            for _ in range(4):
                top, left = min(y for y, _ in shape), min(x for _, x in shape)
                seen.add(frozenset((y - top, x - left) for y, x in shape))
                shape = {(x, -y) for y, x in shape}
            shape = {(y, -x) for y, x in shape}
        for k, s in enumerate(sorted(map(sorted, seen))):
            for dy in range(height - max(y for y, _ in s)):
                for dx in range(width - max(x for _, x in s)):
                    out[f"{name} {k} {dy} {dx}"] = {name, *((y + dy, x + dx) for y, x in s)}
    return out


def placement_masks(width: int, height: int, pieces: str) -> list[tuple[int, int, int, str]]:
    """(first cell, cells, piece, name) of every placement, cells and pieces as bits; cells are numbered along the
    shorter side, which keeps the search narrow."""
    short = min(width, height)
    number = lambda y, x: (y * width + x) if width == short else (x * height + y)
    out = []
    for name, cells in placements(width, height, {p: PENTOMINOES[p] for p in pieces}).items():
        mask = sum(1 << number(*c) for c in cells if isinstance(c, tuple))
        out.append((mask & -mask, mask, 1 << pieces.index(name[0]), name))
    return sorted(out)


def pentomino_tilings(spark: SparkSession, width: int, height: int, pieces: str = "FILNPTUVWXYZ", tasks: int = 32) -> DataFrame:
    """(solution): every tiling of a board of at most 63 cells with each piece once, as placements in the order of their
    first cells. Partial boards are rows: each round fills the first free cell of each by a join with the placements
    that begin there (a table bounded by the board); now and then the boards are dealt to ``tasks`` tasks."""
    if width * height != 5 * len(pieces) or width * height > 63:
        raise ValueError("the pieces do not fill the board")
    known = F.broadcast(spark.createDataFrame(placement_masks(width, height, pieces), "first long, cells long, piece long, name string"))
    boards = spark.range(1).select(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("used"), F.lit("").alias("solution"))
    for turn in range(len(pieces)):
        free = F.bitwise_not("filled").bitwiseAND(F.col("filled") + 1)
        fits = (F.col("filled").bitwiseAND(F.col("cells")) == 0) & (F.col("used").bitwiseAND(F.col("piece")) == 0)
        joined = boards.withColumn("first", free).join(known, "first").where(fits)
        boards = joined.select(F.col("filled").bitwiseOR(F.col("cells")).alias("filled"), F.col("used").bitwiseOR(F.col("piece")).alias("used"), F.concat("solution", F.lit("; " if turn else ""), "name").alias("solution"))
        boards = boards.repartition(tasks) if turn % 3 == 1 else boards  # short stages compile well
    return boards.select("solution")


def tera_rows(spark: SparkSession, n: int) -> DataFrame:
    """(key, row_id, filler): n rows of a 10-character printable key, a 10-character number and 78 filler letters."""
    digest = F.md5(F.col("id").cast("string"))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    key = F.concat(*[F.char(byte(i) % 95 + 32) for i in range(10)])
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.repeat(F.char((F.pmod(F.col("id") * 8 + i, F.lit(26)) + 65).cast("int")), 10)), "")
    return spark.range(n).select(key.alias("key"), F.lpad(F.col("id").cast("string"), 10, " ").alias("row_id"), F.substring(letters, 1, 78).alias("filler"))


def random_bytes(spark: SparkSession, n: int, least: int, most: int, seed: int = 0) -> DataFrame:
    """(key, value): byte strings of ``least`` to ``most`` bytes, reproducible by seed."""
    count = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(most - least + 1)).cast("int") + least
    blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(count / 32).cast("int")), lambda i: F.sha2(F.concat_ws(":", F.col("id").cast("string"), i.cast("string"), F.lit(str(seed))), 256)), "")
    return spark.range(n).select(F.col("id").alias("key"), F.unhex(F.substring(blocks, F.lit(1), 2 * count)).alias("value"))


def random_text(spark: SparkSession, n: int, words: list[str], least: int, most: int, seed: int = 0) -> DataFrame:
    """(key, value): word sequences of ``least`` to ``most`` words, reproducible by seed."""
    count = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(most - least + 1)).cast("int") + least
    vocabulary = F.array(*map(F.lit, words))
    text = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(vocabulary, (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed + 1)), F.lit(len(words))) + 1).cast("int"))), " ")
    return spark.range(n).select(F.col("id").alias("key"), text.alias("value"))
