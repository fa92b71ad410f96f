"""Matrix products: coordinate matrices, cell lines and block lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) x (k, j, v) to (i, j, v): one join on k, then partial sums."""
    joined = a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k")
    return joined.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def matmul_lines(df: DataFrame, line_col: str) -> DataFrame:
    """Lines ``i j a_1..a_T b_1..b_T`` to (i, j, v = sum of a_k b_k over all lines of a cell)."""
    x = numbers(F.col(line_col))
    half = ((F.size(x) - 2) / 2).cast("int")
    products = F.zip_with(F.slice(x, 3, half), F.slice(x, half + 3, half), lambda p, q: p * q)
    cells = df.select(F.element_at(x, 1).cast("long").alias("i"), F.element_at(x, 2).cast("long").alias("j"), F.aggregate(products, F.lit(0.0), lambda s, p: s + p).alias("p"))
    return cells.groupBy("i", "j").agg(F.sum("p").alias("v"))


def block_matmul_lines(df: DataFrame, line_col: str) -> DataFrame:
    """Lines ``i j k m n A(m*m) B(m*m)`` to global cells (row, col, v): C_ij = sum over k of A_ik B_kj."""
    x = numbers(F.col(line_col))
    at = lambda p: F.element_at(x, p)
    m = at(4).cast("int")
    blocks = df.select(at(1).cast("long").alias("i"), at(2).cast("long").alias("j"), m.alias("m"), F.slice(x, 6, m * m).alias("a"), F.slice(x, m * m + 6, m * m).alias("b"))
    cells = blocks.select("*", F.posexplode("a").alias("p", "av")).withColumn("r", F.floor(F.col("p") / F.col("m")).cast("int")).withColumn("k", F.col("p") % F.col("m"))
    row = F.slice("b", F.col("k") * F.col("m") + 1, F.col("m"))
    products = cells.select("i", "j", "m", "r", "av", F.posexplode(row).alias("c", "bv"))
    place = lambda block, inner: F.col("m") * F.col(block) + F.col(inner)
    return products.groupBy(place("i", "r").alias("row"), place("j", "c").alias("col")).agg(F.sum(F.col("av") * F.col("bv")).alias("v"))
