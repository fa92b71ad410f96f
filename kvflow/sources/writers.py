"""Sinks. Existing outputs are refused unless ``mode`` says otherwise; Spark's commit protocol makes them atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_text(key: Column, value: Column, separator: str = "\t") -> Column:
    """Both null: null (no line); one null: the other without separator."""
    both = key.isNull() & value.isNull()
    return F.when(~both, F.concat_ws(separator, key.cast("string"), value.cast("string")))


def write_pairs(df: DataFrame, path: str, key: str = "key", value: str = "value", separator: str = "\t", codec: str | None = None, mode: str = "errorifexists") -> None:
    lines = df.select(pair_text(F.col(key), F.col(value), separator).alias("value")).where("value is not null")
    (lines.write.mode(mode).option("compression", codec) if codec else lines.write.mode(mode)).text(path)


def write_sequence_file(df: DataFrame, path: str, key: str = "key", value: str = "value", codec: str | None = None) -> None:
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path, codec)


def write_map(df: DataFrame, path: str, key: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Sorted key/value files: range partitioned and sorted, so lookups skip by statistics."""
    by = F.col(key)
    ranged = df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)
    ranged.sortWithinPartitions(key).write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_hashed_map(df: DataFrame, path: str, key: str, partitions: int, mode: str = "errorifexists") -> None:
    """Key/value files in one folder for each hash of the key, sorted within."""
    dealt = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
    dealt.repartition(partitions, "part").sortWithinPartitions("part", key).write.mode(mode).partitionBy("part").parquet(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_by(df: DataFrame, path: str, leaf: Column, fmt: str = "parquet", mode: str = "errorifexists", keep: list[Column] | None = None) -> None:
    """Rows to sub-folders by an expression of the row; ``keep`` rewrites what is written of each."""
    df.select(*(["*"] if keep is None else keep), leaf.alias("leaf")).write.mode(mode).partitionBy("leaf").format(fmt).save(path)


def trailing_legs(path: Column, legs: int) -> Column:
    """The last ``legs`` parts of an input path, to name an output after its input."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, -legs, legs), "/")


def write_named(df: DataFrame, outputs: dict[str, tuple[str, Column]], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Several sinks of one input: name to (path, condition). The input is computed once and kept while writing."""
    held = df.persist()
    try:
        for path, condition in outputs.values():
            held.where(condition).write.mode(mode).format(fmt).save(path)
    finally:
        held.unpersist()


def write_jdbc(df: DataFrame, url: str, table: str, fields: list[str] | None = None, mode: str = "append", **options: str) -> None:
    (df.select(*fields) if fields else df).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def split_bad(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that are skipped (null counts as skipped)."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)
