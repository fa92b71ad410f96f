"""Sources: files of lines, key/value pairs, fixed-width and marked records, sequence files, sorted maps, databases.

All read through Spark's file layer, so any URI, glob and compressed file (by suffix) works. Paths may be lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.operators.project import document_operations, split_first


def text_lines(spark: SparkSession, paths: str | list[str], max_length: int | None = None, glob: str | None = None) -> DataFrame:
    """(value, file): lines ended by LF, CR or CRLF; longer ones than ``max_length`` bytes are left out."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    df = reader.text(paths).select("value", F.input_file_name().alias("file"))
    return df if max_length is None else df.where(F.octet_length("value") <= max_length)


def key_value_lines(spark: SparkSession, paths: str | list[str], separator: str = "\t") -> DataFrame:
    key, value = split_first(F.col("value"), separator)
    return spark.read.text(paths).select(key.alias("key"), value.alias("value"))


def sequence_file(spark: SparkSession, path: str, as_text: bool = False, schema: str | None = None) -> DataFrame:
    """(key, value) of a typed binary key/value file, of ``schema`` or inferred types; ``as_text`` makes both strings.
    Spark reads such files as records only, so this is row by row: Parquet is the better store."""
    rows = spark.sparkContext.sequenceFile(path)
    if as_text:
        rows = rows.map(lambda kv: (str(kv[0]), str(kv[1])))
        return spark.createDataFrame(rows, "key string, value string")
    return spark.createDataFrame(rows, schema or ["key", "value"])


def sequence_file_binary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) as bytes: strings by their UTF-8 form, byte arrays unchanged."""
    octets = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else str(x).encode()
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(lambda kv: (octets(kv[0]), octets(kv[1]))), "key binary, value binary")


def output_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a job's output folder: what is hidden (logs, markers, work in progress) is left out."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(str(f.getPath()) for f in found if not f.getPath().getName().startswith(("_", ".")))


def map_probably_has(spark: SparkSession, path: str, key_col: str, key) -> bool:
    """Whether a map may hold a key: row groups whose Bloom filter and statistics rule it out are not read."""
    return not map_get(spark.read.parquet(path).select(key_col), key_col, key).limit(1).isEmpty()


def n_line_splits(df: DataFrame, lines: int, order: list[str]) -> DataFrame:
    """``split``: number of the split of every ``lines`` consecutive records."""
    from kvflow.operators.partition import global_index

    return global_index(df, order).withColumn("split", F.floor((F.col("_i") - 1) / lines)).drop("_i")


def multiple_inputs(*inputs: tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]) -> DataFrame:
    """Each input with its own mapper, united by column name."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [f(df) if f else df for df, f in inputs])


def packed_files(spark: SparkSession, pools: list[list[str]], fmt: str = "text") -> DataFrame:
    """Small files packed into partitions by Spark; files of different pools never share one (``pool`` tells which)."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [spark.read.format(fmt).load(p).withColumn("pool", F.lit(i)) for i, p in enumerate(pools)])


def fixed_width(spark: SparkSession, paths: str | list[str], key_length: int = 10) -> DataFrame:
    """Key (the first ``key_length`` bytes) and value of fixed-width lines."""
    octets = F.col("value").cast("binary")
    return spark.read.text(paths).select(F.substring(octets, 1, key_length).cast("string").alias("key"), F.substring(octets, key_length + 1, 1 << 30).cast("string").alias("value"))


def row_range(spark: SparkSession, rows: int, splits: int | None = None) -> DataFrame:
    return spark.range(0, rows, 1, splits) if splits else spark.range(rows)


def marked_records(texts: DataFrame, text_col: str, begin: str, end: str, max_length: int | None = None, slow_match: bool = False) -> DataFrame:
    """(key, value): the text from each ``begin`` mark to the next ``end`` mark, marks included; the value is empty. With
    ``slow_match`` marks within CDATA sections do not count."""
    inside = r"(?:(?><!\[CDATA\[.*?\]\]>)|(?!<!\[CDATA\[).)*?" if slow_match else ".*?"
    skipped = r"(?:<!\[CDATA\[.*?\]\]>)|" if slow_match else ""
    pattern = f"(?s){skipped}({re.escape(begin)}{inside}{re.escape(end)})"
    out = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("key"), F.lit("").alias("value")).where("key <> ''")
    return out if max_length is None else out.where(F.length("key") <= max_length)


def xml_rows(spark: SparkSession, paths: str | list[str], row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(paths)


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("wholetext", True).text(paths).select("value", F.input_file_name().alias("file"))


def document_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return document_operations(spark.read.text(paths), "value")


def jdbc_table(spark: SparkSession, url: str, table: str, fields: list[str] | None = None, conditions: str | None = None, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; ``bounds`` is (column, lower, upper, partitions) for a parallel read. Filters and columns are
    pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        column, lower, upper, n = bounds
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
    df = reader.load()
    df = df.where(conditions) if conditions else df
    return df.select(*fields) if fields else df


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def map_get(df: DataFrame, key_col: str, key) -> DataFrame:
    """Point lookup in a sorted map: row groups are skipped by their statistics."""
    return df.where(F.col(key_col) == F.lit(key))


def map_range(df: DataFrame, key_col: str, begin=None, end=None) -> DataFrame:
    """The rows from ``begin`` on and before ``end``; an open side is None."""
    if begin is not None:
        df = df.where(F.col(key_col) >= F.lit(begin))
    return df if end is None else df.where(F.col(key_col) < F.lit(end))


def hashed_map_get(spark: SparkSession, path: str, key_col: str, key, partitions: int) -> DataFrame:
    """Point lookup in a map of :func:`kvflow.sources.writers.write_hashed_map`: only the key's folder is read."""
    kept = spark.read.parquet(path)
    kind = kept.schema[key_col].dataType
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast(kind)), F.lit(partitions)).cast("int")).first()[0]
    return kept.where((F.col("part") == part) & (F.col(key_col) == F.lit(key))).drop("part")


def map_closest(df: DataFrame, key_col: str, key, before: bool = False) -> DataFrame:
    """The row at the key, or the nearest after it (before it)."""
    side = df.where(F.col(key_col) <= F.lit(key)) if before else df.where(F.col(key_col) >= F.lit(key))
    return side.orderBy(F.col(key_col).desc() if before else F.col(key_col).asc()).limit(1)


def map_middle(df: DataFrame, key_col: str) -> DataFrame:
    """mid_key: the middle key (the lower one of two)."""
    from kvflow.operators.partition import global_index

    middle = (df.count() - 1) // 2 + 1
    return global_index(df.select(F.col(key_col).alias("mid_key")), ["mid_key"]).where(F.col("_i") == middle).select("mid_key")


def typed_records(df: DataFrame, text_col: str, schema: str, form: str = "csv") -> DataFrame:
    """Records of a declared schema from CSV, XML or JSON text; bad ones are null."""
    parse = {"csv": F.from_csv, "xml": F.from_xml, "json": F.from_json}[form]
    return df.select(parse(F.col(text_col), schema).alias("r")).select("r.*")


def evolved(df: DataFrame, schema: str) -> DataFrame:
    """Rows of an older or newer schema seen through another one: missing columns are null, others are left out."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def python_source(spark: SparkSession, splits: list[str], read: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """A reader of one's own: ``read(split)`` yields rows, one split a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                rows = iter(read(s))
                while part := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    names, arrow = kind.fieldNames(), to_arrow_schema(kind)
    return spark.createDataFrame([(s,) for s in splits], "split string").repartition(max(1, len(splits)), "split").mapInArrow(work, kind)
