"""Record filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partition import global_index


def matching_lines(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """Rows with a find of ``pattern``, and ``hits``: the number of finds (a row counts once per find)."""
    return df.withColumn("hits", F.regexp_count(F.col(text_col), F.lit(pattern)).cast("long")).where("hits > 0")


def key_matches(key: Column, pattern: str) -> Column:
    """The whole key matches."""
    return key.rlike(rf"\A(?:{pattern})\z")


def every_nth(df: DataFrame, order: list[str], frequency: int, within: list[str] | None = None) -> DataFrame:
    """Records 0, f, 2f, ... in the given order, of each reader (``within``) or of all."""
    return global_index(df, order, within=within).where((F.col("_i") - 1) % frequency == 0).drop("_i")


def every_nth_of_reader(df: DataFrame, frequency: int) -> DataFrame:
    """Records 0, f, 2f, ... of each input partition, as its reader numbers them: no shuffle."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_n", at).where(F.col("_n") % frequency == 0).drop("_n")


def md5_long(key: Column) -> Column:
    """First 8 bytes of the digest as a signed big-endian long."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 16), 16, -10).cast("long")


def md5_sample(df: DataFrame, key_col: str, frequency: int) -> DataFrame:
    return df.where(md5_long(F.col(key_col)) % frequency == 0)


def bloom_positions(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key: double hashing of two hashes, shortened so that their sums never overflow."""
    a, b = F.shiftright(F.xxhash64(key), 2), F.shiftright(F.xxhash64(F.lit("second"), key), 20)
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)]


def bloom_bits(key: Column, bits: int, hashes: int) -> Column:
    return F.array_distinct(F.array(*bloom_positions(key, bits, hashes)))


def bloom_filter(keys: DataFrame, key_col: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(words): one row, a Bloom filter as an array of ``bits`` / 64 longs."""
    position = F.explode(F.array(*bloom_positions(F.col("k"), bits, hashes)))
    hit = keys.select(F.col(key_col).alias("k")).where("k is not null").select(position.alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    found = hit.select(F.shiftright("bit", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = found.unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")))
    one = every.groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return one.select(F.transform("w", lambda e: e["mask"]).alias("words"))


def might_contain(words: Column, key: Column, bits: int, hashes: int = 4) -> Column:
    """Whether a key may be among those of a filter: false only if it surely is not. Null keys are never among them."""
    mask = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    tests = [F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(mask(at)) != 0 for at in bloom_positions(key, bits, hashes)]
    return key.isNotNull() & reduce(lambda a, b: a & b, tests)


def bloom_semi_join(df: DataFrame, key_col: str, keys: DataFrame, other_col: str, bits: int | None = None, hashes: int = 4, most_bits: int = 1 << 26) -> DataFrame:
    """Rows whose key may be among ``keys``: never loses one that is, and lets about 2 % of the others pass.

    The filter is one bitmap of ten bits a distinct key (counted approximately), tested in a projection: no row is
    shuffled. It has at most ``most_bits`` bits (8 MB); more keys than that are joined exactly instead."""
    if bits is None:
        n = keys.agg(F.approx_count_distinct(other_col).alias("n")).first()["n"]
        bits = max(1 << 10, 1 << (10 * n - 1).bit_length()) if n else 1 << 10
        if bits > most_bits:
            return df.join(keys.select(F.col(other_col).alias(key_col)), key_col, "left_semi").select(*df.columns)
    words = bloom_filter(keys, other_col, bits, hashes).scalar()
    return df.where(might_contain(words, F.col(key_col), bits, hashes))


def counting_filter(keys: DataFrame, key_col: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(bit, n): how many rows (repeats included) set each bit. Filters over the same bits merge by summing."""
    return keys.where(F.col(key_col).isNotNull()).select(F.explode(bloom_bits(F.col(key_col), bits, hashes)).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))


def filter_without(counted: DataFrame, keys: DataFrame, key_col: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """A counting filter after its rows ``keys`` are deleted."""
    gone = counting_filter(keys, key_col, bits, hashes).select("bit", (-F.col("n")).alias("n"))
    return counted.unionByName(gone).groupBy("bit").agg(F.sum("n").alias("n")).where("n > 0")


def approximate_counts(df: DataFrame, key_col: str, counted: DataFrame, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(key, n): for each distinct key the least counter of its bits, never below its true count, 0 if surely absent."""
    own = df.select(F.col(key_col).alias("key")).where("key is not null").distinct().withColumn("own", bloom_bits(F.col("key"), bits, hashes))
    found = own.select("key", F.size("own").alias("need"), F.explode("own").alias("bit")).join(F.broadcast(counted), "bit", "left")  # at most ``bits`` rows
    least = found.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return least.select("key", F.col("n").cast("long").alias("n"))


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))


def slices_for(keys: DataFrame, key_col: str, bits: int = 1 << 16) -> int:
    """Slices of ``bits`` bits that give each distinct key (counted approximately) ten bits."""
    n = keys.agg(F.approx_count_distinct(key_col).alias("n")).first()["n"]
    return max(1, -(-10 * n // bits))


def dynamic_filter(keys: DataFrame, key_col: str, slices: int, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(slice, bit): a row of filters that keeps its error rate as keys grow, if ``slices`` grows with them (see
    :func:`slices_for`); a key belongs to one slice by its hash."""
    rows = keys.select(F.col(key_col).alias("k")).where("k is not null")
    return rows.select(slice_of(F.col("k"), slices).alias("slice"), F.explode(bloom_bits(F.col("k"), bits, hashes)).alias("bit")).distinct()


def dynamic_semi_join(df: DataFrame, key_col: str, filters: DataFrame, slices: int, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Rows whose key may be in a dynamic filter. Its size grows with the keys, so it is joined and not broadcast."""
    own = df.select(F.col(key_col).alias("_k")).where("_k is not null").distinct().withColumn("_own", bloom_bits(F.col("_k"), bits, hashes))
    asked = own.select("_k", F.size("_own").alias("_n"), slice_of(F.col("_k"), slices).alias("slice"), F.explode("_own").alias("bit"))
    kept = asked.join(filters, ["slice", "bit"]).groupBy("_k", "_n").agg(F.count("*").alias("_c")).where("_c = _n").select("_k")
    return df.join(kept, F.col(key_col) == F.col("_k"), "left_semi")


def retouched_filter(counted: DataFrame, false_positives: DataFrame, key_col: str, bits: int = 1 << 16, hashes: int = 4, scheme: str = "fewest_lost") -> DataFrame:
    """A filter with one bit cleared for each listed false positive, which may lose true keys in turn. The bit is the
    one that fewest keys set (``fewest_lost``), that most false positives share (``most_cleared``), the best ``ratio``
    of both, or any (``random``, by hash)."""
    asked = false_positives.select(F.col(key_col).alias("k")).where("k is not null").distinct().select("k", F.explode(bloom_bits(F.col("k"), bits, hashes)).alias("bit"))
    shared = asked.groupBy("bit").agg(F.count("*").alias("wrong"))
    rated = asked.join(shared, "bit").join(F.broadcast(counted), "bit")
    rank = {"fewest_lost": F.col("n").cast("double"), "most_cleared": -F.col("wrong").cast("double"), "ratio": F.col("n") / F.col("wrong"), "random": F.xxhash64("k", "bit").cast("double")}[scheme]
    cleared = rated.groupBy("k").agg(F.min(F.struct(rank.alias("rank"), F.col("bit"))).alias("b")).select("b.bit").distinct()
    return counted.join(cleared, "bit", "left_anti")
