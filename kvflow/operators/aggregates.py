"""Aggregates with per-row dynamic ids, capped distinct counts, histograms and checksums."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the aggregate types.
LONG_SUM, DOUBLE_SUM = "LongValueSum", "DoubleValueSum"
LONG_MAX, LONG_MIN = "LongValueMax", "LongValueMin"
STRING_MAX, STRING_MIN = "StringValueMax", "StringValueMin"
UNIQUE_COUNT, HISTOGRAM = "UniqValueCount", "ValueHistogram"


def emit(kind: str, name: Column | str, value: Column) -> Column:
    """One (kind, id, value) entry for :func:`dynamic_aggregates`."""
    return F.struct(F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("id"), value.cast("string").alias("value"))


def _report(freq: Column) -> dict[str, Column]:
    """n_unique, min, median, max, mean, sd from an ordered array of (n, f): f values occur n times."""
    total = lambda f: F.aggregate(freq, F.lit(0.0), lambda a, e: a + f(e))
    count = F.aggregate(freq, F.lit(0).cast("long"), lambda a, e: a + e["f"])
    run = lambda acc, e: F.struct((acc["seen"] + e["f"]).alias("seen"), F.when((acc["seen"] <= acc["at"]) & (acc["seen"] + e["f"] > acc["at"]), e["n"]).otherwise(acc["out"]).alias("out"), acc["at"].alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("out"), F.floor(count / 2).cast("long").alias("at"))
    n, f = (lambda e: e["n"].cast("double")), (lambda e: e["f"])
    mean = total(lambda e: n(e) * f(e)) / count
    square = total(lambda e: n(e) * n(e) * f(e)) / count
    ends = F.element_at(freq, 1)["n"], F.element_at(freq, -1)["n"]
    return {"n_unique": count, "min": ends[0], "median": F.aggregate(freq, start, run, lambda a: a["out"]), "max": ends[1], "mean": mean, "sd": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))}


def histogram_report(entries: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys, n_unique, min, median, max, mean, sd over the counts of distinct values.

    Counts of values are aggregated first, then counts of counts, so the median comes from few rows even if a key has
    most of the input."""
    counts = entries.groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).cast("long").alias("n"))
    freq = counts.groupBy(*keys, "n").agg(F.count("*").alias("f")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("freq"))
    return freq.where(F.size("freq") > 0).select(*keys, *[c.alias(name) for name, c in _report(F.col("freq")).items()])


def unique_capped(df: DataFrame, keys: list[str], value: str, cap: int) -> DataFrame:
    """Distinct values per key, saturating at ``cap`` + 1."""
    return df.groupBy(*keys).agg(F.least(F.countDistinct(value), F.lit(cap + 1)).alias("n_unique"))


def wrapping_sum(value: Column) -> Column:
    """A sum of longs modulo 2**64, as two's complement addition gives it: 22 low, 22 middle and 20 high bits are summed
    apart, which no number of rows overflows, and carried over at the end."""
    mask = F.lit((1 << 22) - 1).cast("long")
    low, middle, high = F.sum(value.bitwiseAND(mask)), F.sum(F.shiftright(value, 22).bitwiseAND(mask)), F.sum(F.shiftright(value, 44))
    middle = middle + F.shiftright(low, 22)
    high = high + F.shiftright(middle, 22)
    return F.shiftleft(high, 44).bitwiseOR(F.shiftleft(middle.bitwiseAND(mask), 22)).bitwiseOR(low.bitwiseAND(mask))


def dynamic_aggregates(df: DataFrame, entries: Column, unique_cap: int | None = None, kinds: set[str] | None = None) -> DataFrame:
    """(kind, id, result): ``entries`` is an array of :func:`emit`, so each row names the aggregates it feeds.

    One pass over the input, combined on the map side, and a second one if there are extremes of strings: by kind and
    id, and by value for distinct counts and histograms, whose values are counted, then their counts. Only the functions of ``kinds`` (all if not given) are planned; entries
    of any other kind are left out."""
    every = {LONG_SUM, DOUBLE_SUM, LONG_MAX, LONG_MIN, STRING_MAX, STRING_MIN, UNIQUE_COUNT, HISTOGRAM}
    used = every if kinds is None else kinds & every
    number = lambda kind, t: F.when(F.col("kind") == kind, F.col("value").try_cast(t))
    text = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    every_row = df.select(F.explode(entries).alias("e")).select("e.*")
    outs = []
    if used & {STRING_MAX, STRING_MIN}:  # strings have no place in a hash aggregate's buffer: these rows alone are sorted
        each = every_row.where(F.col("kind").isin(STRING_MAX, STRING_MIN) & F.col("kind").isin(*sorted(used))).groupBy("kind", "id")
        outs.append(each.agg(F.max(text(STRING_MAX)).alias("top"), F.min(text(STRING_MIN)).alias("low")).select("kind", "id", F.coalesce("top", "low").alias("result")))
    folds = {LONG_SUM: lambda: wrapping_sum(number(LONG_SUM, "long")), DOUBLE_SUM: lambda: F.sum(number(DOUBLE_SUM, "double")), LONG_MAX: lambda: F.max(number(LONG_MAX, "long")), LONG_MIN: lambda: F.min(number(LONG_MIN, "long"))}
    mine, counted = [k for k in folds if k in used], bool(used & {UNIQUE_COUNT, HISTOGRAM})
    if mine or counted:
        rows = every_row.where(F.col("kind").isin(*sorted(used - {STRING_MAX, STRING_MIN})))
        by = ["kind", "id"] + ([F.when(F.col("kind").isin(UNIQUE_COUNT, HISTOGRAM), F.col("value")).alias("item")] if counted else [])
        out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[folds[k]().alias(k) for k in mine])
        results = [F.col(k).cast("string") for k in mine]
        if counted:
            keep = [F.max(k).alias(k) for k in mine]  # these kinds have one row a kind and id already
            size = F.when(F.col("kind") == HISTOGRAM, F.col("n")).alias("size")
            out = out.groupBy("kind", "id", size).agg(F.count("*").alias("f"), F.count("item").alias("items"), *keep)
            freq = F.array_sort(F.collect_list(F.when(F.col("size").isNotNull(), F.struct(F.col("size").alias("n"), "f")))).alias("freq")
            out = out.groupBy("kind", "id").agg(F.sum("items").alias("items"), freq, *keep)
            n = F.col("items") if unique_cap is None else F.least(F.col("items"), F.lit(unique_cap + 1))
            report = F.concat_ws("\t", *[c.cast("string") for c in _report(F.col("freq")).values()])
            results += [F.when(F.col("kind") == UNIQUE_COUNT, n.cast("string")), F.when(F.col("kind") == HISTOGRAM, report)]
        outs.append(out.select("kind", "id", F.coalesce(*results, F.lit(None).cast("string")).alias("result")))
    return reduce(DataFrame.unionByName, outs) if outs else every_row.where("false").select("kind", "id", F.col("value").alias("result"))


def described_aggregates(df: DataFrame, *descriptors: Callable[[DataFrame], Column], unique_cap: int | None = None, kinds: set[str] | None = None) -> DataFrame:
    """User-defined aggregates: each descriptor turns the input's columns into an array of :func:`emit`; all share a pass."""
    return dynamic_aggregates(df, F.concat(*[d(df) for d in descriptors]), unique_cap, kinds)


def record_counts(df: DataFrame) -> DataFrame:
    """(id, n): rows of each input file by its path, and of all as ``record_count``."""
    per_file = df.groupBy(F.input_file_name().alias("id")).agg(F.count("*").alias("n"))
    return per_file.rollup("id").agg(F.sum("n").alias("n"), F.grouping("id").alias("all")).select(F.when(F.col("all") == 1, "record_count").otherwise(F.col("id")).alias("id"), "n")


def text_aggregates(lines: DataFrame, line_col: str, unique_cap: int | None = None, kinds: set[str] | None = None) -> DataFrame:
    """The aggregate reducer of text pipelines: lines ``Type:id<TAB>value``."""
    head = F.split(F.col(line_col), "\t", 2)
    kind, name = F.split_part(F.element_at(head, 1), F.lit(":"), F.lit(1)), F.regexp_replace(F.element_at(head, 1), "^[^:]*:", "")
    entry = F.struct(kind.alias("kind"), name.alias("id"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")).alias("value"))
    return dynamic_aggregates(lines.select(F.array(entry).alias("e")), F.col("e"), unique_cap, kinds)


def shuffle_checksum(df: DataFrame, *cols: str) -> DataFrame:
    """n_rows, n_bytes and an order-free xor of row hashes: equal before and after any reordering."""
    text = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in cols])
    return df.select(text.alias("t")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).cast("long").alias("n_bytes"), F.bit_xor(F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("long")).alias("xor_hash"))


def counters(df: DataFrame, name: str, **exprs: Column):
    """Named counters on the side of a job: (df, observation); read ``observation.get`` after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[e.alias(n) for n, e in exprs.items()]), seen
