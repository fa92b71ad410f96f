"""Inverted index build and maintenance, and log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partition import global_index, running_total
from .project import tokens


def shard_of(doc: Column, shards: int) -> Column:
    """Hashing distribution: any engine with md5 agrees."""
    return (F.conv(F.substring(F.md5(doc.cast("string")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def route(ops: DataFrame, doc: str, op: str, shards: int, round_robin: str | None = None) -> DataFrame:
    """``shard`` per operation: by hash, or by an order column in turn, where deletes go to every shard."""
    if round_robin is None:
        return ops.withColumn("shard", shard_of(F.col(doc), shards))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.col(round_robin), F.lit(shards)).cast("int"))
    return ops.withColumn("shard", F.explode(F.when(F.col(op) == "delete", every).otherwise(own)))


def latest(ops: DataFrame, doc: str, order: str) -> DataFrame:
    """The last operation of each document; a map-side combined maximum."""
    rest = [c for c in ops.columns if c not in (doc, order)]
    return ops.groupBy(doc).agg(F.max(F.struct(order, *rest)).alias("_l")).select(doc, "_l.*")


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term): each distinct term of each document."""
    return docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def inverted_index(docs: DataFrame, doc: str, text: str, shards: int | None = None, segment_docs: int = 65_536) -> DataFrame:
    """(term, n_docs, docs, segment[, shard]): distinct documents per term, in order of their integer ids.

    Lists are kept by segments of ``segment_docs`` consecutive ids, as index segments are: no list outgrows a segment,
    however common the term."""
    pairs, keys = postings(docs, doc, text).withColumn("segment", F.floor(F.col("doc") / segment_docs)), ["segment", "term"]
    if shards:
        pairs, keys = pairs.withColumn("shard", shard_of(F.col("doc"), shards)), ["shard", *keys]
    return _listed(pairs, keys)


def _listed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    # a list gains nothing from partial aggregates: shuffled first, it is built once
    listed = pairs.repartition(*keys).groupBy(*keys).agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    return listed.select("term", F.size("docs").cast("long").alias("n_docs"), F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"), *[k for k in keys if k != "term"])


def merge_segments(segments: DataFrame) -> DataFrame:
    """(term, n_docs, docs): the segments of each term joined in their order; a row holds all documents of a term."""
    merged = segments.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.array_sort(F.collect_list(F.struct("segment", "docs"))).alias("parts"))
    return merged.select("term", "n_docs", F.array_join(F.transform("parts", lambda p: p["docs"]), ",").alias("docs"))


def updated_index(segments: DataFrame, deleted: DataFrame, added: DataFrame, doc: str, text: str, segment_docs: int = 65_536) -> DataFrame:
    """An index after documents are deleted (a table of ids) and others added or replaced (``added``)."""
    old = segments.select("term", F.explode(F.split("docs", ",")).alias("doc")).withColumn("doc", F.col("doc").cast("long"))
    gone = deleted.select(F.col(doc).cast("long").alias("doc")).unionByName(added.select(F.col(doc).cast("long").alias("doc")))
    kept = old.join(gone, "doc", "left_anti").unionByName(postings(added, doc, text).select("term", F.col("doc").cast("long").alias("doc")))
    return _listed(kept.withColumn("segment", F.floor(F.col("doc") / segment_docs)), ["segment", "term"])


def skew_report(stats: DataFrame, load: str, share: float = 0.9) -> DataFrame:
    """n_workers, busy, imbalance: how many of the most loaded workers hold ``share`` of all records, as 1 - busy / n.
    ``stats`` has one row per worker."""
    rest = [c for c in stats.columns if c != load]
    running = running_total(stats.withColumn("_down", -F.col(load)), ["_down", *rest], load)
    total = stats.agg(F.sum(load).alias("t")).select("t").scalar()
    busy = F.sum(F.when(F.col("_run") - F.col(load) < share * total, 1).otherwise(0))
    return running.agg(F.count("*").alias("n_workers"), busy.cast("long").alias("busy")).withColumn("imbalance", 1 - F.col("busy") / F.col("n_workers"))


def ratio_rules(stats: DataFrame) -> DataFrame:
    """Job diagnosis ratios from counters (spilled, map_output, launched, completed, side_bytes, input_bytes)."""
    safe = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.select("*", F.least(safe("spilled", "map_output") / 3.0, F.lit(1.0)).alias("spill_impact"), F.greatest(safe("launched", "completed") - 1, F.lit(0.0)).alias("rerun_impact"), safe("side_bytes", "input_bytes").alias("side_read_impact"))


#: The shape of a log line.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})[,.]?\d* (TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ([^ :]+): (.*)$"


def parse_logs(df: DataFrame, line_col: str, anonymise: bool = False) -> DataFrame:
    """(date, time, level, source, message) of log lines; other lines have nulls and the whole line as message."""
    got = [F.nullif(F.regexp_extract(F.col(line_col), LOG_LINE, g), F.lit("")) for g in range(1, 6)]
    out = df.select(*[c.alias(n) for c, n in zip(got[:4], ("date", "time", "level", "source"))], F.coalesce(got[4], F.when(got[2].isNull(), F.col(line_col)).otherwise("")).alias("message"))
    if anonymise:
        hidden = F.regexp_replace("message", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>")
        out = out.withColumn("source", F.sha2("source", 256)).withColumn("message", hidden)
    return out


def analyze_logs(lines: DataFrame, line_col: str, pattern: str, columns: list[int], separator: str = r"\s+") -> DataFrame:
    """(fields, n, place): lines that hold ``pattern``, counted by the chosen 0-based columns, in lexical order of these."""
    parts = F.split(F.col(line_col), separator)
    fields = F.concat_ws(" ", *[F.coalesce(F.try_element_at(parts, F.lit(c + 1)), F.lit("")) for c in columns])
    counted = lines.where(F.col(line_col).rlike(pattern)).select(fields.alias("fields")).groupBy("fields").agg(F.count("*").alias("n"))
    return global_index(counted, ["fields"]).withColumnRenamed("_i", "place")
