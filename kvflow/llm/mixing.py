"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Each document gets a 60-bit hash of its id, so thresholds nest: a larger budget takes all that a smaller one took.
Whole passes over a source come first; the rest of its budget is the documents below a hash threshold. The threshold
is found without sorting documents: words are summed by source and hash bucket (10 bits), a running sum over the at
most 1024 buckets of a source finds the one in which the budget ends, and only that bucket's documents are summed
again by their next 10 bits, until it holds a single hash. The documents of that last hash (one, but for repeated
ids) share the words still missing in proportion to their sizes, so each source meets its target to within one word
a document of that last hash.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with a null id share
one hash; repeated rows are taken alike; a source without words gets target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._names import own
from ._store import drop, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the document hash, and bits resolved by one histogram.
HASH_BITS, LEVEL_BITS = 60, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """60 bits of a digest of the id: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, budget_ratio: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per source with its target words: shares by weight, stopped at ``cap`` times the source's size, the
    excess reshared by weight until none is above. That is a water level over caps ordered by cap / weight."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", cap * F.col("source_size")).withColumn("total", budget_ratio * F.sum("source_size").over(W.partitionBy()))
    by_level = W.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.max(F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))).over(W.partitionBy())
    return ranked.select("source", "source_size", F.least(F.col("top"), F.coalesce(level * F.col("w"), F.col("top"))).alias("target"))


def _thresholds(rows: DataFrame, budget_ratio: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """rows (source, size, h) to one row per source: its target, whole passes, and the hash where its budget ends."""
    state = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), budget_ratio, cap, weights)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("passes", passes).withColumn("need", F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    state = written(state.withColumn("prefix", F.lit(0).cast("long")), "targets")
    shift = HASH_BITS
    while shift:
        wider, shift = shift, shift - LEVEL_BITS
        level = _refined(rows, state, wider, shift)
        drop(state)
        state = level
        if state.where("first_h < last_h").isEmpty():
            break
    return state


def _taken(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (source, size, h, ...) with source_size, target and taken."""
    chosen = state.select(F.col("source").alias("_s"), "source_size", "target", "passes", "need", "first_h", "last_words")
    part = F.when(F.col("h") < F.col("first_h"), F.col("size")).when((F.col("h") == F.col("first_h")) & (F.col("last_words") > 0), F.floor(F.col("size") * F.col("need") / F.col("last_words"))).otherwise(0).cast("long")
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("_s"))).withColumn("taken", F.col("passes") * F.col("size") + part)


def mix_to_weights(docs: DataFrame, *, budget_ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("h")), "sizes")
    return _taken(rows, _thresholds(rows, budget_ratio, cap, weights)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, budget_ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix reads them: each as often as it is taken (the last one of a budget if at least half of
    it is; texts without words once). Texts are not shuffled: only the row per source travels."""
    sized = docs.select(F.struct(*own(docs)).alias("_row"), words(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("h"), F.col(source_col).alias("source"))
    state = _thresholds(written(sized.select("source", "size", "h"), "sizes"), budget_ratio, cap, weights)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    return _taken(sized, state).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")


def _refined(rows: DataFrame, state: DataFrame, wider: int, shift: int) -> DataFrame:
    """For each source: the bucket of the next bits in which its budget ends, with what is needed from that bucket."""
    named = state.select(F.col("source").alias("s"), "prefix", "source_size", "target", "passes", "need")
    inside = rows.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", wider) == F.col("prefix")))
    keys = ["source", "source_size", "target", "passes", "need"]
    histogram = inside.groupBy(*keys, F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("words"), F.min("h").alias("first_h"), F.max("h").alias("last_h"))
    by_bucket = W.partitionBy("source").orderBy("prefix")
    running = histogram.withColumn("upto", F.sum("words").over(by_bucket)).withColumn("final", F.lead("prefix").over(by_bucket).isNull())
    # the first bucket whose running sum reaches what is needed (needing nothing: the very first one)
    ends = running.where("upto >= need or final")
    first = ends.groupBy(*keys).agg(F.min(F.struct("prefix", "words", "upto", "first_h", "last_h")).alias("b"))
    return written(first.select("source", "source_size", "target", "passes", (F.col("need") - F.col("b.upto") + F.col("b.words")).alias("need"), "b.prefix", F.col("b.words").alias("last_words"), "b.first_h", "b.last_h"), "level")
