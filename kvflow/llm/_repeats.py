"""Repeated word windows across documents: what the suffix-array and the automaton operator share.

A window is ``window`` consecutive words. Among its k-grams the one with the least hash is its *anchor* (leftmost on
ties), so equal windows choose the same anchor wherever they stand (a minimiser scheme). Consecutive windows with one
anchor form a *context*: the words of all these windows. Only contexts of anchors that stand in two documents can
hold a repeated window, so engines compare contexts of one anchor with each other and nothing else.

Data flow (nothing here grows with the corpus on one node):

1. one scan emits (anchor, context hash, doc, start, windows) - about 2/(window-k+2) rows a word - and anchors of one
   document only are dropped;
2. a grouped aggregate keeps each distinct context once, with its smallest document, as representative. Contexts are
   told apart by 128 bits (the hashes of anchor and words), which is the only place where words are not compared;
3. words of representatives only are cut from their texts (a join by document, which only texts enter that a bitmap
   does not rule out; the same holds for the last step);
4. contexts are dealt by anchor to tasks, which fill bounded *shards* and run an engine on each. An anchor with more
   than ``crowded`` contexts (a common phrase in ever new surroundings) is split by longer context: window by window,
   those of one hash together. A window that stands in many contexts is dealt in groups of ``crowded``; the engine
   compares the words of a group, one window of each kind goes on to the next round with its smallest document, until
   one group is left. So no group of unbounded size meets in one task, and the engine decides every match;
5. the engine says for each context which windows stand in which smallest document; joined back to all occurrences,
   windows whose smallest document is smaller than their own are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import told_apart
from ._store import drop, written
from ._words import P_INV, chunks, leftmost_minimum, mix, powers, prefix, small_batches, span_hashes, tidy, word_hashes

OCC = "a long, c long, doc long, th long, s0 int, n int, off int"


def anchors(h: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Contexts of documents laid end to end in ``h`` (word hashes; ``starts`` has each document's first word, and the
    total at the end): anchor hash, context hash, document index, first window, number of windows, anchor - first."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none, none, none
    c, inverse = prefix(h), powers(len(h) + 1, P_INV)
    first = np.arange(len(h) - gram + 1)
    grams = span_hashes(c, first, first + gram, inverse)
    at = leftmost_minimum(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    i = np.arange(len(at))
    ok = i[doc[i] == doc[i + window - 1]]
    if not len(ok):
        return none, none, none, none, none, none
    p, d = at[ok], doc[ok]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    s0, n = ok[new], np.diff(np.r_[new, len(ok)])
    # the anchor's place is part of the context: the same words with another anchor place are another context
    context = span_hashes(c, s0, s0 + n + window - 1, inverse) ^ mix((p[new] - s0).astype(np.uint64))
    return grams[p[new]].view(np.int64), context.view(np.int64), d[new], s0, n, p[new] - s0


def _scan(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "bytes"):
                words, starts = [], [0]
                for t in b.column("bytes").to_pylist():
                    words += t.split()
                    starts.append(len(words))
                a, c, d, s0, n, off = anchors(word_hashes(words), np.array(starts), window, gram)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), b.column("doc").take(take), b.column("th").take(take), pa.array((s0 - np.array(starts)[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))],
                    names=["a", "c", "doc", "th", "s0", "n", "off"],
                )

    return scan


CUT = "s long, a long, c long, i int, n int, off int, m long, top long, words binary"


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "bytes"):
                rows = []
                for t, reps in zip(b.column("bytes").to_pylist(), b.column("reps").to_pylist()):
                    words = t.split()
                    for r in reps:
                        s0, n, off = r["s0"], r["n"], r["off"]
                        if not r["hot"]:
                            rows.append((r["a"], r["a"], r["c"], 0, n, off, r["m"], r["top"], b" ".join(words[s0 : s0 + n + window - 1])))
                            continue
                        h = word_hashes(words[s0 : s0 + n + window - 1])
                        i = np.arange(n)
                        keys = span_hashes(prefix(h), i, i + window, powers(len(h) + 1, P_INV)).view(np.int64)
                        rows += [(k, r["a"], r["c"], j, 1, off - j, r["m"], r["top"], b" ".join(words[s0 + j : s0 + j + window])) for j, k in enumerate(keys.tolist())]
                for lo in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[lo : lo + 20_000]))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["s", "a", "c", "i", "n", "off", "m", "top", "words"])

    return cut


def _in_shards(work: Callable, keys: int, words_of: Callable, shard_words: int, names: list[str], kinds: list[pa.DataType]):
    """Feed runs of whole groups (rows come sorted; the first ``keys`` columns name the group) to ``work`` in shards of
    about ``shard_words`` words."""

    def batch(out):
        cols = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out = [], 0, []
        for b in batches:
            for r in zip(*(x.to_pylist() for x in b.columns)):
                if size >= shard_words and r[:keys] != held[-1][:keys]:
                    out += work(held)
                    held, size = [], 0
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                held.append(r)
                size += words_of(r)
        if held:
            out += work(held)
        yield batch(out)
        del held, out
        tidy()

    return shards


def _matched(engine: Callable, window: int, shard_words: int):
    """Contexts of one anchor (s, a, c, i, n, off, m, top, words): the windows whose smallest document is below ``top``."""

    def run(rows):
        out = []
        least = engine([(r[5], r[6], r[8].split()) for r in rows], [r[0] for r in rows], window)
        for r, per_window in zip(rows, least):
            b = 0
            for e in range(1, len(per_window) + 1):
                if e == len(per_window) or per_window[e] != per_window[b]:
                    if per_window[b] < r[7]:
                        out.append((r[1], r[2], r[3] + b, r[3] + e, per_window[b]))
                    b = e
        return out

    return _in_shards(run, 1, lambda r: r[4] + window - 1, shard_words, ["a", "c", "b", "e", "least"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()])


def _merged(engine: Callable, window: int, shard_words: int):
    """Groups of single windows (s, part, off, m, words): each kind of a group once, with its smallest document."""

    def run(rows):
        least = engine([(r[2], r[3], r[4].split()) for r in rows], [r[:2] for r in rows], window)
        kinds = {(r[0], r[1], r[4]): (r[2], found[0]) for r, found in zip(rows, least)}
        return [(s, off, m, words) for (s, _, words), (off, m) in kinds.items()]

    return _in_shards(run, 2, lambda r: window, shard_words, ["s", "off", "m", "words"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])


def _crowded(single: DataFrame, engine: Callable, window: int, crowded: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """single (s, a, c, i, off, m, top, words), a window a row, to (a, c, b, e, least), and the table that this reads."""
    sizes = lambda df: df.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    now = single.join(sizes(single), "s").select("s", F.pmod(F.xxhash64("a", "c", "i"), F.ceil(F.col("k") / crowded)).alias("part"), "off", "m", "words", "k")
    now = written(now, "many")
    while True:
        more = not now.where(F.col("k") > crowded).isEmpty()
        grouped = now.select("s", "part", "off", "m", "words").repartition("s", "part").sortWithinPartitions("s", "part", "m")
        merged = written(grouped.mapInArrow(_merged(engine, window, shard_words), "s long, off int, m long, words binary"), "merged")
        drop(now)
        if not more:
            break
        counted = merged.groupBy("s").agg(F.count("*").alias("k"))
        now = written(merged.join(counted, "s").select("s", F.pmod(F.xxhash64("m", "words"), F.ceil(F.col("k") / crowded)).alias("part"), "off", "m", "words", "k"), "many")
        drop(merged)
    least = merged.select("s", F.xxhash64("words").alias("w"), F.col("m").alias("least"))
    each = single.select("s", F.xxhash64("words").alias("w"), "a", "c", "i", "m", "top").join(least, ["s", "w"], "left").withColumn("least", F.coalesce("least", "m"))
    return each.where("least < top").select("a", "c", F.col("i").alias("b"), (F.col("i") + 1).alias("e"), "least"), merged


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "bytes"):
            total, gone, digest, kept = [], [], [], []
            for t, spans in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist()):
                words = (t or b"").split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["b"] : s["e"]] = False
                left = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                text = b" ".join(left)
                total.append(len(words))
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept(batches):
        yield b.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, engine: Callable, *, window: int = 50, gram: int = 16, crowded: int = 512, shard_words: int = 60_000, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("bytes"))
    scanned = rows.where("doc is not null and octet_length(bytes) >= %d" % (2 * window - 1))
    every = written(scanned.mapInArrow(_scan(window, gram), OCC), "anchors")
    # anchors that stand in one document only go first: all that follows is as large as what repeats
    # (written before it is joined: then a hot anchor's rows can be split among tasks)
    repeated = written(every.groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("a"), "in-two")
    occ = written(every.join(repeated, "a", "left_semi"), "repeated")
    drop(every)
    # a context is a pair of an anchor and its words
    distinct = occ.groupBy("a", "c").agg(F.min("doc").alias("m"), F.max("doc").alias("top"), F.min(F.struct("doc", "th", "s0", "n", "off")).alias("rep"))
    distinct = written(distinct, "contexts")
    groups = written(distinct.groupBy("a").agg(F.count("*").alias("k")).select("a", F.expr(f"k > {int(crowded)}").alias("hot")), "groups")
    reps = distinct.join(groups, "a").select(F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"), F.struct("a", "c", "m", "top", "hot", "rep.s0", "rep.n", "rep.off").alias("r"))
    lists = reps.groupBy("doc", "th").agg(F.collect_list("r").alias("reps"))
    place = [F.col("doc"), F.col("th")]
    holders, _ = told_apart(rows, place, distinct.select("rep.doc", "rep.th"), ["doc", "th"])
    cut = written(holders.join(lists, ["doc", "th"]).select("bytes", "reps").mapInArrow(_cut(window), CUT), "passages")

    whole = cut.where("s = a").repartition("s").sortWithinPartitions("s", "m", "a", "c").mapInArrow(_matched(engine, window, shard_words), "a long, c long, b int, e int, least long")
    single, merged = _crowded(cut.where("s <> a"), engine, window, crowded, shard_words)
    found = written(whole.unionByName(single), "windows")
    drop(cut, distinct, groups, repeated, merged)
    spans = occ.join(found, ["a", "c"]).where("least < doc").select("doc", "th", F.struct((F.col("s0") + F.col("b")).alias("b"), (F.col("s0") + F.col("e") + (window - 1)).alias("e")).alias("span"))
    spans = written(spans.groupBy("doc", "th").agg(F.collect_set("span").alias("spans")), "spans")
    drop(occ, found)
    touched, whole = told_apart(rows, place, spans, ["doc", "th"])
    joined = touched.join(spans, ["doc", "th"], "left").select("doc", "bytes", "spans")
    joined = joined.unionByName(whole.select("doc", "bytes", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInArrow(_kept, schema + ", kept_text string") if with_text else joined.mapInArrow(_digest, schema)
