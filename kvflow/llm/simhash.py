"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits and link at 3 or fewer differing bits, so one of a pair's two 32-bit halves differs in at
most one bit. The anchors of a half are the words of the perfect Hamming code of length 31 (covering radius 1; the
32nd bit is left out, which only brings points nearer). A fingerprint is replicated to every anchor within covering
radius plus threshold, 1 + 1: at most 16 of 2**26 a half. The anchor next to one fingerprint of a linked pair is
within that distance of the other, so comparing per anchor finds every link. (One code over all 64 bits would need
radius plus 3, a ball that holds most anchors.)

Only distinct fingerprints are replicated; copies are rows of one fingerprint. An anchor with more than ``block``
fingerprints is dealt as pairs of blocks, so no group of unbounded size meets in one task. Within a group a search
from fingerprint to fingerprint over those not yet reached emits the links of a spanning forest instead of all pairs.

Defined cases: null text has no words and fingerprint 0, which links like any other; a null doc_id is never a
component's id (a component of nulls only has null); repeated rows have one component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import told_apart
from ._graph import connected_components
from ._names import own, unused
from ._store import drop, written
from ._words import chunks, small_batches

THRESHOLD = 3


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Bit is 1 if set in over half the XXH64 (seed 42) of all ``width``-word shingles, repeats included."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(octets), 65_536):  # a very long text is counted piece by piece
        ones += np.unpackbits(octets[lo : lo + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "bytes"):
            fp = np.array([fingerprint((t or b"").lower().split()) for t in b.column("bytes").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rh"), pa.array(fp.view(np.int64))], names=["doc_id", "rh", "fp"])


def row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row; rows that differ only in maps, which have no order, hash alike."""
    return F.xxhash64(*[c for c, f in zip(own(docs), docs.schema.fields) if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rh (hash of the row), fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("rh"), F.col(text_col).cast("binary").alias("bytes")).mapInArrow(_fingerprints, "doc_id long, rh long, fp long")


def syndromes(v: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the number (1 to 31) of the bit to flip for the nearest code word, 0 at a code word."""
    out = np.zeros(len(v), np.int64)
    for i in range(31):
        out ^= ((v >> np.int64(i)) & 1) * (i + 1)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of fingerprint) for every code word of either half within distance 2."""
    keys, rows = [], []
    pairs = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(32)]
    for half in (0, 1):
        v = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = syndromes(v)
        for value in range(32):
            at = np.flatnonzero(s == value)
            flips = [0] if value == 0 else [1 << (value - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs[value]]
            for f in flips:
                keys.append((v[at] ^ f) | (half << 31))
                rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.asarray(b.column("fp"))
        for lo in range(0, len(fp), 8192):
            part = fp[lo : lo + 8192]
            key, row = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["anchor", "fp"])


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= THRESHOLD


def spanning(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct fingerprints ``fp``, by search over those not yet reached."""
    rest, out = fp, []
    while len(rest) > 1:
        reach, rest = [rest[0]], rest[1:]
        while reach and len(rest):
            x = reach.pop()
            hit = near(x, rest)
            if hit.any():
                out += [(int(x), int(y)) for y in rest[hit]]
                reach += list(rest[hit])
                rest = rest[~hit]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the links of each group's forest."""

    def links(anchor, part, fp):
        out = []
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[new, len(anchor)])
        two = new[size == 2]
        hit = two[near(fp[two], fp[two + 1])]
        out += zip(fp[hit].tolist(), fp[hit + 1].tolist())
        for s, n in zip(new[size > 2].tolist(), size[size > 2].tolist()):
            out += spanning(fp[s : s + n])
        return out

    def batch(out):
        a, b = zip(*set(out)) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.uint64()).view(pa.int64()), pa.array(b, pa.uint64()).view(pa.int64())], names=["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for b in batches:
        held = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns)]
        anchor, part, fp = held
        if len(anchor) < 50_000:
            continue
        cut = np.flatnonzero((anchor == anchor[-1]) & (part == part[-1]))[0]  # the last group may go on
        if cut:
            yield batch(links(anchor[:cut], part[:cut], fp[:cut].view(np.uint64)))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield batch(links(held[0], held[1], held[2].view(np.uint64)))


def near_links(distinct: DataFrame, block: int = 1024) -> DataFrame:
    """fp (distinct longs) to links (a, b) that connect all fingerprints within 3 bits of each other."""
    spread = written(distinct.mapInArrow(_replicate, "anchor long, fp long"), "anchors")
    sizes = spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    grouped = spread.join(sizes, "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    parts = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)))
    dealt = grouped.select("anchor", F.explode(parts).alias("part"), "fp").withColumn("part", F.col("part").cast("long"))
    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_compare, "a long, b long")


def _labelled(rows: DataFrame, block: int) -> DataFrame:
    """rows (doc_id, fp, ...), written, to the component of each distinct fingerprint: fp, root, component_id, written."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("m")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), block))
    rooted = written(distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "m", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = written(rooted.groupBy("root").agg(F.min("m").alias("component_id")), "smallest")
    label = written(rooted.join(smallest, "root").select("fp", "root", "component_id"), "labels")
    drop(distinct, rooted, smallest)
    return label


def simhash_components(docs: DataFrame, *, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    rows = written(fingerprints(docs, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    return rows.join(_labelled(rows, block), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, *, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies, one row of each component: that of the smallest id and, among rows of this id
    in the component, of the least row hash. Rows of one id in different components are different documents, so a text
    without a near copy stays whatever its id; of rows that agree in every column one stays; rows with null id all stay.
    A bitmap of the rows that go, or of which several agree, lets all others through without a shuffle of their texts."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    label = _labelled(rows, block)
    named = rows.where("doc_id is not null")
    best = named.join(label, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "rh")).alias("best"))
    h, d, r = (unused(n, docs) for n in ("row_hash", "best_id", "best_row"))
    best = written(best.select(F.col("best.doc_id").alias(d), F.col("best.rh").alias(r)), "best")
    alike = named.groupBy("doc_id", "rh").agg(F.count("*").alias("n")).join(best, (F.col("doc_id") == F.col(d)) & (F.col("rh") == F.col(r)), "left")
    unsure = written(alike.where(F.col(d).isNull() | (F.col("n") > 1)).select("doc_id", "rh"), "unsure")
    drop(rows, label)
    doc_id = F.col(id_col).cast("long")
    hashed = docs.where(F.col(id_col).isNotNull()).withColumn(h, row_hash(docs))
    maybe, sure = told_apart(hashed, [doc_id, F.col(h)], unsure, ["doc_id", "rh"])
    one = maybe.join(best, (doc_id == F.col(d)) & (F.col(h) == F.col(r)), "left_semi").dropDuplicates([id_col, h])
    return one.select(*own(docs)).unionByName(sure.select(*own(docs))).unionByName(docs.where(F.col(id_col).isNull()))
