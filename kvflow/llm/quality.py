"""Quality classifier by co-training.

Two classifiers see disjoint views of a page: *content* (how its words end, how often they repeat) and *metadata*
(source and language as hashed categories, length, line structure, shares of capitals, digits and marks). Both learn
from the labelled sample; then, for some rounds, each scores every unlabelled document and hands the ``handed`` ones it
is surest of, half of each class, to the other with its own label for them. Each view's margin is calibrated on
labelled rows kept out of its training, and the calibrated views are added in log odds to score all documents.

Views are computed once per whole text and written as half-precision numbers; each round is a pass over these. Every
task keeps its surest ``handed`` rows, their union is cut to the surest of all, and only these come to the driver. The
sample of labelled rows is bounded by ``labelled_rows`` of each label; unlabelled are all documents with an id that has
no label and is outside the held-out third.

Defined cases: null and empty texts get the features of an empty text, a null source or language is a category of its
own; rows without a label are scored, too; labels other than 0 and 1 are not learned from, but their rows are not
unlabelled; with labels of one kind or none every score is 0.5 and every row is kept; repeated rows score alike and are
handed over once, as are rows with equal views; rows with null ids are only scored; columns beside the named ones,
whatever they are called, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, written
from ._words import chunks, small_batches
from .toxicity import held_out, labelled_sample, logistic

#: Buckets of hashed word endings, of sources and of languages.
ENDINGS, SOURCES, LANGUAGES = 256, 64, 16
#: Margins below this are not sure.
SURE = 3.0


def content_view(words: list[bytes]) -> np.ndarray:
    n = len(words)
    out = np.zeros(ENDINGS + 3)
    if n:
        at = np.fromiter((zlib.crc32(w[-3:]) % ENDINGS for w in words), np.int64, n)
        out[:ENDINGS] = np.sqrt(np.bincount(at, minlength=ENDINGS) / n)
        out[ENDINGS] = len(set(words)) / n
        out[ENDINGS + 1] = sum(a == b for a, b in zip(words, words[1:])) / n
        out[ENDINGS + 2] = len({zlib.crc32(w[-2:]) for w in words}) / n
    return out


def metadata_view(text: bytes, n_words: int, lang: str | None, source: str | None) -> np.ndarray:
    octets = np.frombuffer(text, np.uint8)
    n = max(1, len(octets))
    kinds = np.bincount(octets, minlength=256) / n
    lines = text.split(b"\n")
    unique = len(set(lines)) / len(lines)
    upper, digits, marks = kinds[65:91].sum(), kinds[48:58].sum(), kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    share = -(kinds[kinds > 0] * np.log(kinds[kinds > 0])).sum()
    out = np.zeros(12 + SOURCES + LANGUAGES)
    out[:12] = [np.log1p(len(octets)), np.log1p(n_words), len(octets) / max(1, n_words) / 10, np.log1p(len(lines)), unique, upper, digits, marks, kinds[128:].sum(), kinds[124], kinds[33], share / 5]
    for value, first, size in ((source, 12, SOURCES), (lang, 12 + SOURCES, LANGUAGES)):
        out[first + (0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1))] = 1
    return out


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "bytes"):
            a, m = [], []
            for t, lang, source in zip(*(b.column(c).to_pylist() for c in ("bytes", "lang", "source"))):
                words = (t or b"").split()
                a.append(np.minimum(content_view(words), 6e4).astype("<f2").tobytes())
                m.append(np.minimum(metadata_view(t or b"", len(words), lang, source), 6e4).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "content", "metadata"])


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), "<f2").reshape(len(items), -1).astype(np.float64) if items else np.zeros((0, 0))


class View:
    """A standardised linear classifier and the calibration of its margin."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.weights = logistic((x - self.mean) / self.scale, y, ridge=5.0)
        self.slope, self.shift = 1.0, 0.0
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        if len(set(y.tolist())) == 2:
            w = logistic((x @ self.plain()[0] + self.plain()[1])[:, None], y, ridge=1.0)
            self.slope, self.shift = max(0.0, w[0]), w[1]
        return self

    def plain(self) -> tuple[np.ndarray, float]:
        """Weights and bias of the calibrated log odds, as plain values for a broadcast."""
        w = self.weights[:-1] / self.scale
        return self.slope * w, float(self.slope * (self.weights[-1] - self.mean @ w) + self.shift)


PICKED = "view int, label int, sure double, doc_id long, content binary, metadata binary"


def _surest(shared, handed: int):
    """The rows of a task of which each view is surest, ``handed`` of each class at most: distinct views once, smallest
    id first."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, used = shared.value
        held: dict[tuple[int, int], list[tuple]] = {(k, label): [] for k in (0, 1) for label in (0, 1)}
        for b in batches:
            ids = np.asarray(b.column("doc_id"))
            fresh = ~np.isin(ids, used)
            for k, name in enumerate(("content", "metadata")):
                margin = numbers(b.column(name)) @ weights[k][0] + weights[k][1]
                for label in (0, 1):
                    sure = margin if label else -margin
                    best = held[k, label]
                    least = max(SURE, best[-1][0] * -1 if len(best) >= handed else SURE)
                    for i in np.flatnonzero(fresh & (sure >= least)).tolist():
                        best.append((-float(sure[i]), int(ids[i]), b.column("content")[i].as_py(), b.column("metadata")[i].as_py()))
                        if len(best) > 4 * handed + 64:
                            best[:] = _first(best, handed)
                    best[:] = _first(best, handed)
        rows = [(k, label, -s, d, c, m) for (k, label), best in held.items() for s, d, c, m in best]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["view", "label", "sure", "doc_id", "content", "metadata"])

    return pick


def _first(rows: list[tuple], n: int) -> list[tuple]:
    out, seen = [], set()
    for r in sorted(rows):
        if r[2:] not in seen:
            seen.add(r[2:])
            out.append(r)
            if len(out) == n:
                break
    return out


def _handed(pool: DataFrame, fitted: list[View], used: list[int], handed: int) -> list[tuple]:
    """(view, label, sure, doc_id, content, metadata) of the rows that the views hand over: bounded by 4 x ``handed``."""
    shared = pool.sparkSession.sparkContext.broadcast(([v.plain() for v in fitted], np.array(used, np.int64)))
    picked = pool.mapInArrow(_surest(shared, handed), PICKED)
    merged = picked.groupBy("view", "label", "content", "metadata").agg(F.min(F.struct(-F.col("sure"), "doc_id")).alias("first"))
    out = []
    for view in (0, 1):
        for label in (0, 1):
            mine = merged.where((F.col("view") == view) & (F.col("label") == label)).orderBy("first", "content", "metadata").limit(handed)
            out.append(mine.select("view", "label", F.col("first.doc_id").alias("doc_id"), "content", "metadata"))
    every = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).toArrow()
    return list(zip(*(every.column(c).to_pylist() for c in ("view", "label", "doc_id", "content", "metadata"))))


def co_train(known: pa.Table, pool: DataFrame, rounds: int, handed: int) -> list[View] | None:
    """known: doc_id, label and both views of the labelled sample, a fifth of which calibrates; pool: doc_id and both
    views of all unlabelled documents."""
    order = np.argsort(np.asarray(known.column("doc_id")), kind="stable")  # the same whatever the tasks' order
    y = np.asarray(known.column("label"), dtype=np.float64)[order]
    if len(set(y.tolist())) < 2:
        return None
    mixed = np.random.default_rng(5).permutation(len(y))
    y, views = y[mixed], [numbers(known.column(c))[order][mixed] for c in ("content", "metadata")]
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    train = [[v[~aside], y[~aside]] for v in views]
    used: list[int] = []
    for _ in range(rounds):
        got = _handed(pool, [View().fit(*t) for t in train], used, handed // 2)
        if not got:
            break
        for k in (0, 1):
            mine = sorted((r for r in got if r[0] == k), key=lambda r: (r[1], r[2]))
            if mine:
                other = train[1 - k]
                other[0] = np.r_[other[0], numbers(pa.array([r[4 - k] for r in mine], pa.binary()))]
                other[1] = np.r_[other[1], [float(r[1]) for r in mine]]
        used += [r[2] for r in got]
    return [View().fit(*t).calibrate(v[aside], y[aside]) for t, v in zip(train, views)]


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        for b in batches:
            z = np.zeros((2, b.num_rows))
            if views and b.num_rows:
                z = np.stack([np.clip(numbers(b.column(c)) @ w + bias, -12, 12) for c, (w, bias) in zip(("content", "metadata"), views)])
            # views that agree by chance on a class share its prior: half the sum of both log odds is a safe pool
            p, parts = 1 / (1 + np.exp(-z.sum(0) / 2)), 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(parts[0]), pa.array(parts[1])], names=["doc_id", "score", "content", "metadata"])

    return score


def views_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, content, metadata: both views of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(_views, "doc_id long, content binary, metadata binary")


def score_quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, labelled_rows: int = 2500, rounds: int = 3, handed: int = 200,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """doc_id, held_out, score (1: good), content, metadata (calibrated views), kept (score >= threshold)."""
    views = written(views_of(docs, id_col, text_col, lang_col, source_col), "views")
    known = labelled_sample(views, labels, "quality", (labelled_rows, labelled_rows), [F.col(c) for c in ("doc_id", "content", "metadata")], "doc_id").toArrow()
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    pool = written(views.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(named, "doc_id", "left_anti"), "unlabelled")
    learned = co_train(known, pool, rounds, handed)
    drop(pool)
    shared = docs.sparkSession.sparkContext.broadcast(learned and [v.plain() for v in learned])  # two weight vectors
    out = views.mapInArrow(_scored(shared), "doc_id long, score double, content double, metadata double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "content", "metadata", (F.col("score") >= threshold).alias("kept"))
