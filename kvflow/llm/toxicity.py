"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, maps homoglyphs to Latin letters and digit substitutions inside words back to letters. The lexicon
holds word beginnings of ``SHORTEST`` to ``LONGEST`` letters (and whole words) whose document frequency differs between
labelled toxic and clean rows, at most ``most_terms`` of them, those of most toxic rows first; its weights are log odds.
Exception phrases are a term with the word before it that occurs in clean rows: a match ending in
one does not count. The score is a logistic function of the matched weight, once saturated and once per 100 words, so
long texts are not toxic for their length. Lexicon and calibration are learned from a sample of at most
``toxic_rows`` + ``clean_rows`` labelled rows outside the held-out third; scoring covers every whole text. The terms'
thresholds were set on a split of the learning rows; the held-out third only served the figures in the README.

Defined cases: null and empty texts score as a text without matches; null ids are not held out; rows without a label
are scored, too; a table without labels of both kinds gets an empty lexicon and score 0; repeated rows score alike, and of
rows that share an id the least text is learned from; labels other than 0 and 1 are passed over, and of several labels
of one id the greatest holds. Other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import drop, written
from ._words import chunks, small_batches, tidy

#: Cyrillic and Greek letters that look Latin, and digit or symbol substitutions.
HOMOGLYPHS = dict(zip("авеікмнорстухѕјԁɡαεικνορτυχ", "abeikmhopctyxsjdgaeiknoptux"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EDGES = ".,!?;:\"'()[]{}<>*_-|&%#~+=/\\"
FOLD = str.maketrans({**HOMOGLYPHS, **SUBSTITUTES})
SHORTEST, LONGEST = 3, 8


def folded_words(text: str) -> list[str]:
    """Folded words without edge marks; a word of digits and marks only is not folded into letters."""
    out = []
    for w in text.lower().split():
        w = w.strip(EDGES)
        if w and not w.isalpha() and any(c.isalpha() for c in w):
            w = w.translate(FOLD)
        elif w and not w.isascii():
            w = w.translate(FOLD)
        out.append(w)
    return out


def terms_of(word: str) -> list[str]:
    """Its beginnings, as ' abc', and the whole word, as ' word '."""
    return [" " + word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ([" " + word + " "] if len(word) >= SHORTEST else [])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of terms by class, given out whenever many are held."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])
        counts.clear()
        return out

    for b in batches:
        for i in range(b.num_rows):
            label = b.column("label")[i].as_py()
            for t in {t for w in set(folded_words(b.column("text")[i].as_py() or "")) for t in terms_of(w)}:
                counts.setdefault(t, [0, 0])[label] += 1
            if len(counts) > 50_000:
                yield flush()
    yield flush()
    tidy()


def automaton(terms: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for t, w in terms.items():
        out.add_word(t, (len(t), w))
    if terms:
        out.make_automaton()
    return out


def matches(machine, words: list[str], exceptions: set[str]) -> tuple[float, int]:
    """Sum of the best weight of each matched word, and the number of such words."""
    if not len(machine):
        return 0.0, 0
    text = " " + " ".join(words) + " "
    best: dict[int, tuple[float, str]] = {}
    for end, (n, weight) in machine.iter(text):
        at = end - n + 1  # the space before the word
        if at not in best or weight > best[at][0]:
            best[at] = (weight, text[at : end + 1])
    total, hits = 0.0, 0
    for at, (weight, term) in best.items():
        if exceptions and text[text.rfind(" ", 0, at) + 1 : at] + term in exceptions:
            continue
        total += weight
        hits += 1
    return total, hits


def features(total: float, hits: int, n_words: int) -> tuple[float, float, float]:
    return math.log1p(total), min(hits, 5), math.log1p(100.0 * total / (n_words + 20))


def _matched(terms: dict, exceptions: set, phrases: bool):
    """Per row of the sample: features and label; or partial counts of (word before, term) phrases, of every phrase of
    either class, given out whenever many are held: only their sums over all tasks can be judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows, count = automaton(terms), [], (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            both = [*(count[0] | count[1])]
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([count[k][p] for p in both], pa.int64()) for k in (1, 0))], names=["phrase", "toxic", "clean"])
            count[0].clear()
            count[1].clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = folded_words(text or "")
                if phrases:
                    flat, seen = " " + " ".join(words) + " ", set()
                    for end, (n, _) in machine.iter(flat) if len(machine) else ():
                        at = end - n + 1
                        seen.add(flat[flat.rfind(" ", 0, at) + 1 : at] + flat[at : end + 1])
                    count[label].update(p for p in seen if not p.startswith(" "))
                    if len(count[0]) + len(count[1]) > 50_000:
                        yield flush()
                else:
                    rows.append((*features(*matches(machine, words, exceptions), len(words)), float(label)))
        if phrases:
            yield flush()
        else:
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols], names=["a", "b", "c", "label"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights with the bias last, by Newton's method with step halving on a ridge-penalised likelihood."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge / 2 * w @ w
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * max(1, now):
            break
        w, now = w - size * step, new
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bounds: tuple[int, int], columns: list[Column], id_col: str) -> DataFrame:
    """At most ``bounds[k]`` rows of label k outside the held-out third, chosen by a hash of the id: the columns and
    ``label``. Of rows that share an id the least one counts. Only the bounded id list is broadcast."""
    named = labels.select(F.col("doc_id").cast("long").alias("sample_id"), F.col(label_col).cast("int").alias("label"))
    named = named.where(F.col("label").isin(0, 1) & F.col("sample_id").isNotNull() & ~held_out(F.col("sample_id"))).groupBy("sample_id").agg(F.max("label").alias("label"))
    parts = [named.where(F.col("label") == k).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for k, n in enumerate(bounds)]
    chosen = parts[0].unionByName(parts[1])
    joined = docs.select(F.col(id_col).cast("long").alias("sample_id"), F.struct(*columns).alias("row")).join(F.broadcast(chosen), "sample_id")
    return joined.groupBy("sample_id", "label").agg(F.min("row").alias("row")).select("row.*", "label")


class ToxicityModel:
    """terms: weights; exceptions: phrases; weights of the logistic calibration."""

    def __init__(self, terms: dict[str, float], exceptions: set[str], weights: np.ndarray | None):
        self.terms, self.exceptions, self.weights = terms, exceptions, weights

    def plain(self) -> tuple[dict[str, float], set[str], list[float] | None]:
        """As plain values, for a broadcast: at most 2 x ``most_terms`` short strings."""
        return self.terms, self.exceptions, None if self.weights is None else self.weights.tolist()


def scorer(model: tuple[dict[str, float], set[str], list[float] | None]):
    """text -> (score, matched lexicon words)."""
    terms, exceptions, weights = model
    machine = automaton(terms)

    def score(text: str) -> tuple[float, int]:
        words = folded_words(text)
        total, hits = matches(machine, words, exceptions)
        if weights is None:
            return 0.0, hits
        z = sum(w * x for w, x in zip(weights, (*features(total, hits, len(words)), 1.0)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), hits

    return score


def learn(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 1500, clean_rows: int = 3000, support: int = 3, most_terms: int = 2000, odds: float = 2.5, least_share: float = 0.008, clean_share: float = 0.01, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, (clean_rows, toxic_rows), [F.col(text_col).alias("text")], id_col)
    sample = written(rows, "sample")
    rows = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, set(), None)
    counts = rows.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    # a term must occur in ``support`` toxic rows and in ``least_share`` of them, speak for at least ``odds`` and be rare
    # in clean rows: at most ``clean_share`` of its share in toxic ones, one row aside
    top = counts.withColumn("w", weight).where((F.col("toxic") >= max(support, least_share * n1)) & (F.col("w") >= odds) & (F.col("clean") * n1 <= clean_share * F.col("toxic") * n0 + n1))
    best = top.orderBy(F.col("toxic").desc(), F.length("term"), "term").limit(most_terms).collect()
    terms: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"]), r["term"])):
        shorter = [terms[r["term"][:n]] for n in range(SHORTEST + 1, len(r["term"])) if r["term"][:n] in terms]
        if not shorter or r["w"] > max(shorter) + 0.5:  # a longer beginning must say more than the shorter one
            terms[r["term"]] = float(r["w"])
    phrases = rows.mapInArrow(_matched(terms, set(), True), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    exceptions = {r["phrase"] for r in phrases.where("clean >= 3 and toxic * 9 <= clean").orderBy(F.col("clean").desc(), "phrase").limit(most_terms).collect()}
    data = rows.mapInArrow(_matched(terms, exceptions, False), "a double, b double, c double, label double").toPandas().to_numpy()
    drop(sample)
    data = data[np.lexsort(data.T)]  # the same sums whatever the order of tasks
    return ToxicityModel(terms, exceptions, logistic(data[:, :3], data[:, 3]))


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for whole in batches:
            for b in chunks(whole, "bytes"):
                got = [of((t or b"").decode("utf-8", "replace")) for t in b.column("bytes").to_pylist()]
                s, h = zip(*got) if got else ((), ())
                keep = [b.column(c) for c in b.schema.names if c != "bytes"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(s, pa.float64()), pa.array(h, pa.int64())], names=[c for c in b.schema.names if c != "bytes"] + ["score", "hits"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted, hits (matched lexicon words)."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"))
    out = rows.mapInArrow(_scored(shared), "doc_id long, score double, hits long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that score below the threshold, unchanged and without a shuffle; null texts score as empty ones,
    rows with null ids and repeated rows are judged like any other."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared, at = docs.sparkSession.sparkContext.broadcast(model.plain()), docs.columns.index(text_col)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for b in batches:
            texts = b.column(at)
            ok = [of(texts[i].as_py() or "")[0] < threshold for i in range(b.num_rows)]
            yield b.filter(pa.array(ok, pa.bool_()))
            tidy()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever marks the names hold
    return plain.mapInArrow(passed, plain.schema).toDF(*docs.columns)
