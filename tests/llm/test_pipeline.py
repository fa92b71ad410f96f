"""The pipeline and scores against plain Python, and workers that cannot import the package."""

import hashlib
import math
import os
import pathlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash

from kvflow.llm import packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
REPO = pathlib.Path(__file__).parents[2]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic documents, near copies, secrets, an uneven mix, nulls and empty texts."""
    r = random.Random(21)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(150):
        text = [r.choice(words) for _ in range(r.randrange(3, 150))]
        if i % 6 == 0:
            for bad in r.sample(["idiot", "1d1ot", "scumbag", "moron,", "mоron"], 3):
                text.insert(r.randrange(len(text)), bad)
        if i % 7 == 0:
            text.insert(2, f"token=abc{i}defghiJKL9")
        if i % 11 == 0:
            text.insert(1, "api_key: publishedexample1")
        rows.append((i, " ".join(text), "en", f"s{min(3, i % 9)}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(200 + i, rows[1][1], "en", "s1") for i in range(5)] + [(300 + i, rows[2][1] + f" tail{i}", "de", "s2") for i in range(3)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " \t", "en", None), (403, "one", "en", "s3"), (404, " ".join(r.choice(words) for _ in range(6000)), "fr", "s4")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def plain_toxicity(model, text):
    """Every word against every term, without an automaton."""
    words, total, hits = toxicity.folded_words(text), 0.0, 0
    for i, w in enumerate(words):
        fits = [(v, t) for t, v in model.terms.items() if (" " + w + " ").startswith(t)]
        if fits:
            weight, term = max(fits, key=lambda f: (f[0], -len(f[1])))
            if (words[i - 1] if i else "") + term not in model.exceptions:
                total, hits = total + weight, hits + 1
    x = (math.log1p(total), min(hits, 5), math.log1p(100.0 * total / (len(words) + 20)), 1.0)
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x))))


def plain_dedup(rows):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints, kept, root = [fingerprint(r[1]) for r in rows], [], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root = [root[j] if x == root[i] else x for x in root]
    for c in set(root):
        kept.append(min(r for r, x in zip(rows, root) if x == c))
    return kept


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(rows):
    """Only assignments occur in this fixture, each without anything key-like beside it."""
    found = [[m for m in ASSIGN.finditer(t or "") if len(m[2]) >= 12] for _, t, *_ in rows]
    owners, texts = {}, {}
    for (_, t, _, source), ms in zip(rows, found):
        for m in ms:
            owners.setdefault(m[2], set()).add(source)
            texts.setdefault(m[2], set()).add(t)
    out = []
    for (d, t, lang, source), ms in zip(rows, found):
        for m in reversed(ms):
            if not (len(owners[m[2]]) > 2 or len(owners[m[2]]) > 1 and len(texts[m[2]]) > 20):
                t = t[: m.start()] + "[SECRET]" + t[m.end() :]
        out.append((d, t, lang, source))
    return out


def plain_mix(rows):
    sized = [(r, len(WORD.findall(r[1] or "")), int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16)) for r in rows]
    size = {}
    for r, n, _ in sized:
        size[r[3]] = size.get(r[3], 0) + n
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    free = list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        for s in over or free:
            target[s] = 2 * size[s] if over else level * weight[s]
            left -= target[s] if over else 0
        free = [s for s in free if s not in target]
    out = []
    for s in order:
        mine = sorted(((h, n, r) for r, n, h in sized if r[3] == s), key=lambda x: x[0])
        passes = int(target[s] // size[s]) if size[s] else 0
        need = int(target[s]) - passes * size[s]
        for _, n, r in mine:
            part = min(n, need)
            need -= part
            out += [r] * (int((passes * n + part) / n + 0.5) if n else 1)
    return out


def plain_pack(rows, tokenizer):
    out = []
    for d, t, *_ in rows:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [1], 0
        while at < len(ids):
            n = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            out.append((d, at, n, tuple(ids[at : at + n])))
            at += n
    return out


def test_pipeline_against_brute_force(spark, tables):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(abs(scores[d] - plain_toxicity(model, t or "")) < 1e-9 for d, t, *_ in rows)
    stages = [lambda now: [r for r in now if plain_toxicity(model, r[1] or "") < 0.7], plain_dedup, plain_secrets, plain_mix]
    now, got = rows, docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, stages):
        now, got = plain(now), stage(spark, got, folder)
        key = lambda r: repr(r)
        assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in got.collect()), key=key) == sorted(now, key=key), name
    assert len(now) < 2 * len(rows) and any("[SECRET]" in (t or "") for _, t, *_ in now) and any("publishedexample1" in (t or "") for _, t, *_ in now)
    want = plain_pack(now, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    packed = [(r.doc_id, r.start, r.length, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(packed, key=repr) == sorted(want, key=repr)


def test_quality_against_plain_rounds(spark, tables):
    """The exchange of pseudo-labels over all unlabelled documents, and the scores, against a loop over plain rows."""
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(4)
    graded = [(d, int(len(WORD.findall(t or "")) > 70)) for d, t, *_ in rows if d % 4 == 0 and d < 200]
    labels = spark.createDataFrame(graded, "doc_id long, quality int")
    rounds, handed = 2, 12
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    views = {d: [quality.content_view((t or "").encode().split()), quality.metadata_view((t or "").encode(), len((t or "").encode().split()), lang, source)] for d, t, lang, source in rows}
    views = {d: [np.minimum(v, 6e4).astype("<f2") for v in both] for d, both in views.items()}
    known = sorted((d, y) for d, y in graded if not held(d))
    mixed = np.random.default_rng(5).permutation(len(known))
    y = np.array([known[i][1] for i in mixed], float)
    x = [np.array([views[known[i][0]][k] for i in mixed], float) for k in (0, 1)]
    aside = np.arange(len(y)) % 5 == 0
    train = [[v[~aside], y[~aside]] for v in x]
    named, used = {d for d, _ in graded}, set()
    for _ in range(rounds):
        fitted, gone = [quality.View().fit(*t) for t in train], set()
        picked = []
        for k in (0, 1):
            w, b = fitted[k].plain()
            for label in (0, 1):
                best = {}
                for d in sorted(d for d in views if d not in named and d not in used and not held(d)):
                    margin = float(views[d][k].astype(float) @ w + b) * (1 if label else -1)
                    if margin >= quality.SURE:
                        best.setdefault((views[d][0].tobytes(), views[d][1].tobytes()), (-margin, d))
                for _, d in sorted(best.values())[: handed // 2]:
                    picked.append((k, label, d))
                    gone.add(d)
        used |= gone
        for k in (0, 1):
            mine = sorted((label, d) for j, label, d in picked if j == k)
            if mine:
                train[1 - k][0] = np.r_[train[1 - k][0], [views[d][1 - k].astype(float) for _, d in mine]]
                train[1 - k][1] = np.r_[train[1 - k][1], [float(label) for label, _ in mine]]
    last = [quality.View().fit(*t).calibrate(v[aside], y[aside]).plain() for t, v in zip(train, x)]
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, rounds=rounds, handed=handed).collect()}
    assert used and set(got) == set(views)
    for d, both in views.items():
        z = sum(np.clip(v.astype(float) @ w + b, -12, 12) for v, (w, b) in zip(both, last))
        assert abs(got[d] - 1 / (1 + np.exp(-z / 2))) < 1e-6


def test_pieces():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        cut = list(packing.pieces(n, 2048))
        assert sum(k for _, k in cut) == n and all(k & (k - 1) == 0 for _, k in cut)


def test_workers_without_the_package(tables):
    """Functions and broadcasts travel by value: only the driver can import the package."""
    script = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {"file://" + tables[0] + "/shared"!r}).getOrCreate()
try:
    spark.range(2).mapInArrow(eval("lambda bs: __import__('kvflow') and bs"), "id long").count()
    raise SystemExit("workers can import the package")
except Exception as e:
    assert "No module named" in str(e), e
from kvflow.llm import ann, quality, simhash, toxicity
docs, labels = spark.read.parquet({tables[0] + "/documents.parquet"!r}), spark.read.parquet({tables[0] + "/labels.parquet"!r})
vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[F.sin((F.col("id") + 1) * k) for k in range(1, 9)]).alias("embedding"))
print("counts", ann.nearest_neighbours(vectors).count(), toxicity.score_toxicity(docs, labels).count() == quality.score_quality(docs, labels).count() == docs.count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", script], cwd=tables[0], env=env, capture_output=True, text=True, timeout=300)
    assert "counts 10 True" in run.stdout, run.stderr[-2000:]
