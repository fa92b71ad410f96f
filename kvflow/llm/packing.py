"""Packing by power-of-two decomposition.

A document's token ids (with the end id) are cut into pieces whose lengths are powers of two: as many pieces of the
sequence length as fit, then the binary digits of the rest, longest first. Each piece is a sequence of its own, so no
sequence crosses documents and none has padding; equal lengths share a bucket (``bucket`` = log2 of the length), from
which batches of equal length are drawn. No shuffle is needed: pieces of a document depend on it alone.

Texts are tokenised word by word behind a cache. That gives the ids of the whole text for tokenisers whose
pre-tokeniser never crosses ASCII white space and drops it; :func:`word_safe` checks this on the given file.

Defined cases: null or empty text is the end id alone (one piece of length 1); null ids pass through; repeated rows
are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import chunks, small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words of one generation of a worker's cache (two are kept), and the longest word (bytes) that is kept.
CACHE_WORDS, CACHE_BYTES = 150_000, 48
#: Words that are one pre-token and their own normal form once lower-cased; marks that are a pre-token of their own.
LETTERS = re.compile("[a-zà-öø-ÿ]+")
MARKS = b".,"
PROBES = ["the", "schüß", "ñandú", "était", "x", "straße", "überträgt", ".", ",", ".,", ",."]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else from 256 on in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordIds:
    """Little-endian ids of white-space separated words, cached in two generations.

    Most words are letters and a closing mark. Where the tokeniser's model, asked directly for the letters, gives the
    ids of the whole tokeniser on probe words, such words skip the normaliser and the pre-tokeniser.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.encode, self.tokenize = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.known, self.older = Known(self), {}
        self.stems: dict[bytes, bytes] = {}
        whole = [e.ids for e in self.encode(PROBES, add_special_tokens=False)]
        upper = [e.ids for e in self.encode(["The", "ABC"], add_special_tokens=False)]
        lower = [e.ids for e in self.encode(["the", "abc"], add_special_tokens=False)]
        self.lower_case = upper == lower
        try:
            direct = [[t.id for t in self.tokenize(self._spelled(w.encode()))] for w in PROBES]
        except Exception:  # a model of another kind than byte-level pieces may refuse such strings
            direct = []
        self.fast = self.lower_case and direct == whole

    def _spelled(self, word: bytes) -> str:
        return word.decode("latin-1").translate(self.letters)

    def _stem(self, word: bytes) -> bytes | None:
        """Ids of a word of letters, or None if it has other marks."""
        got = self.stems.get(word)
        if got is None:
            text = word.decode("utf-8", "replace").lower()
            if not LETTERS.fullmatch(text):
                return None
            got = np.array([t.id for t in self.tokenize(self._spelled(text.encode()))], "<u4").tobytes()
            if len(word) <= CACHE_BYTES:
                if len(self.stems) >= CACHE_WORDS:
                    self.stems.clear()
                self.stems[word] = got
        return got

    def new(self, w: bytes) -> bytes:
        got = self.older.get(w)
        if got is None and self.fast:
            bare = w.rstrip(MARKS)
            got = self._stem(bare) if bare else None
            if got is not None and len(bare) < len(w):
                mark = w[len(bare) :]
                if mark not in self.stems:
                    self.stems[mark] = self._whole(mark)
                got += self.stems[mark]
        return self._whole(w) if got is None else got

    def _whole(self, w: bytes) -> bytes:
        return np.array(self.encode([w.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        # names of special tokens are told apart by case, all else is lower-cased by the tokeniser anyway
        words = (text.lower() if self.lower_case and b"<|" not in text else text).split()
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, Known(self)
        return out


class Known(dict):
    """Ids by word; a new word is worked out once and kept unless it is long."""

    def __init__(self, ids: WordIds):
        super().__init__()
        self.new = ids.new

    def __missing__(self, w: bytes) -> bytes:
        got = self.new(w)
        if len(w) <= CACHE_BYTES:
            self[w] = got
        return got


def worker_ids(tokenizer_json: str) -> WordIds:
    """One cache per Python worker and tokeniser, kept from task to task."""
    held = vars(sys).setdefault("_kvflow_word_ids", {})
    key = zlib.crc32(tokenizer_json.encode())
    if key not in held:
        held[key] = WordIds(tokenizer_json)
    return held[key]


def pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens, longest first."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    for bit in range(longest.bit_length() - 1, -1, -1):
        if (n - start) >> bit & 1:
            yield start, 1 << bit
            start += 1 << bit


def _packer(tokenizer, longest: int, end_id: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_ids(tokenizer.value)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in chunks(whole, "bytes"):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(ids_of.of(t or b"") for t in b.column("bytes").to_pylist()):
                    ids += end
                    n = len(ids) // 4
                    for s, k in pieces(n, longest):
                        piece = ids[4 * s : 4 * (s + k)]
                        row.append(i)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
                cols = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return pack


def word_safe(tokenizer_json: str, probe: str = "It's  naïve\tΑΣ x́y\n42! <|endoftext|>   中文's") -> bool:
    """Whether word-by-word ids equal whole-text ids on a probe with the usual traps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    whole = t.encode(probe, add_special_tokens=False).ids
    return whole == [i for w in probe.encode().split() for i in t.encode(w.decode(), add_special_tokens=False).ids]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, longest: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and the ids)."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if not word_safe(text):
        raise ValueError("this tokeniser joins or keeps white space; it cannot be run word by word")
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(text)  # a vocabulary file: a few MB, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"))
    out = rows.mapInArrow(_packer(shipped, longest, end_id, with_ids), PIECES + (", ids array<int>" if with_ids else ""))
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2(F.col("length").cast("double")).cast("int"))
