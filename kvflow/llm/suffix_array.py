"""Suffix-array dedup with sparse suffix arrays.

Suffixes are retained at content-selected minimiser positions only (see :mod:`._repeats`). Within the group of one
minimiser the retained suffixes are sorted by the words to the right, and, reversed, by the words to the left; common
lengths of sorted neighbours give, at every depth, the blocks of suffixes that agree so far. A match of a window is an
agreement of o words to the left together with window - o words to the right, so extending both ways is a lookup of
the two blocks, and the result is exact without comparing pairs.

The definition of a removed word is that of the substring operator: it is covered by a ``window``-word window that
also starts in a document with a smaller id. Null text has no words; null doc_id takes no part; repeated rows of one
doc_id never remove each other; a document shorter than the window stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ._repeats import remove_repeats


def _common(x: list, y: list) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # the first lo words agree, the first hi do not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[:mid] == y[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _sorted(sides: list[list]) -> tuple[list[int], list[int]]:
    """The sparse suffix array of one side, and each entry's common length with the one before."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    return order, [0] + [_common(sides[i], sides[j]) for i, j in zip(order, order[1:])]


def _blocks(order: list[int], common: list[int], depth: int) -> list[int]:
    block, at = [0] * len(order), 0
    for place, (i, c) in enumerate(zip(order, common)):
        if c < depth:
            at = place
        block[i] = at
    return block


def _group(group: list[tuple[int, int, list[bytes]]], window: int) -> list[list[int]]:
    if len(group) == 1:
        off, doc, words = group[0]
        return [[doc] * (len(words) - window + 1)]
    right = _sorted([words[off:] for off, _, words in group])
    left = _sorted([words[:off][::-1] for off, _, words in group])
    out = [[doc] * (len(words) - window + 1) for _, doc, words in group]
    highest = max(off for off, _, _ in group)
    lowest = min(off - (len(words) - window) for off, _, words in group)
    for o in range(lowest, highest + 1):
        rights, lefts = _blocks(*right, window - o), _blocks(*left, o)
        has = [k for k, (off, _, words) in enumerate(group) if 0 <= off - o <= len(words) - window]
        least: dict = {}
        for k in has:
            key, doc = (rights[k], lefts[k]), group[k][1]
            if key not in least or doc < least[key]:
                least[key] = doc
        for k in has:
            out[k][group[k][0] - o] = least[rights[k], lefts[k]]
    return out


def suffix_array_engine(contexts: list[tuple[int, int, list[bytes]]], keys: list[int], window: int) -> list[list[int]]:
    """For each context (anchor offset, smallest document, words) the smallest document of each of its windows."""
    out: list[list[int]] = []
    start = 0
    for end in range(1, len(keys) + 1):
        if end == len(keys) or keys[end] != keys[start]:
            out += _group(contexts[start:end], window)
            start = end
    return out


def suffix_array_dedup(docs: DataFrame, window: int = 50, with_text: bool = True, **options) -> DataFrame:
    """Remove every word covered by a ``window``-word window that also starts in a document with a smaller id."""
    return remove_repeats(docs, suffix_array_engine, window=window, with_text=with_text, **options)
