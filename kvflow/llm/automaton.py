"""Substring dedup with suffix automata of reference shards.

Reference passages are cut into shards of bounded size by content (see :mod:`._repeats`), so only passages that can
share a window with a shard are streamed through it: an automaton is held by the one task that needs it, which keeps
what is shipped bounded whatever the corpus size (broadcasting every shard to every task would grow with the corpus).
Each shard gets one generalised suffix automaton; every state knows the smallest document in which its strings end.
Streaming a passage keeps its matching statistic, capped at the window length, so that at each word the state of the
last ``window`` words is at hand and with it the smallest document holding them.

Defined cases: null text has no words; null doc_id takes no part (nothing is removed, nothing is compared with it);
repeated rows of one doc_id never remove each other; a document shorter than the window stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ._repeats import remove_repeats


class SuffixAutomaton:
    """Generalised over several strings; ``low[state]`` is the least tag of a string in which the state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.low = [-1], [0], [None]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.low.append(None)
        return len(self.len) - 1

    def _split(self, p: int, w, q: int) -> int:
        """A copy of q for the strings of length len[p] + 1 and less."""
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, tag: int) -> None:
        nxt, link, length, low = self.next, self.link, self.len, self.low
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                cur = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            if low[last] is None or tag < low[last]:
                low[last] = tag

    def finish(self) -> None:
        """Carry least tags up the suffix links, longest states first."""
        low, link = self.low, self.link
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and (low[up] is None or low[s] < low[up]):
                low[up] = low[s]

    def least(self, words: list, window: int) -> list:
        """For each window of ``words``: the least tag of a string that holds it, or None."""
        nxt, link, length, low = self.next, self.link, self.len, self.low
        v = matched = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            if matched >= window:
                matched = window
                while length[link[v]] >= window:
                    v = link[v]
            if i >= window - 1:
                out.append(low[v] if matched == window else None)
        return out


def automaton_engine(contexts: list[tuple[int, int, list[bytes]]], keys: list[int], window: int) -> list[list[int]]:
    """For each context (anchor offset, smallest document, words) the smallest document of each of its windows."""
    shard = SuffixAutomaton()
    for _, doc, words in contexts:
        shard.add(words, doc)
    shard.finish()
    return [shard.least(words, window) for _, _, words in contexts]


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True, **options) -> DataFrame:
    """Remove every word covered by a ``window``-word window that also starts in a document with a smaller id."""
    return remove_repeats(docs, automaton_engine, window=window, with_text=with_text, **options)
