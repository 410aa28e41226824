"""Substring deduplication by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so an automaton of the reference, sent to
all tasks, would grow with the corpus. The reference is therefore cut into shards of passages (``repeats``),
and each shard's automaton goes to the one task that gets the passages to stream; what is sent is bounded by
a shard. Every passage that two documents have, whole copies too, is in a shard and is streamed through it symbol by symbol for its matching statistics: the state of the
longest suffix that the shard holds. Each state knows the least document that has its strings, so where the
match reaches the window's length, the state of exactly that length says which document had it first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import words

#: Words in a window.
LENGTH = 50


def symbols(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word."""
    w = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


WORDS = repeats.Alphabet(symbols, lambda x: x, np.uint64, 6, 8)


class SuffixAutomaton:
    """Of several strings of numbers, each with the document that has it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 63]

    def _state(self, follow: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of ``q`` that are one longer than ``p``'s."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1, 1 << 63)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, string: list[int], doc: int) -> None:
        last = 0
        for c in string:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                self.first[last] = min(self.first[last], doc)
                continue
            made = self._state({}, 0, self.length[last] + 1, doc)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = made
                p = self.link[p]
            if p >= 0:
                self.link[made] = self._split(p, c, self.next[p][c])
            last = made

    def finish(self) -> None:
        """Hands the least documents on to the shorter suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.first[v] < self.first[up]:
                self.first[up] = self.first[v]

    def stream(self, string: list[int], length: int) -> list[int]:
        """For each window of the string the first document that has it, 2**63 where none has."""
        follow, link, deep, first = self.next, self.link, self.length, self.first
        v = matched = 0
        out = []
        for i, c in enumerate(string):
            while v and c not in follow[v]:
                v = link[v]
                matched = deep[v]
            if c in follow[v]:
                v = follow[v][c]
                matched += 1
            while v and deep[link[v]] >= length:
                v = link[v]
                matched = min(matched, deep[v])
            if i >= length - 1:
                out.append(first[v] if matched >= length else 1 << 63)
        return out


def resolve(passages: list[repeats.Passage], length: int) -> list[tuple[np.ndarray, bool]]:
    """For each passage the windows that an earlier document's passage has too; and whether the shard holds all its windows."""
    automaton = SuffixAutomaton()
    strings = [p[3].tolist() for p in passages]
    for (_, doc, _, _), s in zip(passages, strings):
        automaton.add(s, doc)
    automaton.finish()
    out = []
    for (_, doc, later, _), s in zip(passages, strings):
        first = automaton.stream(s, length)
        out.append((np.array([x < doc for x in first], bool), later and max(first) <= doc))
    return out


def _keep(w: list[bytes], starts, ends) -> list[bytes]:
    out, at = [], 0
    for a, b in zip(starts, ends):
        out += w[at:a]
        at = b
    return out + w[at:]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The frame with repeated words taken from the texts; the words left of a text that lost any are joined by spaces."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for x, starts, ends in zip(*batch):
                out.append(x if starts is None else b" ".join(_keep(words(x), starts, ends)).decode())
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return repeats.with_spans(docs, WORDS, resolve, length, F.pandas_udf(run, "string"), doc_id, text)


def _digest(data: bytes, starts: list, ends: list) -> tuple:
    w = data.split()
    kept = _keep(w, starts, ends)
    return len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    return repeats.digests(docs, WORDS, resolve, LENGTH, _digest, "n_words long, n_removed long, kept_sha256 string")
