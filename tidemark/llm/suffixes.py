"""Suffix-array deduplication: maximal repeats from the common-prefix intervals of an enhanced suffix array.

A shard's passages (``repeats``) are joined with separators of their own, and sorted suffixes and common
prefixes of neighbours are computed by doubling in numpy. A stack scan over the common prefixes yields the
interval tree; an interval whose suffixes have different symbols to their left is a maximal repeat, and all
its suffixes are its occurrences, not just neighbours. Within a group the first document's occurrence stays
and every later document's is removed.

That is exact: a window that two documents have extends to the left, with all its occurrences alike, to a
maximal repeat at least as long, which has the same documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import mix

#: Bytes in a window.
LENGTH = 50
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


BYTES = repeats.Alphabet(symbols, lambda x: _OF_BYTE[x], np.uint8, 1, 24)


def _ranks(joined: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers that tell apart the strings of ``n`` symbols at ``at``. Hashes put equal ones side by side; symbols are compared."""
    h = repeats.contents(mix(joined.astype(np.uint64) + np.uint64(1)), at, np.full(at.size, n))
    order = np.argsort(h)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]]
    rows = np.lib.stride_tricks.sliding_window_view(joined, n)[at[order]]
    if (rows[1:][~new[1:]] != rows[:-1][~new[1:]]).any():  # two strings of one hash
        return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)[np.argsort(order)]
    out = np.empty(at.size, np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_array(codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before (0 for the first), by doubling.

    Codes are the numbers from 0 on, all used; ``left`` says how many there are up to the end of the string, the own one included; a suffix ends there.
    """
    n, step, rank = codes.size, 1, codes
    levels = [rank]
    while True:
        key = rank * (n + 1)
        inside = np.flatnonzero(left > step)
        key[inside] += rank[inside + step] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        finer = np.empty(n, np.int64)
        finer[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        if finer[order[-1]] == rank.max():  # no class was split: equal ranks are equal suffixes
            break
        rank, step = finer, 2 * step
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.where(rank[a] == rank[b], left[a], 0)
    open_ = np.flatnonzero(common == 0)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a[open_], b[open_]
        same = levels[k][x] == levels[k][y]  # of unequal suffixes, so neither has ended
        hit, size = open_[same], 1 << k
        common[hit] += size
        a[hit] += size
        b[hit] += size
        ended = (common[hit] >= left[order[:-1][hit]]) | (common[hit] >= left[order[1:][hit]])
        open_ = np.setdiff1d(open_, hit[ended], assume_unique=True)
    return order, np.r_[0, common]


def intervals(common: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(prefix, from, to)`` of the common-prefix intervals of the neighbours ``at``, children before parents."""
    stack: list[tuple[int, int]] = []
    previous = -2
    for i in at.tolist() + [common.size + 1]:
        if i != previous + 1:  # a gap closes everything
            while stack:
                depth, start = stack.pop()
                yield depth, start, previous + 1
        if i > common.size:
            return
        depth, start = int(common[i]), i - 1
        while stack and stack[-1][0] > depth:
            top, start = stack.pop()
            yield top, start, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, start))
        previous = i


def maximal_repeats(strings: list[np.ndarray], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, string, place)`` of each maximal repeat of ``least`` symbols or more, with all occurrences.

    Shorter repeats don't count, so the array is one of strings of ``least``-symbol windows, each window a code.
    """
    sizes = np.array([s.size for s in strings])
    windows = np.maximum(sizes - least + 1, 0)
    total = int(windows.sum())
    if not total:
        return
    string = np.repeat(np.arange(sizes.size), windows)
    place = np.arange(total) - (np.cumsum(windows) - windows)[string]
    joined = np.concatenate(strings)
    at = (np.cumsum(sizes) - sizes)[string] + place
    order, common = suffix_array(_ranks(joined, at, least), windows[string] - place)
    before = np.where(place == 0, -1 - np.arange(total), joined[at - 1].astype(np.int64))[order]  # the start of a string is unlike all others
    turns = np.r_[False, before[1:] != before[:-1]]
    changes = np.cumsum(turns)
    alike = np.flatnonzero(common)
    # neighbours in a row with one symbol to the left of all have no maximal repeat
    row = np.cumsum(np.r_[True, alike[1:] != alike[:-1] + 1]) - 1 if alike.size else alike
    diverse = np.bincount(row, weights=turns[alike]) > 0 if alike.size else alike.astype(bool)
    for depth, a, b in intervals(common, alike[diverse[row]]):
        if changes[b - 1] != changes[a]:
            yield depth + least - 1, string[order[a:b]], place[order[a:b]]


def resolve(passages: list[repeats.Passage], length: int) -> list[tuple[np.ndarray, bool]]:
    """For each passage the windows that an earlier document's passage has too; and whether a later copy of it is in groups throughout.

    A passage that later documents have is in the array twice, the second time for all of these.
    """
    _, rank = np.unique([p[1] for p in passages], return_inverse=True)
    twice = np.flatnonzero([p[2] for p in passages])
    docs = np.r_[2 * rank, 2 * rank[twice] + 1]
    strings = [p[3] for p in passages] + [passages[k][3] for k in twice]
    sizes = np.array([s.size for s in strings])
    offset = np.cumsum(sizes + 1) - sizes - 1
    edge = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    if groups := list(maximal_repeats(strings, length)):
        repeat, string, place = zip(*groups)
        counts = np.array([x.size for x in string])
        string, place, repeat = np.concatenate(string), np.concatenate(place), np.repeat(repeat, counts)
        of = docs[string]
        later = of > np.repeat(np.minimum.reduceat(of, np.cumsum(counts) - counts), counts)
        at = (offset[string] + place)[later]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + repeat[later] - length + 1, -1)
    marked = np.cumsum(edge) > 0
    marks = [marked[o : o + n - length + 1] for o, n in zip(offset.tolist(), sizes.tolist())]
    found = np.zeros(len(passages), bool)
    found[twice] = [m.all() for m in marks[len(passages) :]]
    return list(zip(marks, found.tolist()))


def _keep(data: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The frame with repeated bytes taken from the texts; a character that lost some of its bytes goes."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for x, starts, ends in zip(*batch):
                out.append(x if starts is None else _keep(x.encode(), starts, ends).decode(errors="ignore"))
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return repeats.with_spans(docs, BYTES, resolve, length, F.pandas_udf(run, "string"), doc_id, text)


def _digest(data: bytes, starts: list, ends: list) -> tuple:
    kept = _keep(data, starts, ends)
    return len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    return repeats.digests(docs, BYTES, resolve, LENGTH, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
