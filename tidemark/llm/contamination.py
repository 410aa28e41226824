"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Shingles are five words in a row of the text with A-Z lower-cased; a text of fewer words is one shingle;
one without words has none. A document is contaminated by an item if it contains at least 0.8 of the item's
distinct shingles.

Items are short and documents may be very long, so a similarity of whole sets says nothing; containment is
searched from the items' side (containment MinHash: the small set has a sketch, the large one answers for all its
hashes). Items are put into partitions by size, powers of two. Each item's sketch is its ``k`` smallest shingle
hashes (bottom-k MinHash), with one ``k`` for the partition; the share of the sketch that a document has estimates the
containment. An item of up to ``u`` shingles that is contained to ``t`` misses at most ``(1 - t) * u`` of them, so with
``k = floor((1 - t) * u) + 1`` its estimate is over zero: that makes a candidate, no such item is missed, and there is
no chance in it. An item of fewer than five words isn't searched inside longer documents: these have
no shingle of its length. Candidates are verified by comparing the shingles' text.

The benchmark is the stated set of queries: it is taken in blocks of about ``BLOCK_BYTES`` of text, by a hash, and each
block is held against all documents, which are read where they lie, without a shuffle. A block's sketches and texts,
some two times its bytes, are what the driver and each worker hold; they go before the next block comes.

Null texts have no shingles, empty ones neither; whole texts are searched, however long. Repeated rows of documents
give repeated results; repeated rows of items give one, equal items with different ids one each. An empty benchmark
contaminates nothing. ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, bounded, fresh, mix, text_bytes, written

WORDS = 5
#: Containment as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BITS = 20

HITS = "array<struct<item_id: long, n_shared: int, n_item: int>>"


def lowered(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, h.size)
    if not n:
        return h
    out = h[: h.size - n + 1].copy()
    for k in range(1, n):
        out = out * _BASE + h[k : h.size - n + 1 + k]
    return mix(out + np.uint64(n))


def shingles(words: list[bytes]) -> set[bytes]:
    n = min(WORDS, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """The sketches of some items, and their texts for verifying."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        parts, sizes = [], []
        self.items = [(i, text) for i, text in items if lowered(text)]
        for at, (_, text) in enumerate(self.items):
            own = np.unique(shingle_hashes(lowered(text)))
            upper = 1 << (own.size - 1).bit_length()  # of the item's size partition
            hashes = own[: (DENOMINATOR - NUMERATOR) * upper // DENOMINATOR + 1]
            parts.append(hashes)
            sizes.append(hashes.size)
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.may = np.zeros(1 << _BITS, bool)
        self.may[self.hashes >> np.uint64(64 - _BITS)] = True

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        words = lowered(text)
        h = shingle_hashes(words)
        h = np.unique(h[self.may[h >> np.uint64(64 - _BITS)]])
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        found = sorted({int(o) for a, b in zip(low, high) for o in self.owner[a:b]})
        if not found:
            return []
        have, out = shingles(words), []
        for at in found:
            item, own = self.items[at][0], shingles(lowered(self.items[at][1]))
            shared = len(own & have)
            if DENOMINATOR * shared >= NUMERATOR * len(own):
                out.append((item, shared, len(own)))
        return out


def _hits(index: Broadcast, text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"item_id": i, "n_shared": s, "n_item": n} for i, s, n in index.value.search(t)] for t in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, HITS)(text)


def _blocks(items: DataFrame, item_id: str, text: str) -> tuple[int, Callable[[int], Broadcast]]:
    """How many blocks the benchmark has, and what sends one to the executors."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    n = blocks_for(text_bytes(rows), BLOCK_BYTES)

    def sent(k: int) -> Broadcast:
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in block]))

    return n, sent


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: a row for each document and item that it contains."""
    docs = bounded(docs)
    n, sent = _blocks(items, item_id, item_text)

    def found(index: Broadcast) -> DataFrame:
        return docs.select(F.col(doc_id).alias("doc_id"), F.explode(_hits(index, F.col(text))).alias("hit")).select("doc_id", "hit.*")

    if n == 1:
        return found(sent(0))
    out = None
    for k in range(n):
        index = sent(k)
        part = written(found(index), "contaminated")
        index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with their columns. With several blocks, texts with an item are told by their hash."""
    docs = bounded(docs)
    n, sent = _blocks(items, item_id, item_text)
    if n == 1:
        hits = fresh(docs, "hits")
        return docs.withColumn(hits, _hits(sent(0), F.col(text))).where(F.size(hits) == 0).drop(hits)
    hashed, bad = fresh(docs, "text_hash"), None
    for k in range(n):
        index = sent(k)
        part = written(docs.where(F.size(_hits(index, F.col(text))) > 0).select(F.sha2(text, 256).alias("bad")).distinct(), "contaminated")
        index.destroy()
        bad = part if bad is None else bad.unionByName(part)
    return docs.withColumn(hashed, F.sha2(text, 256)).join(bad.distinct(), F.col(hashed) == F.col("bad"), "left_anti").drop(hashed)
