"""Links of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, found without chance.

Texts with near fingerprints come as groups (``simhash.candidates``), and their pairs are verified first. Fingerprints of
texts that are alike may differ in more bits; such pairs are found by prefixes. Texts that are connected by then aren't
compared again, nor are pairs within the fingerprints' radius: these are left to the fingerprints.

Shingles are those of ``contamination``. In one order of all shingles, two sets of that similarity share one of
the first ``n - ceil(0.8 n) + 1`` of their ``n`` shingles. The order is by the number of texts that have a
shingle, then by hash, so the first are the rarest. Shingles of one text only can't meet: a text with enough
of its own sends nothing, and common passages come last.

Texts are in blocks. A block sends its shingles at four bytes each, with the number of its texts that have
them, and gets the sums, at most 255, back (as in ``shared``; shingles that fall together get one sum, which
is still an order). Texts that share a shingle of their beginnings, directly or by others, are a candidate
group, and are verified where they meet. A task gets some ``CHUNK_BYTES`` or
``CHUNK_TEXTS`` of a group, whichever is less:

1. A group is dealt to chunks, and each is verified for itself. A group of one chunk is done. A fingerprints' group of
   more chunks has pairs that no chunk has seen; its texts aren't spared in what follows.
2. Larger groups by prefixes are dealt and verified a second time, otherwise: what is alike within the first chunks meets
   again, so a large group of near copies is mostly one component now.
3. Pairs that no chunk has seen and whose components differ share a shingle of their beginnings. For each such shingle
   the texts of its most frequent component lie in chunks, and only its other texts go to all of them.

So no pair is left out, and near copies cost three passes however many they are, one of them by their fingerprints. Only unlike texts that share one rare
shingle cost more than in proportion: texts outside the shingle's largest component, times its chunks.

Texts with the same words, A-Z lower-cased, are one node, told by a hash of 64 bits. Links are verified on the
shingles' text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.common import blocks_for, bounded, dealt, text_bytes, written
from tidemark.llm.contamination import lowered, shingle_hashes, shingles
from tidemark.llm.graph import components

#: The least similarity as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Bytes of text in a block, and in a chunk of a candidate group.
BLOCK_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
#: Texts in a chunk: they are compared with each other while they aren't connected.
CHUNK_TEXTS = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SENT = "block long, bucket long, payload binary, counts binary"
_SUMS = "block long, bucket long, counts binary"


def node_column(text: str = "text") -> Column:
    """A long for the words of a text; null and empty texts have the same one."""
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), "")
    return F.xxhash64(F.array_join(words, " "))


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(lowered(t))) for t in pdf.text]


def _prefix(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def _send(bits: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(_sets(pdf)), return_counts=True)
        short, counts = (keys >> np.uint64(32 - bits)).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        rows = [(key[0], b, short[i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in shared.slices(keys, bits)]
        return pd.DataFrame(rows, columns=["block", "bucket", "payload", "counts"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(p, np.uint32) for p in pdf.payload]
    keys, counts = np.concatenate(parts), np.concatenate([np.frombuffer(c, np.uint8) for c in pdf.counts])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
    out = np.empty(keys.size, np.uint8)
    out[order] = np.minimum(np.bincount(group, weights=counts[order]), 255).astype(np.uint8)[group]
    ends = np.cumsum([p.size for p in parts])
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "counts": [out[e - p.size : e].tobytes() for e, p in zip(ends, parts)]})


def _begin(bits: int):
    """``key, node`` of the shingles in each text's beginning that other texts have too."""

    def run(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        sets = _sets(pdf)
        keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        by, sums = dict(zip(got.bucket, got.counts)), np.zeros(keys.size, np.uint8)
        for b, i, j in shared.slices(keys, bits):
            sums[i:j] = np.frombuffer(by[b], np.uint8)
        found, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for node, own in zip(pdf.node, sets):
            s = sums[np.searchsorted(keys, own)]
            first = np.lexsort((own, s))[: _prefix(own.size)]
            first = first[s[first] > 1]
            found.append(own[first])
            nodes.append(np.full(first.size, node, np.int64))
        return pd.DataFrame({"key": np.concatenate(found).view(np.int64), "node": np.concatenate(nodes)})

    return run


def _verified(pdf: pd.DataFrame, radius: int | None = None) -> pd.DataFrame:
    """Links that connect all texts that are alike, and no others. Texts of one root are connected; of two visitors (not ``home``) other tasks see to.

    ``radius``: pairs of ``judged`` texts whose fingerprints differ in so many bits or fewer have been verified before.
    """
    sets, texts, nodes, home = _sets(pdf), pdf.text.tolist(), pdf.node.tolist(), pdf.home.to_numpy(bool)
    if radius is not None:
        fps, judged = pdf.fp.to_numpy(np.int64).view(np.uint64), pdf.judged.to_numpy(bool)
    sizes = np.array([s.size for s in sets])
    keys, counts = np.unique(np.concatenate(sets), return_counts=True)
    root, at, out = np.unique(pdf.root, return_inverse=True)[1], defaultdict(list), []
    for y, own in enumerate(sets):
        first = own[np.lexsort((own, counts[np.searchsorted(keys, own)]))[: _prefix(own.size)]].tolist()
        near = np.array(sorted({x for k in first for x in at.get(k, ())}), int)
        near = near[(DENOMINATOR * np.minimum(sizes[near], own.size) >= NUMERATOR * np.maximum(sizes[near], own.size)) & (home[near] | home[y])]
        if radius is not None:
            near = near[~(judged[near] & judged[y]) | (np.bitwise_count(fps[near] ^ fps[y]) > radius)]
        while (near := near[root[near] != root[y]]).size:
            x, near = near[0], near[1:]
            both = np.intersect1d(own, sets[x], assume_unique=True).size
            if DENOMINATOR * both < NUMERATOR * (own.size + sizes[x] - both):
                continue
            a, b = shingles(lowered(texts[x])), shingles(lowered(texts[y]))
            if DENOMINATOR * len(a & b) >= NUMERATOR * len(a | b):
                out.append((nodes[x], nodes[y]))
                root[root == root[x]] = root[y]
        for k in first:
            at[k].append(y)
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _meet(met: DataFrame, group: str, radius: int | None = None) -> DataFrame:
    """Links from ``node, text, root, home`` that meet in a group's chunk."""
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, group, "chunk").groupBy(group, "chunk").applyInPandas(lambda pdf: _verified(pdf, radius), "a long, b long").distinct()


def _chunks(count: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(size) / CHUNK_BYTES), F.ceil(F.col(count) / CHUNK_TEXTS), F.lit(1)).cast("int").alias("n")


def _placed(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, node, n``: the number of chunks that the node's group has."""
    placed = written(texts.select("node", F.octet_length("text").alias("bytes")).join(groups, "node"), "candidates")
    large = written(placed.groupBy("group").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes")).select("group", _chunks("c", "bytes")).where("n > 1"), "large")
    return placed.join(large, "group", "left").select("group", "node", F.coalesce("n", F.lit(1)).alias("n"))


def _alone(members: DataFrame, deal: int, radius: int | None = None) -> DataFrame:
    """Links within chunks of the groups; each ``deal`` deals otherwise."""
    chunk = F.pmod(F.xxhash64("node", F.lit(deal)), F.col("n")).alias("chunk")
    told = ("fp", "judged") if radius is not None else ()
    return _meet(members.select("group", chunk, "node", "text", "root", *told, F.lit(True).alias("home")), "group", radius)


def _across(members: DataFrame, keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between texts of different roots that share a key, at the chunks of the key's most frequent root."""
    known = members.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.octet_length("text").alias("bytes"))
    shared_by = written(keys.join(known, "node"), "shared")
    of_root = shared_by.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("node")).alias("x"))
    of_key = of_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes"), F.sum("h").alias("h"), F.bit_xor("x").alias("x"))
    # keys of the same texts are one
    few = of_key.where("roots > 1").groupBy("c", "h", "x").agg(F.min(F.struct("key", F.col("top.root").alias("most"), _chunks("c", "bytes"))).alias("k")).select("k.*")
    placed = shared_by.join(few, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    to = F.when(F.col("root") == F.col("most"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    sent = placed.select("key", "node", "root", "own", F.explode(to).alias("chunk")).select("key", "chunk", "node", "root", (F.col("own") == F.col("chunk")).alias("home"))
    return _meet(sent.join(members.select("node", "text"), "node"), "key")


def links(texts: DataFrame, close: DataFrame, radius: int) -> DataFrame:
    """``a, b`` from ``node, fp, text`` with distinct nodes: links that connect all nodes that are alike, and no others.

    ``close``: ``node, group``, where nodes are in one group if their fingerprints differ in ``radius`` bits or fewer.
    """
    by_print = written(_placed(texts, close), "close")
    found = written(_alone(texts.join(by_print, "node").withColumn("root", F.col("node")), 1), "links")

    total = text_bytes(texts)
    n, bits = blocks_for(total, BLOCK_BYTES), shared.bucket_bits(total // 4)
    rows = dealt(texts.select(F.pmod(F.xxhash64("node"), F.lit(n)).alias("block"), "node", "text"), "block")
    sent = rows.groupBy("block").applyInPandas(_send(bits), _SENT)
    sums = dealt(sent, "bucket").groupBy("bucket").applyInPandas(_sum, _SUMS)
    keys = written(rows.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(_begin(bits), "key long, node long"), "beginnings")

    least = keys.groupBy("key").agg(F.min("node").alias("a"))
    groups = components(keys.join(least, "key").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "group")
    # what a fingerprint's group in many chunks left out, nobody has judged
    apart = by_print.where("n > 1").select("node", F.lit(False).alias("judged"))
    known = _placed(texts, groups).join(components(found), "node", "left").join(apart, "node", "left")
    placed = written(known.select("group", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("judged", F.lit(True)).alias("judged")), "placed")
    found = found.unionByName(written(_alone(texts.join(placed, "node"), 2, radius), "links"))
    large = written(placed.where("n > 1").select("node").unionByName(apart.select("node")).distinct(), "in_large")
    if large.isEmpty():
        return found
    many = written(texts.join(large, "node"), "members")
    found = found.unionByName(written(_alone(many.join(placed.where("n > 1"), "node"), 3, radius), "links"))
    return found.unionByName(_across(many, keys, components(found)))
