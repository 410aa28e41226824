"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at ``RADIUS`` = 4 differing bits or fewer have a fingerprint between them that differs from each
in at most 2. So every fingerprint emits all 2,081 variants within 2 bits, and two fingerprints are linked
exactly if they emit a variant in common: a common variant puts them within 2 + 2 bits (no wrong links), and
the middle one is common (none missing).

Only distinct fingerprints take part, so a variant has at most 2,081 emitters however many documents are
alike, and each links to the least of them: no pairs are made within a group. Colliding pairs are deduplicated and
verified by counting the bits in which they differ. Before anything is shuffled in
full, two passes at four bytes a key leave out what can't meet: first fingerprints that share none of the
70 choices of four whole bytes with another (4 differing bits leave four of eight bytes equal), then
variants that only one fingerprint emits. Neither loses a link.

Texts without words have fingerprint zero, null ones too; whole texts count, however long. Repeated rows keep their
places; ties go to the least id. An empty table gives no rows, and other columns are left out. Documents with a
null id get the component of the others; a component of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared, similar
from tidemark.llm.common import blocks_for, bounded, dealt, fresh, mix, written
from tidemark.llm.graph import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a block of the two passes.
COARSE_BLOCK, FINE_BLOCK = 1 << 12, 1 << 9
NEVER_HOT = 1 << 62
#: Pieces into which the fingerprints of one component are dealt.
SALT = 16

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: All differences of up to RADIUS / 2 bits.
BALL = np.concatenate([np.zeros(1, np.uint64), _BITS, np.array([_BITS[i] | _BITS[j] for i, j in combinations(range(64), 2)], np.uint64)])
_BYTES = [np.uint64(0xFF) << np.uint64(8 * i) for i in range(8)]
MASKS = np.array([np.bitwise_or.reduce([_BYTES[i] for i in pick]) for pick in combinations(range(8), 4)], np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - n + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, h.size, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(part.size, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint as a signed long."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(F.col(text))


def _near(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.fp.to_numpy(np.int64).view(np.uint64)


def _coarse(fps: np.ndarray) -> np.ndarray:
    """The 70 keys of each fingerprint, as rows: the kept bytes, told apart by the choice."""
    choice = np.arange(MASKS.size, dtype=np.uint64)
    return mix((fps[:, None] & MASKS[None, :]) ^ mix(choice + np.uint64(1))[None, :])


def _fine(fps: np.ndarray) -> np.ndarray:
    """The variants of each fingerprint, scattered by a bijection so that buckets fill evenly."""
    return mix(fps[:, None] ^ BALL[None, :])


def _in_blocks(df: DataFrame, n: int) -> DataFrame:
    return dealt(df.select(F.pmod(F.xxhash64("fp"), F.lit(n)).alias("block"), "fp"), "block")


def _sender(keys_of, bits: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(_near(pdf))
        keys = keys_of(fps)
        owners = np.repeat(np.arange(fps.size), keys.shape[1])
        distinct, many, count = shared.unique_keys(keys.ravel(), owners)
        return shared.send(key[0], distinct, many, count, bits)

    return run


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each emitter of a variant with the least one, once in a bucket."""
    both = np.concatenate([np.frombuffer(p, np.int64) for p in pdf.payload]).reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    v, fp = both[order, 0], both[order, 1]
    first = np.r_[True, v[1:] != v[:-1]]
    least = fp[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([least, fp], 1)[least != fp], axis=0)
    pairs = pairs[np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= RADIUS]
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that are within RADIUS, and no others."""
    total = fps.count()

    n, bits = blocks_for(total, COARSE_BLOCK), shared.bucket_bits(total * MASKS.size)
    rows = _in_blocks(fps, n)
    answers = shared.meet(rows.groupBy("block").applyInPandas(_sender(_coarse, bits), shared.SENT), NEVER_HOT)

    def survive(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(_near(pdf))
        keys = _coarse(own)
        distinct = np.unique(keys)
        hit = shared.received(got, distinct, bits)[0][np.searchsorted(distinct, keys)].any(axis=1)
        return pd.DataFrame({"fp": own[hit].view(np.int64)})

    left = written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(survive, "fp long"), "near")

    total = left.count()
    n, fine_bits = blocks_for(total, FINE_BLOCK), shared.bucket_bits(total * BALL.size)
    rows = _in_blocks(left, n)
    answers = shared.meet(rows.groupBy("block").applyInPandas(_sender(_fine, fine_bits), shared.SENT), NEVER_HOT)

    def emit(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(_near(pdf))
        keys = _fine(own)
        distinct = np.unique(keys)
        hit = shared.received(got, distinct, fine_bits)[0][np.searchsorted(distinct, keys)]
        v, fp = keys[hit], np.broadcast_to(own[:, None], keys.shape)[hit]
        order = np.argsort(v, kind="stable")
        v, fp = v[order], fp[order]
        pairs = np.stack([v, fp], 1)
        rows = [(b, pairs[i:j].tobytes()) for b, i, j in shared.slices(v, fine_bits)]
        return pd.DataFrame(rows, columns=["bucket", "payload"])

    sent = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(emit, "bucket long, payload binary")
    return dealt(sent, "bucket").groupBy("bucket").applyInPandas(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (hexadecimal), ``component_id``: a row for each row of ``docs``."""
    fps = written(bounded(docs).select(F.col(doc_id).alias("doc_id"), fingerprint_column(text).alias("fp")), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # only linked fingerprints meet their component, in SALT pieces, as one may have very many
    linked = nodes.join(components(links(fps.select("fp").distinct())).withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    of_linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(least, ["root", "salt"]).select("fp", "component_id")
    by_fp = nodes.join(of_linked, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(texts: DataFrame) -> DataFrame:
    """``node, group`` of ``node, fp``: the texts that share their fingerprint or are linked by it, with their component."""
    by_fp = written(texts.groupBy("fp").agg(F.count("*").alias("c")), "by_fp")
    linked = written(components(links(by_fp.select("fp"))).select(F.col("node").alias("fp"), F.col("root").alias("group")), "linked")
    equal = by_fp.where("c > 1").join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("group"))
    return texts.select("node", "fp").join(linked.unionByName(equal), "fp").select("node", "group")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node, root``: a row for each row of ``docs``; equal roots are connected by pairs that are alike.

    Pairs within RADIUS are those that the fingerprints bring together, verified on shingles; ``similar`` adds the wider ones.
    """
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), similar.node_column(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes = written(rows.select("doc_id", "node"), "nodes")
    texts = written(rows.select("node", "text", fingerprint_column().alias("fp")).dropDuplicates(["node"]), "texts")
    roots = components(similar.links(texts, candidates(texts), RADIUS))
    return nodes.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of texts that are alike, the one with the smallest id, with its columns.

    Alike are texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints within RADIUS find pairs
    of them, and each is verified; as four bits are a narrow radius for texts, ``similar`` finds the pairs beyond it. So the groups
    aren't those of ``near_duplicates``. Rows with a null id are kept: nothing says which of them
    is first. Of repeated rows, of one id and the same words, one stays; unlike texts of one id both may.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    found = grouped(known, doc_id, text)
    first, node = fresh(docs, "first_of_component"), fresh(docs, "node")
    least = found.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("r"))
    several = found.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    stay = written(least.select("r.*").join(several, "doc_id").select(F.col("doc_id").alias(first), F.col("node").alias(f"of_{node}"), "several"), "stay")
    # Ids of one row, nearly all, need no look at their texts; these are streamed past the ids, not sorted.
    one = known.join(stay.where("NOT several").hint("shuffle_hash"), F.col(doc_id) == F.col(first), "left_semi")
    again = known.join(stay.where("several").select(F.col(first)).distinct().hint("shuffle_hash"), F.col(doc_id) == F.col(first), "left_semi")
    same = (F.col(doc_id) == F.col(first)) & (F.col(node) == F.col(f"of_{node}"))
    again = again.withColumn(node, similar.node_column(text)).join(stay.where("several").drop("several"), same, "left_semi").dropDuplicates([doc_id, node]).drop(node)
    return one.unionByName(again).unionByName(docs.where(F.col(doc_id).isNull()))
