import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import corpus, gathered
from tidemark.llm import graph, simhash


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert gathered(simhash.near_duplicates(df)) == plain(rows)


def test_on_the_tables(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert gathered(simhash.near_duplicates(documents)) == plain(rows)


def test_long_texts_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(2, long, 1, 7, "s"), (1, long, 2, 8, "t"), (1, long, 2, 8, "t"), (3, None, 3, 9, "u")], "doc_id long, text string, fp long, root int, salt string")
    assert gathered(simhash.near_duplicates(df)) == plain([(2, long), (1, long), (1, long), (3, None)])
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_jvm_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 11), (7, 5)])
def test_links_connect_just_those_within_the_radius(spark, monkeypatch, sizes):
    monkeypatch.setattr(simhash, "COARSE_BLOCK", sizes[0])
    monkeypatch.setattr(simhash, "FINE_BLOCK", sizes[1])
    rng = random.Random(4)
    fps = [0, 15, 31]
    for _ in range(25):
        x = rng.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 3, 4, 5, 6, 8)]
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in set(fps)], "fp long")
    found = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in map(tuple, found))
    near = {f: f for f in fps}

    def root(x, up):
        while up[x] != x:
            x = up[x]
        return x

    for pairs in ([(a, b) for a in near for b in near if (a ^ b).bit_count() <= 4],):
        for a, b in pairs:
            near[root(a, near)] = root(b, near)
    linked = {f: f for f in fps}
    for a, b in map(tuple, found):
        linked[root(a, linked)] = root(b, linked)
    groups = lambda up: {frozenset(x for x in up if root(x, up) == r) for r in {root(x, up) for x in up}}
    assert groups(near) == groups(linked)


def test_ball_and_masks():
    assert simhash.BALL.size == np.unique(simhash.BALL).size == 2081 and simhash.MASKS.size == 70


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {-5: -9, -9: -9}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_first(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text, "x", 1), (3, text, "y", 2), (3, text, "y", 2), (9, "another text altogether here", "z", 3), (None, text, "n", 4), (11, None, "a", 5), (12, "", "b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.fp) for r in out.collect()), key=str) == sorted([(3, "y"), (9, "z"), (11, "a"), (None, "n")], key=str)
    assert simhash.keep_first(df.limit(0)).collect() == []
