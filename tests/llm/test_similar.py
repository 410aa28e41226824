import random

import pytest

import corpus_pipeline
from tests.llm.conftest import SF, corpus, gathered
from tidemark.llm import similar, simhash
from tidemark.llm.contamination import lowered, shingles


def plain(rows):
    """The ids that stay: the least of each group, all pairs compared."""
    sets = [shingles(lowered(t)) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    return sorted(least.values())


def near_copies(seed):
    """Texts with 1 to 8 edits of 100 words, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(6)]
    rows = []
    for d in rng.sample(range(1000), 90):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sizes", [(2 << 20, 8 << 20), (3000, 2000)])
def test_stage_against_all_pairs(spark, monkeypatch, seed, sizes):
    monkeypatch.setattr(similar, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(similar, "CHUNK_BYTES", sizes[1])
    rows = near_copies(seed) + [(d + 10**5, t) for d, t in corpus(seed) if d is not None and d < 5000]
    rows = list(dict(rows).items())
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == plain(rows)


def test_wide_pair_goes_and_unlike_pair_stays(spark):
    words = [f"w{i}" for i in range(200)]
    wide = [*words[:50], *(f"x{i}" for i in range(18)), *words[68:]]  # 174 of 218 shingles: 0.798
    alike = [*words[:50], *(f"x{i}" for i in range(17)), *words[67:]]  # 175 of 217: 0.806
    bits = lambda a, b: (simhash.fingerprint(" ".join(a)) ^ simhash.fingerprint(" ".join(b))).bit_count()
    assert bits(words, alike) > simhash.RADIUS
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(alike))], "doc_id long, text string")
    assert gathered(simhash.keep_first(df).select("doc_id")) == [(1,)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(wide))], "doc_id long, text string")
    assert gathered(simhash.keep_first(df).select("doc_id")) == [(1,), (2,)]


def test_on_the_tables(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in simhash.keep_first(documents).collect()) == plain(rows)


def test_unlike_texts_of_one_id_both_stay(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, one), (1, two), (1, two), (2, two), (3, one.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert gathered(simhash.keep_first(df)) == [(1, one), (1, two)]
    near = two.replace("b40 ", "other ")
    df = spark.createDataFrame([(1, near), (1, two), (0, one)], "doc_id long, text string")
    assert len(simhash.keep_first(df).where("doc_id = 1").collect()) == 1


def test_near_copies_in_many_chunks_are_one_before_texts_go_across(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_TEXTS", 30)
    rng, base, rows = random.Random(6), [f"w{i}" for i in range(100)], []
    for d in range(400):
        w = list(base)
        w[rng.randrange(100)] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join([*base[:30], *(f"y{d}_{i}" for i in range(70))])) for d in range(5)]  # share passages, unlike
    seen, across = [], similar._across

    def watched(members, keys, roots):
        seen.append((members.count(), len({r.root for r in roots.collect()})))
        return across(members, keys, roots)

    monkeypatch.setattr(similar, "_across", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert gathered(simhash.keep_first(df).select("doc_id")) == [(0,), *((1000 + d,) for d in range(5))]
    assert len(seen) == 1 and seen[0][0] >= 400 and seen[0][1] == 1


def test_pairs_within_the_radius_come_from_the_fingerprints(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for d in range(40):
        w = [f"w{d}_{i}" for i in range(400)]
        rows.append((2 * d, " ".join(w)))
        w[rng.randrange(400)] = "x"
        rows.append((2 * d + 1, " ".join(w)))
    bits = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    near = [2 * d + 1 for d in range(40) if bits[d] <= simhash.RADIUS]
    assert 5 < len(near)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert gathered(simhash.keep_first(df).select("doc_id")) == [(2 * d,) for d in sorted(range(40), key=lambda d: repr((2 * d,)))]
    # without them just these pairs stay: nothing else looks for them, and everything else is found
    monkeypatch.setattr(simhash, "candidates", lambda texts: texts.select("node", texts.node.alias("group")).limit(0))
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted([*range(0, 80, 2), *near])


def test_large_groups_of_one_fingerprint_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_TEXTS", 4)
    same = " ".join(["a"] * 60)  # most shingles are alike: one fingerprint, though the texts differ
    tails = [[f"t{d}_{i}" for i in range(30)] for d in range(12)]
    rows = [(d, f"{same} {' '.join(t)}") for d, t in enumerate(tails)]
    rows += [(100 + d, f"{same} {' '.join([*t[:-1], 'end'])}") for d, t in enumerate(tails)]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == plain(rows) == list(range(12))
