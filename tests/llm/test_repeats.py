import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import corpus, gathered
from tidemark.llm import automaton, repeats, shared, suffixes

L = 50


def removed(rows, unit):
    first = {}
    for d, t in rows:
        if d is not None:
            x = unit(t or "")
            for i in range(len(x) - L + 1):
                k = tuple(x[i : i + L])
                first[k] = min(first.get(k, d), d)
    for d, t in rows:
        x = unit(t or "")
        m = [False] * len(x)
        for i in range(len(x) - L + 1 if d is not None else 0):
            if first[tuple(x[i : i + L])] < d:
                m[i : i + L] = [True] * L
        yield d, x, m


def by_words(rows):
    out = [(d, len(x), sum(m), hashlib.sha256(b" ".join(w for w, gone in zip(x, m) if not gone)).hexdigest()) for d, x, m in removed(rows, lambda t: t.encode().split())]
    return sorted(out, key=repr)


def by_bytes(rows):
    out = []
    for d, x, m in removed(rows, str.encode):
        spans = sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1]))
        out.append((d, len(x), sum(m), spans, hashlib.sha256(bytes(c for c, gone in zip(x, m) if not gone)).hexdigest()))
    return sorted(out, key=repr)


def periodic(seed):
    """Pairs as a cycle and two runs of it in different phase in one document, and short alphabets."""
    rng, rows = random.Random(seed), []
    for k in range(40):
        period = rng.randint(1, 7)
        cycle = [f"c{k}x{i}" for i in range(period)]
        of = lambda n, at: [cycle[(at + i) % period] for i in range(n)]
        other = [f"u{k}x{i}" for i in range(120)]
        rows.append((rng.randint(0, 10**6), " ".join(of(rng.choice([50, 51, 80]), 0))))
        rows.append((rng.randint(0, 10**6), " ".join(of(79, 0) + other + of(79, rng.randint(0, period)) + other[:3] + of(rng.randint(40, 300), 1))))
        rows.append((rng.randint(0, 10**6), ("abcdefg"[:period] * 100)[: rng.randint(40, 200)] + f"{k:060d}" + ("abcdefg"[:period] * 100)[1 : rng.randint(40, 200)]))
    return rows


SIZES = [(512, 192, 8 << 20, 1 << 21), (2, 192, 20_000, 1 << 8), (1000, 7, 5_000, 1 << 8), (2, 3, 8 << 20, 1 << 21)]


@pytest.mark.parametrize(("hot", "run", "block", "bucket"), SIZES)
def test_against_brute_force(spark, monkeypatch, hot, run, block, bucket):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "RUN", run)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(shared, "BUCKET_KEYS", bucket)
    rows = corpus(hot + block) + periodic(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert gathered(automaton.digests(df)) == by_words(rows)
    assert gathered(suffixes.digests(df)) == by_bytes(rows)


def test_only_the_index_removes(spark, monkeypatch):
    def blind(passages, length):
        return [(np.zeros(p[3].size - length + 1, bool), False) for p in passages]

    monkeypatch.setattr(automaton, "resolve", blind)
    monkeypatch.setattr(suffixes, "resolve", blind)
    df = spark.createDataFrame(corpus(3) + periodic(3), "doc_id long, text string")
    assert {r.n_removed for op in (automaton, suffixes) for r in op.digests(df).collect()} == {0}


def test_shards_are_bounded(spark, monkeypatch, tmp_path):
    """One passage with other surroundings in each of very many texts, and one endless cycle."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"a{k}x{i}" for i in range(70)) + " " + passage + " " + " ".join(f"b{k}x{i}" for i in range(70))) for k in range(1500)]
    rows += [(5000, "x y z " * 30_000), (5001, "y z x " * 40)]
    most = tmp_path / "most"

    def counted(passages, length, of=automaton.resolve):
        with most.open("a") as f:
            f.write(f"{sum(p[3].size for p in passages)}\n")
        return of(passages, length)

    monkeypatch.setattr(automaton, "resolve", counted)
    got = {r.doc_id: r.n_removed for r in automaton.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0} | {k: 60 for k in range(1, 1500)} | {5000: 0, 5001: 120}
    assert max(map(int, most.read_text().split())) <= repeats.SHARD + repeats.HOT * (repeats.RUN + L)


def test_on_the_tables(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert gathered(automaton.digests(documents)) == by_words(rows)
    assert gathered(suffixes.digests(documents)) == by_bytes(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, block long, starts string, span_doc int")
    assert automaton.digests(df).collect() == suffixes.digests(df).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, text + " x", 9, "s", 4), (1, text, 8, "t", 5), (3, None, 7, "u", 6)], df.schema)
    out = {r.doc_id: r for r in automaton.deduplicated(df).collect()}
    assert out[2].text == "x" and out[1].text == text and out[3].text is None and (out[2].block, out[2].starts, out[2].span_doc) == (9, "s", 4)
    out = {r.doc_id: r.text for r in suffixes.deduplicated(df).collect()}
    assert out == {1: text, 2: " x", 3: None}


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, "z " + long), (3, "aaaa" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in automaton.digests(df).collect()} == {1: 0, 2: 60_000, 3: 0}
    assert {r.doc_id: r.n_removed for r in suffixes.digests(df).collect()} == {1: 0, 2: len(long), 3: 0}


strings = st.lists(st.text("ab", min_size=0, max_size=25), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(strings, st.integers(1, 6))
def test_automaton_gives_the_first_document(texts, n):
    a = automaton.SuffixAutomaton()
    docs = [7 * (k * 5 % 6) for k in range(len(texts))]
    for d, t in zip(docs, texts):
        a.add(list(map(ord, t)), d)
    a.finish()
    for query in [*texts, "abba", "aab"]:
        want = [min((d for d, t in zip(docs, texts) if query[i : i + n] in t), default=1 << 63) for i in range(len(query) - n + 1)]
        assert a.stream(list(map(ord, query)), n) == want


@settings(max_examples=200, deadline=None)
@given(strings, st.integers(1, 5))
def test_maximal_repeats_have_all_occurrences(texts, least):
    got = set()
    for n, string, place in suffixes.maximal_repeats([np.array(list(map(ord, t)), np.int64) for t in texts], least):
        got.add((texts[string[0]][place[0] : place[0] + n], tuple(sorted(zip(string.tolist(), place.tolist())))))
    want = set()
    for s in {t[i:j] for t in texts for i in range(len(t)) for j in range(i + least, len(t) + 1)}:
        at = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - len(s) + 1) if t.startswith(s, i)]
        left = {texts[k][i - 1] if i else (k,) for k, i in at}
        right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k,) for k, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.add((s, tuple(at)))
    assert got == want


def test_gram_hashes_are_of_content_only():
    x = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint64)
    for n in (1, 2, 3, 16, 50, 63):
        h = repeats.gram_hashes(suffixes._OF_BYTE[x], n)
        seen = {}
        assert h.size == x.size - n + 1
        for i in range(h.size):
            assert seen.setdefault(tuple(x[i : i + n]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
