"""Operators that judge each document alone: quality, BPE, contamination."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import corpus, gathered
from tidemark.llm import bpe, contamination, quality, registry
from tidemark.llm.common import bounded

SF = "/root/testdata/sf0.001"
ODD = "abcdeABCDE'stredvemll 0123456789.,!?<>|éÉàçßΣσςİıǅ中文😀 \u0085\xa0\t\n\r\x1c\x1d\x0b\x0c\x00́İﬁÅ 　ᔰ\U000105e9\U00011893"


# quality


def test_measures():
    names = [*quality.FIELDS, "base_failed", "kept"]
    m = dict(zip(names, quality.measure("a é\x1c b\na é\x1c b\n\n \n# *")))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (8, 10, 2, 1, 6)
    assert m["base_failed"] and not m["kept"]
    assert quality.measure(None)[:5] == quality.measure("")[:5] == (0, 0, 0, 0, 0)


def test_verdicts():
    words = [f"w{i}" for i in range(100)]
    kept = lambda w: quality.measure(w)[-1]
    assert kept(" ".join(words)) and not kept(" ".join(words[:49]))
    assert not kept(" ".join(words[:20] * 5)) and not kept(" ".join(f"{w} %" for w in words))
    assert not kept("\n".join([" ".join(words[:25])] * 2 + [" ".join(words[25:60])]))


def test_labelled_good_documents_are_kept(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = quality.measured(docs.withColumnRenamed("quality", "good")).where(~F.col("quality.base_failed")).groupBy("good").agg(F.avg(F.col("quality.kept").cast("int")).alias("share")).collect()
    share = {r.good: r.share for r in rows}
    assert share[1] > 0.999 and share[0] < 0.75


def test_quality_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "q"), (2, None, "r")], "doc_id long, text string, quality string")
    assert [tuple(r)[2] for r in quality.keep_good(df).collect()] == ["q"]
    assert quality.keep_good(df.limit(0)).collect() == []


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.vocabulary())


def test_bpe_is_the_librarys(library):
    coder, rng = bpe.load(registry.vocabulary()), random.Random(5)
    texts = ["".join(rng.choice(ODD) if rng.random() < 0.8 else rng.choice(["<|endoftext|>", "<|startoftext|>", "'ll", "ing "]) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += ["a" * 5000, "ab1" * 3000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain():
    coder = bpe.load(registry.vocabulary())
    for word in ("thanedble", "éouauxre", "zzqxj"):
        s = [coder.symbol[b] for b in word.encode()]
        s[-1] += coder.end
        assert [x for f in coder.cut(s) for x in f] == s
    assert sum(len(list(coder.cut(list("qzjxqvkq")))) > 1 for _ in "a") == 1


def test_bpe_query(spark, library, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]

    def row(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert gathered(registry.op8_bpe(spark, SF)) == sorted((row(*r) for r in rows), key=repr)


def test_bpe_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.decoded(bpe.encoded(df, registry.vocabulary()), registry.vocabulary()).collect()}
    assert out[1].decoded == "hello</w> there</w>" and out[2].ids == [] and out[3].n_tokens == 0


def test_very_long_words(library):
    coder, rng = bpe.load(registry.vocabulary()), random.Random(8)
    long = ["a" * 1_000_000, "".join(rng.choice("aeth") for _ in range(200_000)), "ab" * 50_000 + "!" * 70_000, "the" * 21 + "t", "é" * 65]
    for t in long:
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.spoken(t)[0] == len(ids)
    assert not any(len(w) > bpe.LONG for w in [*coder.ids, *coder.said])


def test_bpe_of_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Hello", "x", "y"), (1, "Hello", "x", "y")], "doc_id long, text string, ids string, decoded string")
    out = bpe.decoded(bpe.encoded(df, registry.vocabulary()), registry.vocabulary()).collect()
    assert [r.decoded for r in out] == ["hello</w>"] * 2 and [r.n_tokens for r in out] == [1, 1]
    empty = bpe.encoded(df.limit(0), registry.vocabulary())
    assert empty.collect() == bpe.decoded(empty, registry.vocabulary()).collect() == df.limit(0).select(bpe.digest_column(df, registry.vocabulary())).collect() == []


# contamination


def test_short_items_in_long_documents(spark):
    rng = random.Random(1)
    item = [f"Item{i}" for i in range(24)]  # 20 shingles
    filler = [f"f{rng.randrange(10**6)}" for _ in range(5000)]
    near = item[:12] + ["other"] + item[13:]  # 5 shingles lost: 15 of 20
    rows = [(1, filler + item + filler), (2, filler), (3, near), (4, [w.upper() for w in item[:20]]), (5, item[:19]), (6, ["one", "two"]), (7, ["one", "two", "three", "four", "five"])]
    docs = spark.createDataFrame([(d, " \n".join(w)) for d, w in rows] + [(8, None), (9, ""), (1, " ".join(rows[0][1]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "ONE two"), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    want = [(1, 1, 20, 20), (1, 1, 20, 20), (4, 1, 16, 20), (6, 2, 1, 1)]
    assert gathered(contamination.contaminated(docs, items)) == want
    assert sorted(r.doc_id for r in contamination.clean(docs, items).collect()) == [2, 3, 5, 7, 8, 9]
    assert contamination.contaminated(docs, items.limit(0)).collect() == contamination.contaminated(docs.limit(0), items).collect() == []


def test_blocks_of_the_benchmark(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    whole = gathered(registry.op3_decontamination(spark, sf))
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 2000)
    assert gathered(registry.op3_decontamination(spark, sf)) == whole and len(whole) > 10
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in contamination.clean(docs, items).collect()} == {d for d, *_ in whole}


def test_long_texts_and_clashing_columns(spark):
    item = " ".join(f"i{k}" for k in range(30))
    long = "filler " * 300_000 + item + " filler" * 300_000
    docs = spark.createDataFrame([(1, long, "a", 5, "b"), (2, "x", None, 6, "c")], "doc_id long, text string, hits string, item_id int, text_hash string")
    items = spark.createDataFrame([(9, item), (8, item)], "item_id long, text string")
    assert gathered(contamination.contaminated(docs, items)) == [(1, 8, 26, 26), (1, 9, 26, 26)]
    assert [tuple(r) for r in contamination.clean(docs, items).collect()] == [(2, "x", None, 6, "c")]


def test_sketches_miss_nothing():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 70)
        words = [f"w{rng.randrange(1000)}" for _ in range(n)]
        index = contamination.Index([(1, " ".join(words))])
        other = list(words)
        for _ in range(rng.randrange(3)):
            other[rng.randrange(n)] = "x"
        other = " ".join([*(f"y{rng.randrange(99)}" for _ in range(rng.randrange(4))), *other])
        own, have = contamination.shingles(contamination.lowered(" ".join(words))), contamination.shingles(contamination.lowered(other))
        assert bool(index.search(other)) == (5 * len(own & have) >= 4 * len(own))


def test_rows_of_any_kind(spark):
    rows = corpus(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.measured(df).count() == contamination.clean(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == len(rows)


def test_batches_are_bounded_by_bytes(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1g")
        texts = bounded(spark.range(40).repartition(1).select(F.expr("repeat('x', 1000000)").alias("text")))
        sizes = texts.mapInPandas(lambda batches: (b.head(1).assign(n=len(b))[["n"]] for b in batches), "n long")
        assert sizes.agg(F.max("n"), F.sum("n")).first()[0] <= 17 and sizes.agg(F.sum("n")).first()[0] == 40
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        bounded(texts)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
