"""Operators made of joins: licenses, URLs, chats; the queries with SQL; the pipeline."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import normal
from tests.llm.conftest import gathered
from tests.llm.test_secrets import scan
from tests.llm.test_similar import plain
from tidemark.llm import bpe, chat, contamination, licenses, quality, registry, secrets, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), rel.columns)


# licenses


def test_inheritance_from_the_nearest_folder(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", f"  {mit}\n", "x"), ("a/b/c.py", "code\n# " + apache, "x"), ("a/b/d.py", "code", "x"), ("a/lib/COPYING.txt", apache, "x"), ("a/lib/deep/er/e.py", "code", "x"),
        ("a/libx/f.py", None, "x"), (None, "", "x"), ("z.py", "the license plate of a car was copyright free", "x"), ("a/b/d.py", "code", "x"),
    ]
    df = spark.createDataFrame(rows, "path string, text string, license string")
    out = licenses.scan(df, licenses.templates(spark))
    got = sorted(((r.path, r.license, r.found_in) for r in out.collect()), key=str)
    assert got == sorted(
        [
            ("LICENSE", "MIT", "file"), ("a/b/c.py", "Apache-2.0", "header"), ("a/b/d.py", "MIT", "inherited"), ("a/b/d.py", "MIT", "inherited"), ("a/lib/COPYING.txt", "Apache-2.0", "file"),
            ("a/lib/deep/er/e.py", "Apache-2.0", "inherited"), ("a/libx/f.py", "MIT", "inherited"), (None, "MIT", "inherited"), ("z.py", "MIT", "inherited"),
        ],
        key=str,
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert licenses.scan(df.limit(0), licenses.templates(spark)).collect() == []


def test_query_finds_files_headers_and_heirs(spark):
    found = {r.found_in: r["count"] for r in registry.op2_license_scan(spark, "/root/testdata/sf0.01").groupBy("found_in").count().collect()}
    assert found["file"] == found["inherited"] > 10 and found["header"] > 10 and found[None] > 900


def test_very_long_files_and_clashing_columns(spark):
    long = "word " * 400_000 + "\n# Released under the MIT License.\n" + "line\n" * 200_000
    rows = [("a/x", long, 1, "s", "f", "u"), ("a/x", long, 1, "s", "f", "u"), ("a/LICENSE", long, 2, "s", "f", "u"), (None, None, 3, "s", "f", "u")]
    df = spark.createDataFrame(rows, "path string, text string, salt int, unit string, folder string, units string")
    out = licenses.scan(df, licenses.templates(spark))
    assert [c for c in out.columns if c in df.columns] == df.columns
    assert sorted((str(r.path), r.salt, r.unit, r.folder, r.units, r.license, r.found_in) for r in out.collect()) == [
        ("None", 3, "s", "f", "u", None, None), ("a/LICENSE", 2, "s", "f", "u", None, None), ("a/x", 1, "s", "f", "u", "MIT", "header"), ("a/x", 1, "s", "f", "u", "MIT", "header")
    ]


# URLs


def test_parts_and_rules(spark):
    rows = [
        ("http://a.EXAMPLE.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net", "example.net", "", None, None), ("http://x.net/", "x.net", "/", "net/", "block"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"), ("http://example.com/de/q", "example.com", "/de/q", "example.com/de/", "block"), ("ftp://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://h?q=http://net/", "h", "", None, None), ("http://É.net/a", "É.net", "/a", "net/", "block"), ("http://h\nx/\ny", "h\nx", "/\ny", None, None),
    ]
    df = spark.createDataFrame([(r[0], k, "old") for k, r in enumerate(rows)], "url string, k int, host string")
    u = F.col("url")
    out = df.select("k", urls.host(u).alias("h"), urls.path(u).alias("p"), urls.rule(urls.host(u), urls.path(u)).alias("r")).orderBy("k").collect()
    assert [(r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) for r in out] == [r[1:] for r in rows]
    judged = {r.k: r for r in urls.judged(df).collect()}
    assert len(judged) == len(rows) and judged[0].host == "a.example.net" and judged[7].verdict == "allow"
    assert urls.judged(df.limit(0)).collect() == []


def test_mined_rules_against_counting(spark):
    from itertools import combinations

    pages = [(f"http://{'pills' if k % 4 == 0 else 'shop'}.example.com/{'en' if k % 3 else 'fr'}/{k}", "block" if k % 4 == 0 and k % 3 else "allow") for k in range(240)]
    df = spark.createDataFrame(pages, "url string, verdict string")
    sets = [(frozenset(r.t), r.verdict) for r in df.select(urls.tokens(F.col("url")).alias("t"), "verdict").collect()]
    rules = urls.mine(df).collect()
    assert {tuple(r.antecedent) for r in rules if r.verdict == "block"} == {("h:pills", "p:en")}
    share = {v: sum(x == v for _, x in sets) / len(sets) for v in ("block", "allow")}
    candidates = {}
    for size in (1, 2, 3, 4):
        for items in {c for t, _ in sets for c in combinations(sorted(t), size)}:
            inside = [v for t, v in sets if t.issuperset(items)]
            for v in set(inside):
                n = inside.count(v)
                if n >= urls.MIN_COUNT and n / len(inside) >= urls.MIN_CONFIDENCE and n / len(inside) / share[v] >= urls.MIN_LIFT:
                    candidates[items, v] = n / len(inside)
    kept = {k for k, c in candidates.items() if not any(v == k[1] and set(p) < set(k[0]) and s >= c for (p, v), s in candidates.items())}
    assert {(tuple(r.antecedent), r.verdict) for r in rules if len(r.antecedent) <= 4} == kept
    fresh = spark.createDataFrame([("http://pills.example.org/en/x",), ("http://pills.example.org/fr/x",), ("http://shop.a/fr/",)], "url string")
    found = {r.url: r.verdict for r in urls.match(fresh, urls.mine(df)).collect()}
    assert found["http://pills.example.org/en/x"] == "block" and found.get("http://pills.example.org/fr/x") != "block"


def test_url_query_keeps_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = registry.op5_url_filter(spark, SF)
    assert out.count() == pages.count() and out.where("verdict NOT IN ('allow', 'block')").count() == 0
    assert out.where("rule = 'net/' AND verdict <> 'block' OR rule = 'org/fr/' AND verdict <> 'allow'").count() == 0


def test_one_url_with_most_of_the_rows(spark):
    """Its 40 tokens have 2**40 sets; as one URL it makes none of them frequent."""
    deep = "http://a.net/" + "/".join(f"seg{k}" for k in range(40))
    rows = [(k, deep) for k in range(500)] + [(1000 + k, f"http://x{k}.net/p") for k in range(30)] + [(2000 + k, f"http://x{k}.org/fr/p") for k in range(30)] + [(3000, "ftp://q/p"), (3001, None)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.count() == len(rows) and {r.verdict for r in out.where("rule = 'net/'").select("verdict").distinct().collect()} == {"block"}


def test_many_urls_with_one_deep_path(spark):
    """40 URLs with 40 common folders, which have 2**40 frequent sets, and a last segment of their own; long URLs."""
    deep = "/".join(f"seg{k}" for k in range(40))
    rows = [(f"http://a{k}.net/{deep}/{k}", "block") for k in range(40)] + [(f"http://b{k}.org/x/y/{k}", "allow") for k in range(40)] + [("http://z.org/" + "q" * 100_000, "allow")]
    rules = urls.mine(spark.createDataFrame(rows, "url string, verdict string")).collect()
    assert {(len(r.antecedent), r.verdict) for r in rules} == {(1, "block"), (1, "allow")} and max(len(r.alternatives[0]) for r in rules) == 41
    fresh = spark.createDataFrame([("http://new.com/seg7/other",), ("http://new.com/x",), ("http://new.com/none",)], "url string")
    rules = urls.mine(spark.createDataFrame(rows, "url string, verdict string"))
    assert {r.url[15:]: r.verdict for r in urls.match(fresh, rules).collect()} == {"seg7/other": "block", "x": "allow"}


# chats


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"content": "", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'Hi "there"'), (1, 1, "assistant", call(("b", "add", '{"x": 1, "y": "$a"}'), ("a", "add", '{"x": 2}'), ("c", "add", "no"), ("d", "none", "{}"))),
        (1, 2, "tool", answer("b", "B")), (1, 3, "tool", answer("a", "A")), (1, 4, "tool", answer("zz", "Z")), (1, 4, "tool", answer("zz", "Z")), (1, 5, "assistant", None),
        (2, 0, "assistant", call(("a", "add", '{"x": "$b", "q": 1}'), ("b", "add", '{"x": "$a"}'), ("e", "add", '{"x": "3"}'))), (3, 600, "user", "{not json"), (3, 1, "user", "x"), (None, None, None, "y"), (None, None, None, "z"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, id string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "string", False)], chat.SCHEMA_COLUMNS)
    got = chat.formatted(df, schemas).collect()
    out = {r.conv_id: r for r in got if r.conv_id is not None}
    r = out[1]
    assert (r.n_messages, r.n_calls, r.n_linked, r.n_invalid, r.n_orphans) == (7, 4, 2, 2, 2)
    said = json.loads(r.chat)
    assert [m["role"] for m in said] == ["user", "assistant", "tool", "tool", "assistant"] and said[2]["content"] == said[3]["content"] == "Z" and said[4]["content"] == ""
    made = said[1]["tool_calls"]
    assert [c["id"] for c in made] == ["a", "c", "d", "b"] and [c["problems"] for c in made] == [[], ["json"], ["tool"], []]
    assert [c.get("result") for c in made] == ["A", None, None, "B"]
    assert r.chat == json.dumps(said, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    cyclic = json.loads(out[2].chat)[0]["tool_calls"]
    assert [(c["id"], c["problems"]) for c in cyclic] == [("e", ["type:x"]), ("a", ["type:x", "unknown:q"]), ("b", ["type:x"])]
    assert set(out) == {1, 2, 3} and json.loads(out[3].chat) == [{"content": "x", "role": "user"}, {"content": "{not json", "role": "user"}]
    assert sorted(r.chat for r in got if r.conv_id is None) == ['[{"content":"y"}]', '[{"content":"z"}]']
    assert chat.formatted(df.limit(0)).collect() == []


def test_canonical_at_every_depth(spark):
    arguments, content = '{"b": {"z": [1, {"y": "é\\n", "x": null}], "a": 2.5}, "a": true}', '[{"k": 2, "j": {"b": 1, "a": 0}}]'
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": arguments}, {"id": "b", "name": "f", "arguments": json.loads(arguments)}, {"id": "c", "name": "f", "arguments": '{"a":1,"a":2}'}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": content})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": json.loads(content)})), (1, 3, "tool", json.dumps({"tool_call_id": "c", "content": "{plain"})),
    ]
    text = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().chat
    said = json.loads(text)
    assert text == json.dumps(said, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    a, b, c = said[0]["tool_calls"]
    assert a["arguments"] == b["arguments"] == json.loads(arguments) and a["result"] == b["result"] == json.loads(content)
    assert (c["arguments"], c["result"]) == ('{"a":1,"a":2}', "{plain")


def test_long_conversations_stay_whole(spark):
    rows = [(1, k, "user", f"m{k}") for k in range(600)] + [(1, 7, "user", f"n{k}") for k in range(700)] + [(2, 0, "user", "same")] * 5
    rows += [(3, 0, "user", "x" * 3_000_000), (None, 4, "user", "lone"), (None, 4, "user", "lone"), (4, None, "user", "late"), (4, -3, "user", "early")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    out = {r.conv_id: [m["content"] for m in json.loads(r.chat)] for r in got}
    assert len(got) == 5 and sum(r.n_messages for r in got) == len(rows)
    assert out[1] == [*(f"m{k}" for k in range(8)), *sorted(f"n{k}" for k in range(700)), *(f"m{k}" for k in range(8, 600))]
    assert out[2] == ["same"] * 5 and len(out[3][0]) == 3_000_000 and out[None] == ["lone"] * 2 and out[4] == ["late", "early"]


def test_chain_of_calls(spark):
    n = 1000
    made = [{"id": f"c{k}", "name": "f", "arguments": json.dumps({"x": f"$c{k + 1}"})} for k in range(n)]
    rows = [(9, 0, "assistant", json.dumps({"tool_calls": made})), (8, 0, "assistant", json.dumps({"tool_calls": made[::-1] + [{"id": "d", "name": "f", "arguments": '"$d $c0"'}]}))]
    out = {r.conv_id: [c["id"] for c in json.loads(r.chat)[0]["tool_calls"]] for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    chain = [f"c{k}" for k in range(n - 1, -1, -1)]
    assert out == {9: chain, 8: [*chain, "d"]}


def test_every_result_is_somewhere(spark):
    call = lambda *ids: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": "{}"} for i in ids]})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "assistant", call("c")), (1, 1, "tool", answer("c", "one")), (1, 2, "assistant", call("c")), (1, 3, "tool", answer("c", "two")), (1, 4, "tool", answer("c", "three")),
        (2, 0, "assistant", call("c")), (2, 2, "assistant", call("c")), (2, 3, "tool", answer("c", "of the second")),
        (3, 0, "tool", answer("c", "too early")), (3, 1, "assistant", call("c", "c")), (3, 2, "tool", answer("c", "x")), (3, 2, "tool", answer("c", "y")), (None, 0, "tool", answer("c", "nowhere")),
    ]
    out = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    seen = {k: [(m["content"], [c.get("result") for c in m.get("tool_calls") or []]) for m in json.loads(r.chat)] for k, r in out.items()}
    assert seen == {1: [("", ["one"]), ("", ["two"]), ("three", [])], 2: [("", [None]), ("", ["of the second"])], 3: [("too early", []), ("", ["x", "y"])], None: [("nowhere", [])]}
    assert {k: (r.n_calls, r.n_linked, r.n_orphans) for k, r in out.items()} == {1: (2, 2, 1), 2: (2, 1, 0), 3: (2, 2, 1), None: (0, 0, 1)}


def test_calls_without_schemas_are_not_judged(spark):
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": "{}"}]}))]
    r = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (r.n_calls, r.n_invalid) == (1, 0) and "problems" not in json.loads(r.chat)[0]["tool_calls"][0]


# pipeline


def test_pipeline_against_plain_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    docs = [d for d in docs if quality.measure(d[1])[-1]]
    stay = set(plain([d[:2] for d in docs]))
    docs = [d for d in docs if d[0] in stay]
    items = [contamination.shingles(contamination.lowered(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if not any(s and 5 * len(s & contamination.shingles(contamination.lowered(d[1]))) >= 4 * len(s) for s in items)]
    table, coder = secrets.train(secrets.labelled_samples(spark)), bpe.load(registry.vocabulary())
    want = []
    for doc_id, text, lang, source, _ in docs:
        out, at = "", 0
        for a, _, b in scan(text, table)[1]:
            out += text[at:a] + secrets.MASK if a >= at else ""
            at = max(at, b)
        ids = coder.encode(out + text[at:])
        want.append((doc_id, lang, source, len(ids), ids))
    assert gathered(corpus_pipeline.run(spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_take_nulls_and_empty_tables(spark, stage):
    text = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(1, text, None, None, None), (None, text + " x y z", "en", "s", 3), (2, None, None, None, None), (3, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage[1](spark, df, SF)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS and 1 in [r.doc_id for r in out.collect()]
    assert stage[1](spark, df.limit(0), SF).collect() == []


def test_encoding_takes_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Hello", None, None, None), (None, None, "en", "s", 3), (1, "Hello", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.encoding(spark, df, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and [r.n_tokens for r in out.collect()] == [1, 0, 1]
    assert corpus_pipeline.encoding(spark, df.limit(0), SF).collect() == []
