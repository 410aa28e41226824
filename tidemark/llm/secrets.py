"""Secret scans in DataFrame functions only: patterns, and two Markov models of characters.

Patterns give the base spans. The method adds more: runs of 20 characters or more of base64, URL-safe base64
or hexadecimal text with a digit are scored by two character Markov models of order one, of random strings
and of ordinary identifiers. A run is a secret if the log-likelihood ratio for each step is over
``THRESHOLD``. The models are fitted on labelled samples; their table has one number for each pair of
characters of ``ALPHABET`` whatever the size of the samples, and goes into the plan as a literal.

Positions are code points, the end exclusive: what a pattern leaves between its matches and the matches
themselves are measured in turn. Null texts count as empty. Each row is scanned alone and whole, so hot
sources and repeated rows need nothing special, and nothing is shuffled. Running sums over a text's matches
are taken in chunks of ``CHUNK``, so that long texts full of secrets, and long secrets, take time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

# Fixed patterns: kind, pattern, group whose length counts, least length, a sign without which there is no match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Thousandths of a nat for each step, by which the random model must be likelier.
THRESHOLD = 150
MASK = "[SECRET]"
#: Matches of a text that are gone through one by one, with an array that grows.
CHUNK = 256

_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Words of which the ordinary identifiers of the samples are made.
_NAMES = (
    "get set user name file path index value count total list item data type node tree table column row key map cache buffer stream reader writer "
    "parser token config option default request response server client session handler event queue task worker thread lock state update delete create "
    "insert select filter merge sort hash block page image label model train test batch size length offset start end time date version build release"
).split()


# models


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``label, text``: ``n`` random strings (1) and ``n`` identifiers (0), made by a rule."""
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, b64).otherwise(F.translate(b64, "+/=", "-_"))
    words = F.array(*map(F.lit, _NAMES))

    def pick(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(_NAMES))) + 1).cast("int"))

    parts = F.array(*(pick(k) for k in range(4)))
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(2000)).cast("string")
    snake, kebab = F.concat(F.array_join(parts, "_"), F.lit("_"), number), F.concat(F.array_join(parts, "-"), F.lit("-"), number)
    camel = F.concat(F.array_join(F.transform(parts, F.initcap), ""), number)
    path = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"), number)
    ordinary = F.element_at(F.array(snake, kebab, camel, path, F.upper(snake)), (F.col("id") % 5 + 1).cast("int"))
    return rows.select(F.lit(1).alias("label"), random.alias("text")).unionByName(rows.select(F.lit(0).alias("label"), ordinary.alias("text")))


def train(samples: DataFrame) -> list[int]:
    """For each pair of characters, 1000 times the log of (random over ordinary) for the second after the first.

    Counts are made by Spark and start at a half, so unseen pairs count too. What comes to the driver is
    bounded by the alphabet.
    """
    size = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))))
    pairs = samples.where(F.length("text") > 1).select("label", "text", at.alias("i")).selectExpr("label", f"instr('{ALPHABET}', substr(text, i, 1)) AS a", f"instr('{ALPHABET}', substr(text, i + 1, 1)) AS b")
    counts = pairs.where("a > 0 AND b > 0").groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()
    import math

    seen = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for r in counts:
        seen[r.label][r.a - 1][r.b - 1] += r.n
    share = [[[n / sum(row) for n in row] for row in model] for model in seen]
    return [round(1000 * math.log(share[1][a][b] / share[0][a][b])) for a in range(size) for b in range(size)]


def ratio(token: Column, table: list[int]) -> Column:
    """Thousandths of a nat for each step, rounded down."""
    size = len(ALPHABET)
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    def total(places: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            return acc + F.get(weights, (F.get(places, i - 1) - 1) * size + F.get(places, i) - 1)

        return F.floor(F.aggregate(F.sequence(F.lit(1), F.size(places) - 1), F.lit(0).cast("long"), add) / (F.size(places) - 1))

    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return _with(F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c)), total)


# arrays


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(items: Column, carry: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """What ``made(chunk, before)`` gives for the chunks of an array, one after the other.

    ``before`` is an int, 0 for the first chunk and ``carry(before, chunk)`` for the next.
    """

    def over(chunks: Column) -> Column:
        def step(acc: Column, chunk: Column) -> Column:
            return F.concat(acc, F.array(carry(F.element_at(acc, -1), chunk)))

        befores = F.aggregate(chunks, F.array(F.lit(0)), step)
        return F.flatten(F.zip_with(chunks, F.slice(befores, 1, F.size(chunks)), made))

    def cut(whole: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), lambda k: k * CHUNK < F.size(whole))
        return F.transform(first, lambda k: F.slice(whole, k * CHUNK + 1, F.lit(CHUNK)))

    return _with(_with(items, cut), over)


# spans


def _found(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans of a pattern's matches that ``keep(match, of group 2)`` accepts."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if rank == 0 else matches
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), inner.alias("inner")), lambda x: x["match"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(keep(x["match"], x["inner"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def spans(chunk: Column, before: Column) -> Column:
        return F.aggregate(chunk, F.struct(before.alias("pos"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"])

    def passed(before: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, before, lambda acc, x: acc + F.length(x["gap"]) + F.length(x["match"]))

    return _running(zipped, passed, spans)


def _if(sign: Column, spans: Column) -> Column:
    return F.when(sign, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind. Cheap tests first: most texts have no sign of a match."""
    assign = _if(text.contains("=") | text.contains(":"), _found(text, ASSIGN, 0, lambda m, g: F.length(g) >= 8))
    access = _if(text.contains("AKIA"), _found(text, ACCESS, 1, lambda m, g: F.lit(True)))
    hexes = _if(text.rlike(HEX), _found(text, HEX, 2, lambda m, g: F.lit(True)))
    return F.array_sort(F.concat(assign, access, hexes))


def model_spans(text: Column, table: list[int]) -> Column:
    likely = lambda m, _: m.rlike("[0-9]") & (ratio(m, table) > THRESHOLD)
    return _if(text.rlike(CANDIDATE), _found(text, CANDIDATE, 3, likely))


def written_out(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def scanned(df: DataFrame, table: list[int], text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """The frame with two arrays of spans: the patterns', and those with the models' outside of them."""
    body = F.coalesce(F.col(text), F.lit(""))
    more = fresh(df, "model_spans")
    df = df.withColumn(base, base_spans(body)).withColumn(more, model_spans(body, table))

    def reach(before: Column, span: Column) -> Column:
        """The furthest end of the patterns' spans so far."""
        return F.when(span["rank"] < KINDS.index("random"), F.greatest(before, span["end"])).otherwise(before)

    def step(acc: Column, span: Column) -> Column:
        inside = (span["rank"] == KINDS.index("random")) & (span["end"] <= acc["pos"])
        return F.struct(reach(acc["pos"], span).alias("pos"), F.when(inside, acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def outside(chunk: Column, before: Column) -> Column:
        return F.aggregate(chunk, F.struct(before.alias("pos"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"])

    both = _running(F.array_sort(F.concat(F.col(base), F.col(more))), lambda before, chunk: F.aggregate(chunk, before, reach), outside)
    return df.withColumn(spans, F.when(F.size(more) == 0, F.col(base)).otherwise(both)).drop(more)


def redacted(df: DataFrame, table: list[int], text: str = "text") -> DataFrame:
    """The frame with MASK in place of every span; spans that overlap become one. Null texts stay null."""
    base, spans = fresh(df, "base_spans"), fresh(df, "spans")
    body = F.col(text)

    def reach(before: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, before, lambda acc, x: F.greatest(acc, x["end"]))

    def pieces(chunk: Column, before: Column) -> Column:
        def of(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                between = F.substring(part, acc["pos"] - before + 1, x["start"] - acc["pos"])
                out = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], F.array(F.concat(between, F.lit(MASK))))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), out.alias("out"))

            return F.aggregate(chunk, F.struct(before.alias("pos"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

        return _with(F.substring(body, before + 1, reach(before, chunk) - before), of)

    rest = F.substring(body, reach(F.lit(0), F.col(spans)) + 1, F.length(body))
    masked = F.concat(F.array_join(_running(F.col(spans), reach, pieces), ""), rest)
    return scanned(df, table, text, base, spans).withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(body)).drop(base, spans)
