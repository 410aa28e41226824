"""URL filters: fixed rules first, association rules for the rest.

A URL's tokens are its host's labels, its path's segments and its query's keys. Tokens that stand in just the same
labelled URLs, such as the folders of a deep path, are one *class* and one item, so many such tokens make no more
sets than one. FP-growth mines frequent sets of classes and verdicts from labelled URLs; rules whose consequent is a
verdict are kept when their confidence, support and lift are high enough and no shorter rule of the same verdict is at
least as sure. They are matched by an inverted index: a rule stands under the tokens of its rarest class, URLs meet it
by a join on these, and then need a token of each other class. That is what rules of single tokens would give: sets
with two tokens of one class are no surer than with one. Sets of tokens that stand in almost the same URLs are mined
one by one, and their number doubles with each such token.

A verdict hangs on the URL alone, so rules are mined from distinct labelled URLs, and distinct URLs are judged
and joined back; a URL with a third of all rows costs one judgement and weighs as one. URLs without ``://`` and null
ones have an empty host and path and no tokens; long URLs are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, written

# Fixed rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Share of the labelled URLs that a rule's tokens and verdict must have together; the verdict's share where the tokens are.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.8, 1.2
#: Labelled URLs that a rule's tokens and verdict must have together, however few there are.
MIN_COUNT = 20
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "verdict="


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, nulls if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """``h:`` labels of the host, ``p:`` segments of the path, ``q:`` keys of the query; distinct."""
    hosts = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(F.lower(path(url)), r"[/.]"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    all_ = F.concat(hosts, segments, F.coalesce(keys, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.coalesce(all_, F.array().cast("array<string>")), lambda x: F.length(x) > 2))


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """``token, class, freq, alternatives`` of the tokens in ``least`` rows or more; those in the same rows have one class.

    Rows of a token are told by their number and two sums of hashes of 64 bits each.
    """
    each = rows.select(F.explode(tokens(F.col("url"))).alias("token"), *(F.xxhash64("url", "verdict", F.lit(k)).alias(f"h{k}") for k in (0, 1)))
    seen = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")).where(F.col("freq") >= F.lit(least))
    groups = seen.groupBy("freq", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("alternatives"))
    return groups.select(F.explode("alternatives").alias("token"), F.col("alternatives")[0].alias("class"), "freq", "alternatives")


def mine(labelled: DataFrame) -> DataFrame:
    """``rule_id, antecedent, alternatives, verdict, confidence, support, index_token`` from ``url, verdict``.

    An antecedent has the first token of each class, ``alternatives`` has all. A rule has a row for each token that it
    stands under. Equal rows count once: one URL with a third of all labels would make every set of its tokens frequent.
    """
    rows = written(labelled.where(F.col("url").isNotNull()).select("url", "verdict").distinct(), "labelled")
    total = rows.count()
    support = min(1.0, max(MIN_SUPPORT, MIN_COUNT / max(total, 1)))
    classes = written(_classes(rows, support * total), "classes")
    held = rows.withColumn("token", F.explode_outer(tokens(F.col("url")))).join(classes.select("token", "class"), "token", "left")
    items = held.groupBy("url", "verdict").agg(F.collect_set("class").alias("items")).select(F.concat("items", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE, numPartitions=labelled.sparkSession.sparkContext.defaultParallelism).fit(items)
    is_label = lambda x: x.startswith(_LABEL)
    rules = model.associationRules.where(is_label(F.element_at("consequent", 1)) & ~F.exists("antecedent", is_label) & (F.col("lift") >= MIN_LIFT))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 99).alias("verdict"), "confidence", "support")
    rules = rules.withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    own = classes.where(F.col("token") == F.col("class")).select("class", "freq", F.col("alternatives").alias("of_class"))
    parts = rules.withColumn("class", F.explode("antecedent")).join(own, "class")
    rarest = F.min_by("class", F.struct("freq", "class")).alias("rarest")
    full = parts.groupBy("rule_id").agg(rarest, F.min_by("of_class", F.struct("freq", "class")).alias("under"), F.collect_list("of_class").alias("alternatives"))
    rules = written(rules.join(full, "rule_id"), "rules")
    # a longer rule that is no surer than a part of it says nothing more; parts are looked up under their rarest class
    part = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("of"), F.col("confidence").alias("sure"), F.col("rarest").alias("class"))
    dull = (
        rules.withColumn("class", F.explode("antecedent"))
        .join(part, "class")
        .where((F.size("part") < F.size("antecedent")) & (F.col("of") == F.col("verdict")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("rule_id")
        .distinct()
    )
    kept = rules.join(dull, "rule_id", "left_anti").withColumn("index_token", F.explode("under"))
    return written(kept.drop("under", "rarest"), "rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, verdict, confidence, antecedent`` of the surest, then longest rule that fits; URLs without one are left out."""
    held = urls.select("url", tokens(F.col("url")).alias("held"))
    met = held.withColumn("index_token", F.explode("held")).join(rules, "index_token").where(F.forall("alternatives", lambda x: F.arrays_overlap(x, F.col("held"))))
    best = F.max_by(F.struct("verdict", "confidence", "antecedent"), F.struct("confidence", F.size("antecedent"), "verdict", "rule_id"))
    return met.groupBy("url").agg(best.alias("best")).select("url", "best.*")


def judged(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The frame with ``host, path, rule, verdict``: the fixed rule's verdict, else a mined rule's, else ``default``.

    Columns of these names are replaced, unless one of them is the URL's. Labels come from ``labelled``
    (``url, verdict``), or from the fixed rules on the URLs that they fit.
    """
    own, at, found = fresh(pages, "fixed_rule"), fresh(pages, "mined_url"), fresh(pages, "mined_verdict")
    address = F.col(url)
    fixed = pages.withColumn(own, rule(host(address), path(address)))
    if labelled is None:
        labelled = fixed.where(F.col(own).isNotNull()).select(address.alias("url"), F.col(own)["verdict"].alias("verdict"))
    distinct = fixed.where(F.col(own).isNull() & address.isNotNull()).select(address.alias("url")).distinct()
    if labelled.isEmpty():
        mined = distinct.select(F.col("url").alias(at), F.lit(None).cast("string").alias(found)).limit(0)
    else:
        mined = match(distinct, mine(labelled)).select(F.col("url").alias(at), F.col("verdict").alias(found))
    out = fixed.join(mined, address == F.col(at), "left")
    columns = {"host": host(address), "path": path(address), "rule": F.col(own)["rule"], "verdict": F.coalesce(F.col(own)["verdict"], F.col(found), F.lit(default))}
    return out.withColumns(columns).drop(own, at, found)
