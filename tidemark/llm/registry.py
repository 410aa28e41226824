"""The operators' queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton, bpe, chat, contamination, licenses, quality, secrets, simhash, suffixes, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digests(table(spark, sf_dir, "documents"))


def unpacked(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: the documents as files, as the table has no paths. A document has a folder in those of its source and language.

    Where a document's last line speaks of a licence, and the number of its characters is even, that line is the folder's
    ``LICENSE`` and the rest is ``src/text``; every other document is ``src/text`` as a whole.
    """
    last = F.substring_index("text", "\n", -1)
    apart = F.coalesce(last.rlike(licenses.CUE) & (F.length("text") % 2 == 0), F.lit(False))
    rest = F.substring(F.col("text"), F.lit(1), F.greatest(F.length("text") - F.length(last) - 1, F.lit(0)))
    name = lambda x: F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"), F.lit(x))
    one = F.struct(name("src/text").alias("path"), F.when(apart, rest).otherwise(F.col("text")).alias("text"))
    two = F.struct(name("LICENSE").alias("path"), last.alias("text"))
    return docs.select("doc_id", F.explode(F.when(apart, F.array(one, two)).otherwise(F.array(one))).alias("f")).select("doc_id", "f.path", "f.text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(unpacked(table(spark, sf_dir, "documents")), licenses.templates(spark))
    return found.select("doc_id", "path", "license", "similarity", "found_in")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.measured(docs, into="quality").select("doc_id", *(f"quality.{c}" for c in shown))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digest_column(docs, vocabulary()).alias("d")).select("doc_id", "d.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.train(secrets.labelled_samples(spark)))
    return found.select("doc_id", *(secrets.count_of("base_spans", k).alias(f"n_{k}") for k in secrets.KINDS[:3]), F.sha2(secrets.written_out(F.col("base_spans")), 256).alias("base_sha256"), secrets.written_out(F.col("spans")).alias("spans"))


def tool_talk(conversations: DataFrame) -> DataFrame:
    """The conversations with tool calls and results made from them, as the table has none.

    Each assistant's message of ``n`` characters in turn ``t`` becomes one with two calls: ``b<t>``, which needs
    ``a<t>`` and stands before it. ``chars`` is a string where ``n % 5 = 0`` and absent where ``n % 7 = 0``; ``b<t>`` has
    no result where ``n % 3 = 0``; where ``n % 4 = 0`` there is a result that nothing asked for.
    """
    n, t = F.length("text"), F.col("turn").cast("string")
    spoken = conversations.where((F.col("role") == "assistant") & F.col("text").isNotNull() & F.col("turn").isNotNull())
    chars = F.when(n % 7 == 0, F.lit("")).when(n % 5 == 0, F.concat(F.lit('"chars":"'), n.cast("string"), F.lit('",'))).otherwise(F.concat(F.lit('"chars":'), n.cast("string"), F.lit(",")))
    measure = F.struct(F.concat(F.lit("b"), t).alias("id"), F.lit("measure").alias("name"), F.concat(F.lit('{"of": "$a'), t, F.lit('", '), chars, F.lit('"by": {"z": 1, "y": [2]}}')).alias("arguments"))
    fetch = F.struct(F.concat(F.lit("a"), t).alias("id"), F.lit("fetch").alias("name"), F.concat(F.lit('{"turn": '), t, F.lit("}")).alias("arguments"))
    asked = spoken.select("conv_id", "turn", "role", F.to_json(F.struct(F.col("text").alias("content"), F.array(measure, fetch).alias("tool_calls"))).alias("text"))

    def answer(prefix: str, content: Column) -> Column:
        return F.to_json(F.struct(F.concat(F.lit(prefix), t).alias("tool_call_id"), content.alias("content")))

    answers = F.array(
        answer("a", F.substring("text", 1, 8)),
        F.when(n % 3 != 0, answer("b", F.concat(F.lit('{"n": '), n.cast("string"), F.lit(', "m": '), t, F.lit("}")))),
        F.when(n % 4 == 0, answer("x", F.lit("nobody asked"))),
    )
    given = spoken.select("conv_id", "turn", F.lit("tool").alias("role"), F.explode(F.filter(answers, lambda x: x.isNotNull())).alias("text"))
    rest = conversations.where(~F.coalesce((F.col("role") == "assistant") & F.col("text").isNotNull() & F.col("turn").isNotNull(), F.lit(False)))
    return rest.select("conv_id", "turn", "role", "text").unionByName(asked).unionByName(given)


#: Tools of the calls that ``tool_talk`` makes.
TOOLS = (("fetch", "turn", "integer", True), ("measure", "of", "string", True), ("measure", "chars", "integer", True), ("measure", "by", "object", False))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(tool_talk(table(spark, sf_dir, "conversations")), spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_license_scan, op3_decontamination, op4_suffix_array_dedup, op5_url_filter, op6_simhash, op7_quality_rules, op8_bpe, op9_secret_scan, op10_chat_format)
    return {f.__name__: f for f in own}


# SQL


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_sql() -> str:
    share = ", ".join(f"max(chars) FILTER (n = {n}) AS c{n}" for n in quality.MAX_SHARE)
    bad = " OR ".join(f"100 * coalesce(c{n}, 0) > {limit} * word_chars" for n, limit in quality.MAX_SHARE.items())
    lengths = ", ".join(f"({n})" for n in (3, *quality.MAX_SHARE))
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, text, {_WORDS.format("text")} AS ws FROM docs),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS g
  FROM words, (VALUES {lengths}) t(n) WHERE len(ws) >= n),
dup AS (SELECT rid, n, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, n, g) > 1),
covered AS (SELECT DISTINCT rid, n, i + k AS i FROM dup, range(0, 10) r(k) WHERE k < n),
cover AS (SELECT rid, n, count(*) AS n_words, sum(length(word)) AS chars FROM covered JOIN w USING (rid, i) GROUP BY 1, 2),
shares AS (SELECT rid, max(n_words) FILTER (n = 3) AS repeated, {share} FROM cover GROUP BY 1),
split AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
same AS (SELECT rid, line, count(*) - 1 AS again FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
lines AS (SELECT rid, sum(again) AS n_dup_lines, sum(again * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM same GROUP BY 1),
base AS (SELECT rid, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM words),
full_ AS (SELECT *, coalesce(repeated, 0) AS n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * coalesce(repeated, 0) > {quality.MAX_REPEATED} * n_words AS base_failed
  FROM base LEFT JOIN shares USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR {bad} OR 100 * coalesce(line_chars, 0) > {quality.MAX_LINE_SHARE} * word_chars OR 100 * n_symbols > {quality.MAX_SYMBOLS} * n_words) AS kept FROM full_"""


def _contamination_sql() -> str:
    n = contamination.WORDS

    def shingles(source: str, key: str) -> str:
        ws = _WORDS.format(_LOWER.format("text"))
        return f"""SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest(list_transform(range(1, greatest(len(ws) - {n} + 1, least(len(ws), 1)) + 1), lambda i: array_to_string(ws[i : i + {n - 1}], ' '))) AS s
  FROM (SELECT {key}, {ws} AS ws FROM {source} WHERE text IS NOT NULL))"""

    return f"""WITH items AS ({shingles("benchmark", "item_id")}), docs AS ({shingles("documents", "doc_id")}), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n_item) AS INTEGER) AS n_item FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
GROUP BY 1, 2 HAVING {contamination.DENOMINATOR} * count(*) >= {contamination.NUMERATOR} * any_value(n_item)"""


def _license_sql() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
    terms = f"regexp_extract_all({_LOWER.format('unit')}, '[a-z0-9]+([.-][a-z0-9]+)*')"

    def weights(source: str, key: str) -> str:
        return f"""SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM
  (SELECT {key}, term, tf * coalesce(idf, (SELECT ln(total + 1) + 1 FROM total)) AS w FROM (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({terms}) AS term FROM {source}) GROUP BY 1, 2) LEFT JOIN idf USING (term))"""

    return f"""WITH templates(template, license, unit) AS (VALUES {rows}),
parts AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS folder, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), -1) AS last FROM documents),
apart AS (SELECT *, regexp_matches(last, '{licenses.CUE}') AND length(text) % 2 = 0 AS apart FROM parts),
files AS (SELECT doc_id, folder, folder || '/src/text' AS path, CASE WHEN apart THEN substr(text, 1, greatest(length(text) - length(last) - 1, 0)) ELSE text END AS text, 'header' AS kind FROM apart
  UNION ALL SELECT doc_id, folder, folder || '/LICENSE', last, 'file' FROM apart WHERE apart),
lines AS (SELECT DISTINCT doc_id, folder, path, kind, unit FROM (SELECT doc_id, folder, path, kind, unnest(CASE WHEN kind = 'file' THEN [text] ELSE string_split(text, chr(10)) END) AS unit FROM files) WHERE kind = 'file' OR regexp_matches(unit, '{licenses.CUE}')),
units AS (SELECT unit, count(*) AS n FROM lines GROUP BY 1),
total AS (SELECT sum(n) AS total FROM units),
df AS (SELECT term, sum(n) AS df FROM (SELECT DISTINCT unit, n, unnest({terms}) AS term FROM units) GROUP BY 1),
idf AS (SELECT term, ln((total + 1) / (df + 1)) + 1 AS idf FROM df, total),
mine AS ({weights("units", "unit")}), theirs AS ({weights("templates", "template")}),
cosine AS (SELECT m.unit, template, CAST(round(sum(m.w * t.w) * 1000) AS BIGINT) AS similarity FROM mine m JOIN theirs t USING (term) GROUP BY 1, 2),
best AS (SELECT folder, path, kind, license, similarity FROM lines JOIN cosine USING (unit) JOIN templates USING (template) WHERE similarity >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, license) = 1),
above AS (SELECT folder, license, similarity FROM best WHERE kind = 'file')
SELECT doc_id, f.path, coalesce(b.license, a.license) AS license, coalesce(b.similarity, a.similarity) AS similarity,
  CASE WHEN b.license IS NOT NULL THEN f.kind WHEN a.license IS NOT NULL THEN 'inherited' END AS found_in FROM files f LEFT JOIN best b ON f.path = b.path LEFT JOIN above a ON f.folder = a.folder"""


def _chat_sql() -> str:
    # ``b<t>`` needs ``a<t>``, so ``a<t>`` is first; keys are in order at every depth.
    text = "CAST(to_json({}) AS VARCHAR)"
    return f'''WITH m AS (SELECT conv_id, turn, role, text, length(text) AS n, role IS NOT DISTINCT FROM 'assistant' AND text IS NOT NULL AND turn IS NOT NULL AS spoken FROM conversations),
lines AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS by_text, 0 AS calls, 0 AS linked, 0 AS invalid, 0 AS orphan,
    '{{"content":' || {text.format("coalesce(text, '')")} || ',"role":' || {text.format("role")} || '}}' AS line FROM m WHERE NOT spoken
  UNION ALL SELECT conv_id, turn, role, text, 2, 1 + CAST(n % 3 <> 0 AS INTEGER), CAST(n % 5 = 0 OR n % 7 = 0 AS INTEGER), 0,
    '{{"content":' || {text.format("text")} || ',"role":"assistant","tool_calls":[{{"arguments":{{"turn":' || turn || '}},"id":"a' || turn || '","name":"fetch","problems":[],"result":' || {text.format("substr(text, 1, 8)")}
    || '}},{{"arguments":{{"by":{{"y":[2],"z":1}},' || CASE WHEN n % 7 = 0 THEN '' WHEN n % 5 = 0 THEN '"chars":"' || n || '",' ELSE '"chars":' || n || ',' END || '"of":"$a' || turn || '"}},"id":"b' || turn || '","name":"measure","problems":['
    || CASE WHEN n % 7 = 0 THEN '"missing:chars"' WHEN n % 5 = 0 THEN '"type:chars"' ELSE '' END || ']' || CASE WHEN n % 3 <> 0 THEN ',"result":{{"m":' || turn || ',"n":' || n || '}}' ELSE '' END || '}}]}}' FROM m WHERE spoken
  UNION ALL SELECT conv_id, turn, 'tool', '', 0, 0, 0, 0, NULL FROM m WHERE spoken
  UNION ALL SELECT conv_id, turn, 'tool', '', 0, 0, 0, 0, NULL FROM m WHERE spoken AND n % 3 <> 0
  UNION ALL SELECT conv_id, turn, 'tool', '', 0, 0, 0, 1, '{{"content":"nobody asked","role":"tool"}}' FROM m WHERE spoken AND n % 4 = 0)
SELECT conv_id, count(*) AS n_messages, CAST(sum(calls) AS BIGINT) AS n_calls, CAST(sum(linked) AS BIGINT) AS n_linked, CAST(sum(invalid) AS BIGINT) AS n_invalid, CAST(sum(orphan) AS BIGINT) AS n_orphans,
  '[' || string_agg(line, ',' ORDER BY turn, role, by_text) || ']' AS chat FROM lines GROUP BY 1'''


def _words_sql() -> str:
    n = automaton.LENGTH
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT rid, doc_id, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: sha256(array_to_string(ws[i : i + {n - 1}], ' ')))) AS h FROM docs WHERE len(ws) >= {n}),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY 1),
hits AS (SELECT rid, i, i AS hit FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs),
marked AS (SELECT rid, i, word, max(hit) OVER (PARTITION BY rid ORDER BY i ROWS {n - 1} PRECEDING) IS NOT NULL AS removed FROM words LEFT JOIN hits USING (rid, i)),
kept AS (SELECT rid, count_if(removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS body FROM marked GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)"""


def _bytes_sql() -> str:
    n = suffixes.LENGTH
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
windows AS (SELECT rid, doc_id, unnest(range(0, size - {n - 1})) AS i, unnest(list_transform(range(0, size - {n - 1}), lambda i: md5_number(b[i + 1 : i + {n}]))) AS h FROM docs WHERE size >= {n}),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY 1),
hits AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id),
runs AS (SELECT rid, i, count_if(before IS NULL OR i > before + {n}) OVER (PARTITION BY rid ORDER BY i) AS k FROM hits),
spans AS (SELECT rid, min(i) AS a, max(i) + {n} AS z FROM runs GROUP BY rid, k),
gaps AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS y FROM spans),
pieces AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS upto, string_agg(hex(b[y + 1 : a]), '' ORDER BY a) AS body FROM gaps JOIN docs USING (rid) GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN upto IS NULL THEN b ELSE unhex(body || hex(b[upto + 1 : size])) END) AS kept_sha256 FROM docs LEFT JOIN pieces USING (rid)"""


def _url_sql() -> str:
    fixed = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value: Callable[[tuple], str]) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in fixed) + " END"

    # Every set of a labelled URL's tokens is counted: the tables' URLs have few.
    return rf"""WITH parts AS (SELECT page_id, url, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fixed AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS told FROM parts),
tokens AS (SELECT DISTINCT url, told, list_sort(list_distinct(list_filter(list_transform(string_split(host, '.'), lambda x: 'h:' || x) || list_transform(string_split_regex(lower(path), '[/.]'), lambda x: 'p:' || x)
  || list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda x: 'q:' || x), lambda x: length(x) > 2))) AS held FROM fixed WHERE url IS NOT NULL),
labelled AS (SELECT * FROM tokens WHERE told IS NOT NULL),
size AS (SELECT count(*) AS n, ceil(least(1.0::DOUBLE, greatest({urls.MIN_SUPPORT}::DOUBLE, {urls.MIN_COUNT}::DOUBLE / greatest(count(*), 1))) * count(*)) AS least_n FROM labelled),
sets AS (SELECT told, list_filter(held, lambda x, k: (mask >> (k - 1)) & 1 = 1) AS s FROM (SELECT told, held, unnest(range(1, 1 << len(held))) AS mask FROM labelled)),
of_set AS (SELECT s, count(*) AS n_set FROM sets GROUP BY 1), of_told AS (SELECT told, count(*) AS n_told FROM labelled GROUP BY 1),
rules AS (SELECT s, told, both_n / n_set AS sure FROM (SELECT s, told, count(*) AS both_n FROM sets GROUP BY 1, 2) JOIN of_set USING (s) JOIN of_told USING (told), size
  WHERE both_n >= least_n AND both_n / n_set >= {urls.MIN_CONFIDENCE}::DOUBLE AND (both_n / n_set) / (n_told / n) >= {urls.MIN_LIFT}::DOUBLE),
kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules p WHERE p.told = r.told AND p.sure >= r.sure AND len(p.s) < len(r.s) AND list_has_all(r.s, p.s))),
best AS (SELECT url, kept.told AS mined FROM tokens JOIN kept ON list_has_all(held, s) WHERE tokens.told IS NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY sure DESC, len(s) DESC, kept.told DESC) = 1)
SELECT page_id, host, path, rule, coalesce(told, mined, '{urls.DEFAULT}') AS verdict FROM fixed LEFT JOIN best USING (url)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _words_sql(), "op4_suffix_array_dedup": _bytes_sql(), "op5_url_filter": _url_sql(), "op2_license_scan": _license_sql(), "op3_decontamination": _contamination_sql(), "op7_quality_rules": _quality_sql(), "op10_chat_format": _chat_sql()}
