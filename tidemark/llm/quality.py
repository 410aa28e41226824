"""Quality rules: how much of a text lies in repeated n-grams and lines.

A document is judged alone, in one pass without a shuffle. Rolling hashes of several n-gram lengths are
built from one another in numpy: ``H_n[i] = H_(n-1)[i] * B + x[i + n - 1]``; an n-gram is duplicated if its
hash comes twice in the text; the characters of the words that duplicated n-grams cover are summed.

Null and empty texts have no words and are rejected. Rows are judged one by one, so repeated rows and ties
get equal verdicts; other columns are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, fresh, mix, words

#: For each n-gram length, the share of word characters in duplicated n-grams that a text may have, in percent.
MAX_SHARE = {5: 30, 7: 28, 10: 25}
#: The same for lines that repeat an earlier one, and symbols for each 100 words.
MAX_LINE_SHARE, MAX_SYMBOLS = 30, 10
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"

_BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in MAX_SHARE)]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", base_failed boolean, kept boolean"


def _cover(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks of the words in n-grams that start at the marks."""
    edge = np.zeros(size + 1, np.int32)
    edge[:-1][: start.size] += start
    edge[n : n + start.size] -= start
    return np.cumsum(edge[:-1]) > 0


def _duplicated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(keys.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(text: str | None) -> tuple:
    """The values of SCHEMA for one text."""
    text = text or ""
    w = words(text)
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    chars = np.array([len(x.decode()) for x in ids], np.int64)[code] if w else np.zeros(0, np.int64)
    total = int(chars.sum())

    lines = Counter(line for line in text.split("\n") if line.encode().split())
    again = {line: n - 1 for line, n in lines.items() if n > 1}
    dup_line_chars = sum(n * (len(line) - sum(line.count(c) for c in " \t\n\v\f\r")) for line, n in again.items())

    repeated = 0
    if len(w) >= 3:  # exact: numbers of pairs, then of triples
        _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
        triple = pair[:-1].astype(np.int64) * len(ids) + code[2:]
        repeated = int(_cover(_duplicated(triple), 3, len(w)).sum())

    x, shares = mix(code.astype(np.uint64) + _BASE), []
    rolled, length = x, 1
    for n in MAX_SHARE:
        if len(w) < n:
            shares.append(0)
            continue
        while length < n:
            rolled, length = rolled[:-1] * _BASE + x[length:], length + 1
        dup = _duplicated(rolled)
        shares.append(int(chars[_cover(dup, n, len(w))].sum()) if dup.any() else 0)

    symbols = sum(map(text.count, SYMBOLS))
    base_failed = len(w) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(w)
    bad = any(100 * s > limit * total for s, limit in zip(shares, MAX_SHARE.values())) or 100 * dup_line_chars > MAX_LINE_SHARE * total or 100 * symbols > MAX_SYMBOLS * len(w)
    return len(w), total, symbols, sum(again.values()), repeated, dup_line_chars, *shares, base_failed, not (base_failed or bad)


def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [*FIELDS, "base_failed", "kept"]
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=names)


def measured(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """The frame with a struct column ``into`` of the fields of SCHEMA."""
    return bounded(df).withColumn(into, F.pandas_udf(judge, SCHEMA)(F.col(text)))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with their columns."""
    into = fresh(df, "quality")
    return measured(df, text, into).where(F.col(into)["kept"]).drop(into)
