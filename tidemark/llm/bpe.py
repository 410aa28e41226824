"""Byte-pair encoding by forced-boundary splitting.

A merge joins two neighbours into a token of the vocabulary. Where two neighbouring symbols (bytes, the
last of a word with its end mark) stand side by side in no token, no merge can cross, so the place is a
certain cut. Words are cut there; each fragment is merged alone, and words' ids are kept; a word's ids
are the fragments' ids one after the other. The result is that of merging the whole word.

The vocabulary file is read on the driver and sent along (2 MB, bounded by the vocabulary, not by the data).
Null texts count as empty and have no ids; an empty table gives no rows. Each row is encoded alone, so repeated rows
get equal ids. Long fragments, such as a very long word of one letter, are merged with a heap, in n log n; words of
more than ``LONG`` characters aren't kept. A column ``ids``, ``n_tokens`` or ``decoded`` of the frame is replaced, unless it is the input.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded

#: Words that a worker keeps, twice: those met since, and those of the time before.
CACHE = 150_000
#: Characters of a word that may be kept, and symbols of a fragment that are searched one by one for the next merge.
LONG = 64
#: Oniguruma's white space.
_SPACE = r"\t-\r\x20\x85\p{Z}"
_FINAL_SIGMA = "Σ"
#: Letters whose class and case don't hang on the version of Unicode; other texts go through the library's tables.
_SETTLED = regex.compile(r"[\x00-\u024F\u0370-\u03FF\u0400-\u04FF\u2000-\u206F\u20AC\u3040-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]*")
_NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class _Kept(dict):
    """Values of ``make`` for words; those not met for long go."""

    def __init__(self, make: Callable[[str], tuple]) -> None:
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> tuple:
        if len(word) > LONG:
            return self.make(word)
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        value = self.before.get(word)
        self[word] = value = self.make(word) if value is None else value
        return value


class WordBpe:
    """Encoder and decoder for a BPE file whose words end in a mark."""

    def __init__(self, text: str) -> None:
        data = json.loads(text)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is in no piece, so collapsing it first would change nothing.
        self.pieces = regex.compile(self.pattern.replace(r"\s", _SPACE))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.file = text
        self.symbol = byte_symbols()
        self.last = [x + self.end for x in self.symbol]
        self.joined = self._neighbours()
        self.ids, self.said = _Kept(self.word_ids), _Kept(self.word_text)

    def symbols(self, token: str) -> list[str]:
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
        out = list(body)
        if len(body) != len(token) and out:
            out[-1] += self.end
        return out

    def _neighbours(self) -> set[tuple[str, str]]:
        """All pairs of symbols that stand side by side inside some token."""
        pairs: set[tuple[str, str]] = set()
        for token in self.vocab:
            s = self.symbols(token)
            pairs.update(zip(s, s[1:]))
        return pairs

    def cut(self, symbols: list[str]) -> Iterator[tuple[str, ...]]:
        """The fragments between certain cuts."""
        start = 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.joined:
                yield tuple(symbols[start:i])
                start = i
        if symbols:
            yield tuple(symbols[start:])

    def merge(self, parts: tuple[str, ...]) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is joined, leftmost first, until none is left."""
        p, rank = list(parts), self.rank.get
        if len(p) > LONG:
            return self._merge_long(p)
        ranks = [rank(pair, _NONE) for pair in zip(p, p[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            p[i : i + 2] = [p[i] + p[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((p[i - 1], p[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((p[i], p[i + 1]), _NONE)
        return [self.vocab[x] for x in p if x in self.vocab]

    def _merge_long(self, p: list[str]) -> list[int]:
        """The same with a heap of pairs: places stay, what was joined into the one before is empty."""
        n, rank = len(p), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(p, p[1:])) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if not p[i] or j >= n or rank((p[i], p[j])) != r:
                continue  # one of the two has changed since
            p[i] += p[j]
            p[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((p[i], p[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((p[h], p[i]))) is not None:
                heappush(heap, (r, h))
        return [self.vocab[x] for x in p if x in self.vocab]

    def word_ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        s = [self.symbol[b] for b in data]
        s[-1] = self.last[data[-1]]
        return tuple(i for fragment in self.cut(s) for i in self.merge(fragment))

    def word_text(self, piece: str) -> tuple[int, str, str]:
        """Number of ids, their decimals, their tokens, each joined by spaces."""
        ids = self.word_ids(piece)
        return len(ids), " ".join(map(str, ids)), " ".join(self.token[i] for i in ids)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: str.lower() would look around a sigma.
        return "".join(map(str.lower, text)) if _FINAL_SIGMA in text else text.lower()

    @cached_property
    def tables(self) -> tuple:
        """The library's normalizer and splitter, which have its own version of Unicode."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        return Tokenizer.from_str(self.file).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)

    def split(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if text.isascii() or _SETTLED.fullmatch(text):
            return self.pieces.findall(self.normal(text))
        normalizer, splitter = self.tables
        return [piece for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]

    def stretches(self, text: str | None) -> Iterator[tuple[bool, str]]:
        """Special tokens (True) and what is between them."""
        if text and (self.split_special is None or "<|" not in text):
            yield False, text
        elif text:
            for k, stretch in enumerate(self.split_special.split(text)):
                if stretch:
                    yield k % 2 == 1, stretch

    def spoken(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, their decimals, their tokens, each joined by spaces."""
        parts: list[tuple[int, str, str]] = []
        for special, stretch in self.stretches(text):
            parts += [(1, str(self.special[stretch]), stretch)] if special else map(self.said.__getitem__, self.split(stretch))
        return sum(x[0] for x in parts), " ".join([x[1] for x in parts if x[0]]), " ".join([x[2] for x in parts if x[0]])

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, stretch in self.stretches(text):
            if special:
                out.append(self.special[stretch])
            else:
                out += chain.from_iterable(map(self.ids.__getitem__, self.split(stretch)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def _loaded(text: str) -> WordBpe:
    return WordBpe(text)


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(f.read())


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return bounded(df).sparkSession.sparkContext.broadcast(f.read())


def ids_column(df: DataFrame, path: str, text: str = "text") -> Column:
    """``array<int>`` of the ids of each text."""
    file = _vocabulary(df, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _loaded(file.value)
        for batch in batches:
            yield pd.Series([coder.encode(t) for t in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(F.col(text))


def digest_column(df: DataFrame, path: str, text: str = "text") -> Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded again."""
    file = _vocabulary(df, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _loaded(file.value)
        for batch in batches:
            rows = []
            for t in batch:
                n, ids, tokens = coder.spoken(t)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text))


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The frame with ``ids`` and ``n_tokens``; columns of these names are replaced."""
    return df.withColumn("ids", ids_column(df, path, text)).withColumn("n_tokens", F.size("ids"))


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The frame with ``decoded``, the text that ``ids`` stand for; null ids give null."""
    file = _vocabulary(df, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _loaded(file.value)
        for batch in batches:
            yield pd.Series([None if x is None else coder.decode(list(x)) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))
