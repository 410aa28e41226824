"""Passages that documents share: the frame around the two substring deduplications.

A text is a row of symbols (words, or bytes). A window is ``length`` symbols in a row of one document; it is
removed if the same window starts in a document with a smaller id. What is removed is what an index of a
reference shard says (a suffix automaton or an enhanced suffix array: ``resolve``); the rest is the way there:

1. Equal texts travel once, compressed, with their documents.
2. Every window has a key, the least hash of the ``gram``-symbol strings in it. Equal windows have equal
   keys, and windows in a row mostly share one, so a text falls into *runs* of up to ``RUN`` windows with one
   key. Keys that occur in one document only are left out (``shared``: five bytes a key, two bits back).
3. The runs left over are put in the shared folder by blocks of documents, equal ones of a block once. A block
   announces the key, a hash of the content (it depends on the order of the symbols) and the least document of
   each. Runs with one key and one content are one *passage*, told apart from others by these 128 bits.
4. Passages under one key make a reference shard. The block of a passage's first document sends its symbols,
   and whether later documents have it. The shard's index holds every passage and compares symbols: it says which
   windows of a passage also start in an earlier document, and whether later copies are found whole.
5. A key with more than ``HOT`` runs in the corpus would fill one shard. All blocks are told so in step 2, and
   cut its runs into single windows, each a passage under its own hash: equal windows meet, others don't. They go
   to the same index. So a shard has at most ``SHARD`` symbols and those of one key, ``HOT * (RUN + length)``.
6. Blocks ask for what was found of their runs, and each text's removed windows go back to it as spans.

Texts shorter than a window lose nothing; null texts are empty. Repeated rows (one id) never remove one another,
and of two documents the one with the greater id loses. Documents with a null id neither remove nor lose
anything. An empty table gives no rows; other columns, whatever their names, aren't touched. A very long text
stays in the memory of one task, with some 40 bytes for each of its symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.common import blocks_for, bounded, dealt, fresh, mix, text_bytes, written

#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 2 << 20
#: Windows of a run at most, and runs of one key in the corpus beyond which the key is hot.
RUN, HOT = 192, 512
#: Symbols that are hashed at once, for the CPU's caches, and symbols of a reference shard's index.
CHUNK, SHARD = 1 << 17, 1 << 16
#: Bits by which the buckets of passages are finer than those of keys.
SHARD_BITS = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: ``again``: the spans are those of documents after the first that has the text.
SPANS = "block long, text_hash long, again boolean, starts array<int>, ends array<int>"
PACKED = "block long, payload binary"
#: No document.
LAST = np.iinfo(np.int64).max
#: Bytes of text that a task gathers before it sends them on.
BATCH_BYTES = 16 << 20
STATE = "block long, doc binary, next binary, hash binary, text binary, start binary, run binary, key binary, content binary, size binary, first binary, later binary, offset binary, hot binary, symbols binary"
CITED = "bucket long, block long, payload binary"
FOUND = "block long, bucket long, run long, payload binary, first binary"

#: A text's symbols, as they are kept.
Symbols = Callable[[bytes], np.ndarray]
#: Kept symbols as scattered uint64s, to be hashed.
Scatter = Callable[[np.ndarray], np.ndarray]
#: From passages in order of their keys (key, first document, whether later ones have it, symbols) and the length
#: to the marks of the windows that the first document loses, and whether later documents' copies are found.
Passage = tuple[int, int, bool, np.ndarray]
Resolve = Callable[[list[Passage], int], list[tuple[np.ndarray, bool]]]


class Alphabet(NamedTuple):
    symbols: Symbols
    scatter: Scatter
    dtype: type
    #: Bytes of text for a symbol, about.
    per_symbol: int
    #: Symbols that a key is a hash of: few enough that keys are sparse, enough that chance doesn't repeat them.
    gram: int


# windows


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the strings that strings hashed to ``a`` and ``b`` make together."""
    x = a * (_ODD + np.uint64(2 * level))
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A hash for each place where ``n`` symbols in a row start, by doubling."""
    if x.size < n:
        return np.zeros(0, np.uint64)
    power, have, out, taken = x, 1, None, 0
    while True:
        if n & have:
            size = x.size - taken - have + 1
            out = power.copy() if out is None else _join(out[:size], power[taken : taken + size], 64 + have)
            taken += have
        if taken == n:
            return out[: x.size - n + 1]
        power, have = _join(power[:-have], power[have:], have), have * 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` numbers in a row."""
    have = 1
    while have * 2 <= n:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: x.size - (n - have)], x[n - have :]) if n > have else x


def runs(texts: list[np.ndarray], length: int, of: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, windows, key`` of the runs of windows with one key, in order."""
    out, at = [], 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (size == 0 or size < CHUNK):
            size, upto = size + texts[upto].size, upto + 1
        sizes = np.array([t.size for t in texts[at:upto]])
        joined = np.concatenate(texts[at:upto])
        if joined.size >= length:
            keys = mix(_least(gram_hashes(of.scatter(joined), of.gram), length - of.gram + 1))  # the least of many are small numbers
            text = np.repeat(np.arange(sizes.size), sizes)
            offset = np.cumsum(sizes) - sizes
            inside = text[: keys.size] == text[length - 1 :]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1 : keys.size] != text[: keys.size - 1])]
            start = np.flatnonzero(inside & np.r_[True, new[1:] | ~inside[:-1]])
            stop = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
            parts = -((start - stop) // RUN)
            if parts.size and parts.max() > 1:
                nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                start, stop = np.repeat(start, parts) + nth * RUN, np.repeat(stop, parts)
                stop = np.minimum(stop, start + RUN)
            out.append((text[start] + at, start - offset[text[start]], stop - start, keys[start]))
        at = upto
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def contents(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the pieces of scattered symbols at ``start`` with ``size`` symbols: polynomials, so order counts."""
    up, down = np.full(x.size + 1, _ODD), np.full(x.size + 1, _INVERSE)
    up[0] = down[0] = 1
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(up)[:-1])]
    return mix((sums[start + size] - sums[start]) * np.cumprod(down)[start] + size.astype(np.uint64))


# blocks


class Text(NamedTuple):
    data: bytes
    hash: int
    #: Ids of the documents that have it, one for each row; those of rows without one aside.
    docs: list[int]
    unknown: int


def _pack(texts: dict[bytes, tuple[list[int], int]]) -> bytes:
    data = list(texts)
    counts = np.array([(len(t), len(texts[t][0]), texts[t][1]) for t in data], np.int64)
    docs = np.array([d for t in data for d in texts[t][0]], np.int64)
    return zstandard.compress(np.int64(len(data)).tobytes() + counts.tobytes() + docs.tobytes() + b"".join(data), 3)


def _unpacked(payloads: Iterable[bytes]) -> list[Text]:
    """The distinct texts of a block, in order of their least documents; those without one last."""
    out: dict[bytes, tuple[list[int], list[int]]] = {}
    for payload in payloads:
        raw = zstandard.decompress(payload)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        counts = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(-1, 3)
        docs = np.frombuffer(raw, np.int64, int(counts[:, 1].sum()), 8 + 24 * n).tolist()
        at, d = 8 + 24 * n + 8 * len(docs), 0
        for size, known, unknown in counts.tolist():
            own = out.setdefault(raw[at : at + size], ([], []))
            own[0].extend(docs[d : d + known])
            own[1].append(unknown)
            at, d = at + size, d + known
    texts = [Text(t, xxhash.xxh64_intdigest(t, 42), sorted(docs), sum(unknown)) for t, (docs, unknown) in out.items()]
    return sorted(texts, key=lambda t: (not t.docs, t.docs[:1], t.hash))


def _packer(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, dict[bytes, tuple[list[int], int]]] = {}
        held = 0

        def flush() -> pd.DataFrame:
            rows = [(b, _pack(texts)) for b, texts in blocks.items()]
            blocks.clear()
            return pd.DataFrame(rows, columns=["block", "payload"])

        for pdf in batches:
            known = pdf.known.to_numpy(bool)
            for d, k, text in zip(pdf.doc_id.tolist(), known.tolist(), pdf.text):
                data = (text or "").encode()
                own = blocks.setdefault(xxhash.xxh64_intdigest(data, 42) % n, {})
                docs, unknown = own.get(data, ([], 0))
                if not docs and not unknown:
                    held += len(data)
                if k:
                    docs.append(d)
                own[data] = (docs, unknown + (not k))
            if held >= BATCH_BYTES:
                yield flush()
                held = 0
        if blocks:
            yield flush()

    return run


def packed(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """Rows of PACKED, each block's in one partition. Null texts are empty ones."""
    rows = bounded(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(doc_id).isNotNull().alias("known"), F.col(text).alias("text"))
    return dealt(rows.mapInPandas(_packer(n), PACKED), "block")


class _Read(NamedTuple):
    """Texts of a block that have a document: the least one, the next one or LAST, the hash and the symbols."""

    doc: np.ndarray
    next: np.ndarray
    hash: np.ndarray
    texts: list[np.ndarray]


def _read(pdf: pd.DataFrame, of: Alphabet) -> _Read:
    texts = [t for t in _unpacked(pdf.payload) if t.docs]
    after = [next((d for d in t.docs if d != t.docs[0]), LAST) for t in texts]
    hashes = np.array([t.hash for t in texts], np.uint64).view(np.int64)
    return _Read(np.array([t.docs[0] for t in texts], np.int64), np.array(after, np.int64), hashes, [of.symbols(t.data) for t in texts])


def _bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _sender(of: Alphabet, length: int, bits: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _read(pdf, of)
        text, _, _, keys = runs(own.texts, length, of)
        distinct, many, count = shared.unique_keys(keys, own.doc[text], own.next[text] != LAST)
        return shared.send(key[0], distinct, many, count, bits)

    return run


def _keeper(of: Alphabet, length: int, bits: int):
    """From a block's documents and answers to its row of STATE."""

    def run(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = _read(pdf, of)
        text, start, size, keys = runs(own.texts, length, of)
        distinct = np.unique(keys)
        common, hot_keys = shared.received(got, distinct, bits)
        at = np.searchsorted(distinct, keys)
        hit = common[at]
        text, start, size, keys, hot_keys = text[hit], start[hit], size[hit], keys[hit], hot_keys[at[hit]]
        if not keys.size:
            return pd.DataFrame(columns=[c.split()[0] for c in STATE.split(", ")])
        content = np.empty(keys.size, np.uint64)
        for t, a, b in _groups(text):
            content[a:b] = contents(of.scatter(own.texts[t]), start[a:b], size[a:b] + length - 1)
        doc = own.doc[text]
        order = np.lexsort((doc, content, keys))
        k, c = keys[order], content[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        run_of = np.empty(keys.size, np.int64)
        run_of[order] = np.cumsum(new) - 1
        first = order[new]
        later = np.zeros(first.size, bool)
        later[run_of[(own.next[text] != LAST) | (doc != doc[first][run_of])]] = True
        offset, symbols = _laid_out(own.texts, text[first], start[first], size[first] + length - 1)
        used, text = np.unique(text, return_inverse=True)
        row = (
            key[0], own.doc[used].tobytes(), own.next[used].tobytes(), own.hash[used].tobytes(), text.astype(np.int32).tobytes(), start.astype(np.int32).tobytes(), run_of.astype(np.int32).tobytes(),
            keys[first].tobytes(), content[first].tobytes(), size[first].astype(np.int32).tobytes(), text[first].astype(np.int32).tobytes(), later.tobytes(), offset.tobytes(), hot_keys[first].tobytes(), symbols.tobytes(),
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def _laid_out(texts: list[np.ndarray], text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of pieces of texts in one array that has the symbols where pieces overlap once."""
    offset, parts, total = np.empty(text.size, np.int64), [], 0
    order = np.lexsort((start, text))
    at, upto = -1, 0
    for i, t, a, n in zip(order.tolist(), text[order].tolist(), start[order].tolist(), size[order].tolist()):
        if t != at or a > upto:
            at, upto, base = t, a, total - a
        offset[i] = base + a
        if a + n > upto:
            parts.append(texts[t][upto : a + n])
            total, upto = total + a + n - upto, a + n
    return offset, np.concatenate(parts)


def _groups(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if sorted_.size else []
    for a, b in zip(at, np.r_[at[1:], sorted_.size]):
        yield sorted_[a], int(a), int(b)


class _Items(NamedTuple):
    """What a block announces, in order: passages of its runs, and of single windows of hot ones."""

    key: np.ndarray
    content: np.ndarray
    first: np.ndarray
    later: np.ndarray
    #: Runs, or windows of runs counted on from the runs.
    place: np.ndarray
    #: The item of each run and window, -1 for none.
    of: np.ndarray


class _Block:
    """A row of STATE, read."""

    def __init__(self, row, length: int, of: Alphabet) -> None:
        get = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        doc, after, hashes, text = get("doc", np.int64), get("next", np.int64), get("hash", np.int64), get("text", np.int32)
        self.text, self.hashes, self.doc, self.next, self.start, self.run = text, hashes, doc[text], after[text], get("start", np.int32).astype(np.int64), get("run", np.int32)
        self.key, self.content, self.size, self.first = get("key", np.uint64), get("content", np.uint64), get("size", np.int32).astype(np.int64), doc[get("first", np.int32)]
        self.later, self.hot, self.offset, self.symbols = get("later", bool), get("hot", bool), get("offset", np.int64), get("symbols", of.dtype)
        self.length, self.scatter = length, of.scatter

    def piece(self, r: int) -> np.ndarray:
        """The symbols of a run's windows."""
        return self.symbols[self.offset[r] : self.offset[r] + self.size[r] + self.length - 1]

    def pieces(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of runs and windows one after the other, and how many each has."""
        n = self.size.size
        ends = np.cumsum(self.size) + n
        window = place >= n
        r = np.where(window, np.searchsorted(ends, place, "right"), place)
        start = self.offset[r] + np.where(window, place - ends[r] + self.size[r], 0)
        size = np.where(window, 1, self.size[r]) + self.length - 1
        return self.symbols[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size

    def items(self) -> _Items:
        cold, n = np.flatnonzero(~self.hot), self.size.size
        key, content, first, later, place = [self.key[cold]], [self.content[cold]], [self.first[cold]], [self.later[cold]], [cold]
        hot = np.flatnonzero(self.hot)
        if hot.size:
            symbols, size = self.pieces(hot)
            x, windows = self.scatter(symbols), self.size[hot]
            nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.repeat(np.cumsum(size) - size, windows) + nth
            key.append(gram_hashes(x, self.length)[at])
            content.append(contents(x, at, np.full(at.size, self.length)))
            first.append(np.repeat(self.first[hot], windows))
            later.append(np.repeat(self.later[hot], windows))
            place.append(np.repeat((np.cumsum(self.size) - self.size + n)[hot], windows) + nth)
        k, c, f, l, p = map(np.concatenate, (key, content, first, later, place))
        order = np.lexsort((f, c, k))
        k, c, f, l, p = k[order], c[order], f[order], l[order], p[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if k.size else np.zeros(0, bool)
        item = np.cumsum(new) - 1
        many = np.zeros(int(new.sum()), bool)
        many[item[l | (f != f[new][item])]] = True
        of = np.full(n + int(self.size.sum()), -1)
        of[p] = item
        return _Items(k[new], c[new], f[new], many, p[new], of)


def _small(a: np.ndarray) -> bytes:
    """Longs in four bytes each and their least, or in eight; the last byte tells."""
    if a.size and int(a.max()) - (least := int(a.min())) < 1 << 32:
        return (a - least).astype(np.uint32).tobytes() + np.int64(least).tobytes() + b"\1"
    return a.tobytes() + b"\0"


def _large(data: bytes, n: int) -> np.ndarray:
    if data[-1]:
        return np.frombuffer(data, np.uint32, n).astype(np.int64) + np.frombuffer(data, np.int64, 1, 4 * n)
    return np.frombuffer(data, np.int64, n)


def _announcer(of: Alphabet, length: int, bits: int):
    """``block, bucket, payload``: keys, contents, later bits and first documents of a block's items; an int before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                x = _Block(row, length, of).items()
                rows += [(row.block, b, np.int64(j - i).tobytes() + x.key[i:j].tobytes() + x.content[i:j].tobytes() + _bits(x.later[i:j]) + _small(x.first[i:j])) for b, i, j in shared.slices(x.key, bits)]
            yield pd.DataFrame(rows, columns=["block", "bucket", "payload"])

    return run


class _Heard:
    """A bucket's announcements, one after the other."""

    def __init__(self, payloads: Iterable[bytes]) -> None:
        payloads = list(payloads)
        self.sizes = [int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads]
        both = list(zip(payloads, self.sizes))
        self.key = np.concatenate([np.frombuffer(p, np.uint64, n, 8) for p, n in both])
        self.content = np.concatenate([np.frombuffer(p, np.uint64, n, 8 + 8 * n) for p, n in both])
        self.later = np.concatenate([_unbits(p[8 + 16 * n : 8 + 16 * n + -(-n // 8)], n) for p, n in both])
        self.first = np.concatenate([_large(p[8 + 16 * n + -(-n // 8) :], n) for p, n in both])

    def slices(self) -> list[tuple[int, int]]:
        ends = np.cumsum(self.sizes)
        return [(int(e) - n, int(e)) for e, n in zip(ends, self.sizes)]


def _cite(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two bits for each announced item: whether the block sends its symbols, and whether later documents have it.

    It does if it has the first document, and another document or another passage under the key wants to know.
    """
    x = _Heard(pdf.payload)
    order = np.lexsort((x.first, x.content, x.key))
    k, c, f = x.key[order], x.content[order], x.first[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, c[1:] != c[:-1]]
    item = np.cumsum(new) - 1
    first = f[new][item]
    later = np.zeros(int(new.sum()), bool)
    later[item[x.later[order] | (f != first)]] = True
    several = np.bincount(np.cumsum(new_key[new]) - 1)[np.cumsum(new_key) - 1] > 1
    out = np.empty((2, k.size), bool)
    out[:, order] = (f == first) & (several | later[item]), later[item]
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "payload": [_bits(out[0, a:b]) + _bits(out[1, a:b]) for a, b in x.slices()]})


def _citer(of: Alphabet, length: int, bits: int):
    """The passages that this block is to send, packed by shard: places, sizes, keys, contents, documents, later bits, symbols."""

    def run(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows, by = [], dict(zip(got.bucket, got.payload))
        for row in pdf.itertuples():
            block = _Block(row, length, of)
            x = block.items()
            cited, later = np.zeros(x.key.size, bool), np.zeros(x.key.size, bool)
            for b, i, j in shared.slices(x.key, bits):
                half = -(-(j - i) // 8)
                cited[i:j], later[i:j] = _unbits(by[b][:half], j - i), _unbits(by[b][half:], j - i)
            at = np.flatnonzero(cited)
            for b, i, j in shared.slices(x.key[at], bits + SHARD_BITS):
                k = at[i:j]
                symbols, size = block.pieces(x.place[k])
                parts = (np.int64([k.size]), x.place[k].astype(np.int32), size.astype(np.int32), x.key[k], x.content[k], x.first[k])
                rows.append((b, row.block, b"".join(p.tobytes() for p in parts) + _bits(later[k]) + symbols.tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CITED.split(", ")])

    return run


class _Cited(NamedTuple):
    """Passages of a bucket in order of their keys."""

    block: np.ndarray
    place: np.ndarray
    size: np.ndarray
    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    later: np.ndarray
    symbols: list[np.ndarray]


def _gathered(pdf: pd.DataFrame, of: Alphabet) -> _Cited:
    columns: list[tuple] = []
    symbols: list[np.ndarray] = []
    for block, p in zip(pdf.block, pdf.payload):
        n = int(np.frombuffer(p, np.int64, 1)[0])
        place, size = np.frombuffer(p, np.int32, n, 8), np.frombuffer(p, np.int32, n, 8 + 4 * n)
        key, content, doc = (np.frombuffer(p, t, n, 8 + (8 + 8 * k) * n) for k, t in enumerate((np.uint64, np.uint64, np.int64)))
        at = 8 + 32 * n + -(-n // 8)
        columns.append((np.full(n, block, np.int64), place, size, key, content, doc, _unbits(p[8 + 32 * n : at], n)))
        symbols += np.split(np.frombuffer(p[at:], of.dtype), np.cumsum(size)[:-1])
    block, place, size, key, content, doc, later = map(np.concatenate, zip(*columns))
    order = np.lexsort((place, block, doc, content, key))
    return _Cited(block[order], place[order], size[order], key[order], content[order], doc[order], later[order], [symbols[k] for k in order.tolist()])


def _related(passages: list[Passage], length: int, of: Alphabet, resolve: Resolve) -> list[tuple[np.ndarray, bool]]:
    """What a shard's index says. Passages of one document none of whose windows has its hash in another stay out of it."""
    if all(p[2] for p in passages):
        return resolve(passages, length)
    sizes = np.array([p[3].size - length + 1 for p in passages])
    ends = np.cumsum(sizes + length - 1)
    owner = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(owner.size) + (ends - sizes - length + 1 - np.cumsum(sizes) + sizes)[owner]
    hashes = contents(of.scatter(np.concatenate([p[3] for p in passages])), place, np.full(place.size, length))
    order = np.argsort(hashes)
    h, o = hashes[order], owner[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    inside = np.array([p[2] for p in passages])
    inside[o[same]] = inside[o[same + 1]] = True
    said = [(np.zeros(n, bool), False) for n in sizes]
    chosen = np.flatnonzero(inside)
    if chosen.size:
        for k, answer in zip(chosen, resolve([passages[k] for k in chosen], length)):
            said[k] = answer
    return said


def _resolver(resolve: Resolve, length: int, of: Alphabet):
    """Rows of FOUND: marks for the citing blocks, and by bucket (block -1) the passages whose copies are found."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _gathered(pdf, of)
        passages = list(zip(x.key.tolist(), x.doc.tolist(), x.later.tolist(), x.symbols))
        starts = np.flatnonzero(np.r_[True, x.key[1:] != x.key[:-1]])
        upto = np.cumsum(np.add.reduceat(x.size, starts))
        said: list[tuple[np.ndarray, bool]] = []
        at = 0
        while at < starts.size:  # a shard has whole keys
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARD, "right")))
            said += _related(passages[starts[at] : starts[end] if end < starts.size else len(passages)], length, of, resolve)
            at = end
        rows = [(b, -1, r, _bits(m), b"") for b, r, (m, _) in zip(x.block.tolist(), x.place.tolist(), said) if m.any()]
        whole = np.array([f for _, f in said])
        if whole.any():
            rows.append((-1, key[0] >> SHARD_BITS, -1, np.concatenate([x.key[whole], x.content[whole]]).tobytes(), x.doc[whole].tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _tell(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Rows of FOUND for the blocks: a bit for each announced item that was found, and the first documents of these."""
    if not len(pdf) or not len(found):
        return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
    x = _Heard(pdf.payload)
    parts = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in found.payload]
    keys, content = np.concatenate(parts, axis=1)
    first = np.concatenate([np.frombuffer(f, np.int64) for f in found["first"]])
    n = keys.size
    k, c = np.r_[keys, x.key], np.r_[content, x.content]
    order = np.lexsort((np.arange(k.size) >= n, c, k))  # what is found, then what asks
    same = np.r_[False, (k[order][1:] == k[order][:-1]) & (c[order][1:] == c[order][:-1])]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(k.size)))]
    answer = np.empty(k.size, np.int64)
    answer[order] = head
    answer = answer[n:]
    hit = answer < n
    rows = [(b, key[0], -1, _bits(hit[i:j]), _small(first[answer[i:j][hit[i:j]]])) for b, (i, j) in zip(pdf.block, x.slices()) if hit[i:j].any()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def _finisher(of: Alphabet, length: int, bits: int):
    """From a block and what was found of it to the spans of its documents."""

    def run(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        marks, told = got[got.bucket < 0], got[got.bucket >= 0]
        by = dict(zip(told.bucket, zip(told.payload, told["first"])))
        for row in pdf.itertuples():
            b = _Block(row, length, of)
            x = b.items()
            first = np.full(x.key.size + 1, LAST)  # the last is for no item
            for bucket, i, j in shared.slices(x.key, bits):
                if bucket in by:
                    hit = i + np.flatnonzero(_unbits(by[bucket][0], j - i))
                    first[hit] = _large(by[bucket][1], hit.size)
            of_place, n = first[x.of], b.size.size
            offset = np.cumsum(b.size) - b.size + n
            marked = {int(r): _unbits(p, int(b.size[r])) for r, p in zip(marks.run, marks.payload) if r < n}
            has_marks = np.zeros(n, bool)
            has_marks[list(marked)] = True
            for again in (False, True):
                doc = b.next if again else b.doc
                asked = doc != LAST
                whole = asked & ~b.hot[b.run] & (of_place[b.run] < doc)
                text, start, end = [b.text[whole]], [b.start[whole]], [b.start[whole] + b.size[b.run[whole]] + length - 1]
                part = np.flatnonzero(asked & ~whole & b.hot[b.run])
                windows = b.size[b.run[part]]
                nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                hit = of_place[np.repeat(offset[b.run[part]], windows) + nth] < np.repeat(doc[part], windows)
                opens = np.flatnonzero(hit & ((nth == 0) | ~np.r_[False, hit[:-1]]))
                closes = np.flatnonzero(hit & (np.r_[nth[1:] == 0, True] | ~np.r_[hit[1:], False])) if hit.size else opens
                whose, at = np.repeat(part, windows), nth + np.repeat(b.start[part], windows)
                text.append(b.text[whose[opens]])
                start.append(at[opens])
                end.append(at[closes] + length)
                for k in np.flatnonzero(asked & ~whole & ~b.hot[b.run] & has_marks[b.run] & (doc == b.first[b.run])).tolist():
                    edge = np.flatnonzero(np.diff(np.r_[0, marked[int(b.run[k])].view(np.int8), 0]))
                    text.append(np.full(edge.size // 2, b.text[k]))
                    start.append(b.start[k] + edge[::2])
                    end.append(b.start[k] + edge[1::2] + length - 1)
                t, s, e = map(np.concatenate, (text, start, end))
                order = np.lexsort((s, t))  # a later start has a later end: windows in a row have one run
                t, s, e = t[order], s[order], e[order]
                new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] > e[:-1])] if t.size else np.zeros(0, bool)
                starts, ends = s[new], e[np.r_[new[1:], True]] if t.size else e
                out += [(row.block, int(b.hashes[u]), again, starts[i:j], ends[i:j]) for u, i, j in _groups(t[new])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SPANS.split(", ")])

    return run


def _plan(docs: DataFrame, of: Alphabet, length: int, text: str) -> tuple[int, int]:
    """Blocks, and bits of the buckets' numbers."""
    total = text_bytes(docs, text)
    return blocks_for(total, BLOCK_BYTES), shared.bucket_bits(2 * total // (of.per_symbol * (length - of.gram)))


def _spans(rows: DataFrame, bits: int, of: Alphabet, resolve: Resolve, length: int) -> DataFrame:
    """Rows of SPANS, from rows of PACKED."""
    answers = shared.meet(rows.groupBy("block").applyInPandas(_sender(of, length, bits), shared.SENT), HOT)
    state = written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_keeper(of, length, bits), STATE), "runs")

    schema = "block long, bucket long, payload binary"
    heard = dealt(state.mapInPandas(_announcer(of, length, bits), schema), "bucket").groupBy("bucket")
    by_block = dealt(state, "block").groupBy("block")
    cited = by_block.cogroup(heard.applyInPandas(_cite, schema).groupBy("block")).applyInPandas(_citer(of, length, bits), CITED)
    found = written(dealt(cited, "bucket").groupBy("bucket").applyInPandas(_resolver(resolve, length, of), FOUND), "found")
    told = heard.cogroup(found.where("block < 0").groupBy("bucket")).applyInPandas(_tell, FOUND)
    both = found.where("block >= 0").unionByName(told)
    return by_block.cogroup(both.groupBy("block")).applyInPandas(_finisher(of, length, bits), SPANS)


def digests(docs: DataFrame, of: Alphabet, resolve: Resolve, length: int, digest: Callable[[bytes, list, list], tuple], schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and what ``digest`` makes of the text and its removed spans: a row for each row."""
    n, bits = _plan(docs, of, length, text)
    rows = packed(docs, n, doc_id, text)
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(key: tuple, pdf: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        found = {(h, again): (list(s), list(e)) for h, again, s, e in zip(spans.text_hash.tolist(), spans.again.tolist(), spans.starts, spans.ends)}
        out = []
        for t in _unpacked(pdf.payload):
            signed = t.hash - (t.hash >> 63 << 64)
            whole = digest(t.data, [], []) if t.unknown else ()
            own = [digest(t.data, *found.get((signed, again), ([], []))) for again in (False, True)[: len(set(t.docs[:1] + t.docs[-1:]))]]
            out += [(None, *whole)] * t.unknown + [(d, *own[d != t.docs[0]]) for d in t.docs]
        done = pd.DataFrame(out, columns=names)
        return done.assign(doc_id=pd.array(done.doc_id, dtype="Int64"))

    spans = dealt(_spans(rows, bits, of, resolve, length), "block")
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(run, f"doc_id long, {schema}")


def with_spans(docs: DataFrame, of: Alphabet, resolve: Resolve, length: int, use: Callable[[Column, Column, Column], Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The frame with ``use(text, starts, ends)`` as its text; ``starts`` and ``ends`` are null where nothing is removed."""
    n, bits = _plan(docs, of, length, text)
    spans = _spans(packed(docs, n, doc_id, text), bits, of, resolve, length)
    hashed, starts, ends, first, of_first, again = (fresh(docs, c) for c in ("text_hash", "span_starts", "span_ends", "first_doc", "first_text", "again"))
    keyed = docs.withColumn(hashed, F.when(F.col(doc_id).isNotNull(), F.xxhash64(text)))
    least = keyed.where(F.col(hashed).isNotNull()).groupBy(F.col(hashed).alias(of_first)).agg(F.min(doc_id).alias(first))
    found = least.join(spans.select(F.col("text_hash").alias(of_first), F.col("again").alias(again), F.col("starts").alias(starts), F.col("ends").alias(ends)), of_first)
    mine = (F.col(hashed) == F.col(of_first)) & ((F.col(doc_id) > F.col(first)) == F.col(again))
    return keyed.join(found, mine, "left").withColumn(text, use(F.col(text), F.col(starts), F.col(ends))).select(*docs.columns)
