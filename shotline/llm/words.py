"""Vectorised tokenising and hashing of Arrow text columns inside Spark tasks.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters; texts are lower-cased
first.  Words become 64-bit hashes that are the same in every task and every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 18
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 1 << 12

_U = np.uint64
_CHUNK = BATCH_BYTES + 2 * LONG_WORD


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 7919)) * _U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POW: np.ndarray | None = None
_INV: np.ndarray | None = None
_BYTE = seeded(1, 256)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _r in (range(48, 58), range(65, 91), range(97, 123), (95,)):
    _IS_WORD[list(_r)] = True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None:
        _POW, _INV = _powers(_BASE, _CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)
    return _POW, _INV


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are ordered and don't overlap."""
    out = np.zeros(len(starts), dtype=_U)
    powers, inverse = _tables()
    size = ends - starts
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while at < len(short):
        base = starts[short[at]]
        to = at + int(np.searchsorted(ends[short[at:]], base + _CHUNK, "right"))
        own = short[at:to]
        s, e = starts[own] - base, ends[own] - base
        sums = np.zeros(int(e[-1]) + 1, dtype=_U)
        np.cumsum(_BYTE[buf[base : base + e[-1]]] * powers[: e[-1]], out=sums[1:])
        out[own] = mix((sums[e] - sums[s]) * inverse[s] + size[own].astype(_U))
        at = to
    return out


class Batch(NamedTuple):
    """Rows [first, last) of an Arrow batch, tokenised.

    buf: their lower-cased bytes; offsets: where each row begins, and the end; starts, ends: of each word in buf;
    row: of each word, counted from first; hash: of each word.
    """

    first: int
    last: int
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = to


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a row."""
    is_word = _IS_WORD[buf]
    before, after = np.zeros_like(is_word), np.zeros_like(is_word)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edges], after[edges - 1] = False, False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


def batches(texts: pa.Array) -> Iterator[Batch]:
    """Tokenise a text column piece by piece, so that memory stays bounded."""
    buf, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for a, b in groups(offsets):
        own, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(own):
            starts, ends = find_words(own, at)
            row = np.searchsorted(at[1:], starts, "right")
            yield Batch(a, b, own, at, starts, ends, row, hash_spans(own, starts, ends))
        else:
            none = np.zeros(0, dtype=np.int64)
            yield Batch(a, b, own, at, none, none, none, np.zeros(0, dtype=_U))


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of width words, by row: hashes and their rows, sorted by row, then hash (its top 44 bits).

    A row with fewer words, but one at least, has all its words as its only shingle.
    """
    mult = seeded(2, width) | _U(1)
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, dtype=np.int64)
    out, own = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    if len(hashes) >= width:
        full = row[: len(row) - width + 1] == row[width - 1 :]
        total = np.zeros(len(row) - width + 1, dtype=_U)
        for k in range(width):
            total += hashes[k : len(row) - width + 1 + k] * mult[k]
        out, own = mix(total[full]), row[: len(row) - width + 1][full]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.searchsorted(row, few)
        more = np.zeros(len(few), dtype=_U)
        for k in range(width - 1):
            has = counts[few] > k
            more[has] += hashes[first[has] + k] * mult[k]
        out, own = np.concatenate([out, mix(more + counts[few].astype(_U))]), np.concatenate([own, few])
    return distinct(out, own)


def order_by_row(row: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Stable order by row, then by the top bits of each value (44 bits of one, 22 of each of two)."""
    if len(row) and int(row.max()) >= 1 << 20:
        return np.lexsort((*reversed(values), row))
    bits = 44 // len(values)
    key = row.astype(_U)
    for v in values:
        key = (key << _U(bits)) | (v >> _U(64 - bits))
    return np.argsort(key, kind="stable" if len(values) > 1 else None)


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then by the top 44 bits of the hash."""
    if not len(hashes):
        return hashes, row
    order = order_by_row(row, hashes)
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], row[keep]


def row_sums(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum, modulo 2^64, of each row's values; rows are sorted."""
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values, out=sums[1:])
    at = np.searchsorted(row, np.arange(n_rows + 1))
    return sums[at[1:]] - sums[at[:-1]]
