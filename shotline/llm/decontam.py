"""Benchmark decontamination by edit distance.

A document is contaminated by a benchmark item of n words (see words) if some stretch of it has a word edit distance
of at most floor(0.2 n) from the whole item.  Items with fewer than eight words are compared with no edits allowed;
items without a word match nothing.

Windows: k edits leave one of k + 1 pieces of an item intact, so a matching stretch shares a run of
q = floor((n - k) / (k + 1)) words with it.  Places that share no such run with any item can't match, so only the
windows that shared runs align are looked at, each with the size of the items of its length class (a class holds items
up to a seventh longer than its shortest).

Search: each window and each item is embedded by CGK random walks (a pointer reads a symbol at each step and moves on
by a random bit of step and symbol), which turns edit distance into Hamming distance.  Of each of several walks there
are many bit samples of a few positions, each a hash table of the items: a window is a candidate of the items that it
meets in one of the tables of its class.  Walks and samples were set for a recall above 0.99 at the largest distance,
which a test measures; since each shared run of an item gives a window of its own, a passage has several chances.

Verification: the exact edit distance of the item to any stretch of the document around the window.

Items are taken in blocks of a stated number of words, one block after the other, so that what the driver and a task
hold is bounded but for a single item.  Null or empty texts match nothing.  Repeated doc_ids or item_ids: the least
distance of their rows counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import shared, words

RATIO = 0.2
SHORT = 8
WALKS = 6
SAMPLES = 48
POSITIONS = 3
BLOCK_WORDS = 200_000
#: Words of documents that are searched at once.
POOL = 2_000_000
_U = np.uint64


def edits(n: int, ratio: float = RATIO) -> int:
    return math.floor(ratio * n + 1e-9) if n >= SHORT else 0


def piece(n: int, k: int) -> int:
    return max(1, (n - k) // (k + 1))


class Items:
    """Benchmark items prepared for search: words, runs of q words, embeddings."""

    def __init__(self, ids: list[int], texts: list[str], ratio: float = RATIO):
        found = {}
        for b in words.batches(pa.array(texts, pa.string())):
            cut = np.searchsorted(b.row, np.arange(b.last - b.first + 1))
            found |= {b.first + i: b.hash[cut[i] : cut[i + 1]] for i in range(b.last - b.first)}
        keep = [i for i in range(len(ids)) if len(found[i])]
        self.ids = np.array([ids[i] for i in keep], dtype=np.int64)
        self.words = [found[i] for i in keep]
        self.n = np.array([len(x) for x in self.words], dtype=np.int64)
        self.k = np.array([edits(n, ratio) for n in self.n], dtype=np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        q = np.array([min(4, piece(n, k)) for n, k in zip(self.n, self.k, strict=True)])
        for width in np.unique(q):
            h, item, pos = [], [], []
            for i in np.flatnonzero(q == width):
                g = run_hashes(self.words[i], int(width))
                h.append(g)
                item.append(np.full(len(g), i))
                pos.append(np.arange(len(g)))
            h, item, pos = map(np.concatenate, (h, item, pos))
            order = np.argsort(h, kind="stable")
            self.runs[int(width)] = h[order], item[order], pos[order]
        self._classes()

    def _classes(self) -> None:
        """Length classes, and the tables: sorted keys of all walks and samples, each with its item."""
        self.group, self.least = np.zeros(len(self.n), dtype=np.int64), []
        for i in np.argsort(self.n, kind="stable"):
            if not self.least or self.n[i] > self.least[-1] * 8 / 7:
                self.least.append(int(self.n[i]))
            self.group[i] = len(self.least) - 1
        rng = np.random.default_rng(7)
        longest = steps(self.least[-1]) if self.least else 1
        self.walks = rng.integers(1, 1 << 63, (WALKS, longest), dtype=np.uint64) | _U(1)
        self.where = rng.random((WALKS, SAMPLES, POSITIONS))
        keys, items = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for c, n in enumerate(self.least):
            own = np.flatnonzero(self.group == c)
            h = np.concatenate([self.words[i][:n] for i in own])
            for k in self.keys(c, h, np.arange(len(own)) * n, np.arange(1, len(own) + 1) * n):
                keys.append(k)
                items.append(own)
        key, item = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]
        self.there = np.zeros(1 << 22, dtype=bool)
        self.there[(key >> _U(42)).astype(np.int64)] = True

    def keys(self, c: int, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of windows of class c, sample by sample; start: of each in the words h; end: where its row ends."""
        n = self.least[c]
        size = np.minimum(n, end - start)
        mult = words.seeded(12, POSITIONS) | _U(1)
        for walk in range(WALKS):
            at = (self.where[walk] * steps(n)).astype(np.int64)
            seen = np.zeros((steps(n), len(start)), dtype=_U)
            p = np.zeros(len(start), dtype=np.int64)
            for j in range(steps(n)):
                sym = np.where(p < size, h[np.minimum(start + p, len(h) - 1)], _U(0))
                seen[j] = sym
                p += ((sym * self.walks[walk, j]) >> _U(63)).astype(np.int64)
            for s in range(SAMPLES):
                total = np.full(len(start), (c * WALKS + walk) * SAMPLES + s, dtype=_U)
                for m, j in zip(mult, at[s], strict=True):
                    total += seen[j] * m
                yield words.mix(total)


def steps(n: int) -> int:
    return max(1, int(1.9 * n))


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words, by its first word."""
    if len(h) < width:
        return np.zeros(0, dtype=_U)
    mult = words.seeded(8, width) | _U(1)
    total = np.zeros(len(h) - width + 1, dtype=_U)
    for j in range(width):
        total += h[j : len(h) - width + 1 + j] * mult[j]
    return words.mix(total)


def windows(items: Items, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, start) of the windows that shared runs align; a passage cut off at its row's start begins there."""
    found = []
    for width, (runs, item, pos) in items.runs.items():
        g = run_hashes(h, width)
        if not len(g):
            continue
        same = row[: len(g)] == row[width - 1 :]
        table = np.zeros(1 << 20, dtype=bool)
        table[(runs >> _U(44)).astype(np.int64)] = True
        at = np.flatnonzero(table[(g >> _U(44)).astype(np.int64)] & same)
        lo, hi = np.searchsorted(runs, g[at], "left"), np.searchsorted(runs, g[at], "right")
        count = hi - lo
        which = np.repeat(np.arange(len(at)), count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        found.append(np.stack([items.group[item[entry]], at[which] - pos[entry], row[at[which]]], axis=1))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    out = np.unique(np.concatenate(found), axis=0)
    out[:, 1] = np.maximum(out[:, 1], np.searchsorted(row, out[:, 2]))
    out = np.unique(out[:, :2], axis=0)
    return out[:, 0], out[:, 1]


def candidates(items: Items, h: np.ndarray, end: np.ndarray, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, start) pairs that meet in a table; end: of each window's row, in words."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    for c in np.unique(group):
        own = np.flatnonzero(group == c)
        for key in items.keys(int(c), h, start[own], end[own]):
            at = np.flatnonzero(items.there[(key >> _U(42)).astype(np.int64)])
            lo, hi = np.searchsorted(items.key, key[at], "left"), np.searchsorted(items.key, key[at], "right")
            count = hi - lo
            entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            if len(entry):
                found.append(np.unique(np.stack([items.item[entry], start[own][np.repeat(at, count)]], axis=1), axis=0))
    out = np.unique(np.concatenate(found), axis=0)
    return out[:, 0], out[:, 1]


def distance(a: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of a to any stretch of text (free ends in text)."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    ramp = np.arange(len(text) + 1)
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def _search(docs: DataFrame, items: Items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def pools(parted: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, hashes, rows) of about POOL words each."""
        ids, hashes, rows, n = [], [], [], 0
        for batch in parted:
            key = shared.ints(batch.column("id"))
            for b in words.batches(batch.column("text")):
                ids.append(key[b.first : b.last])
                hashes.append(b.hash)
                rows.append(b.row + n)
                n += b.last - b.first
                if sum(map(len, hashes)) >= POOL:
                    yield np.concatenate(ids), np.concatenate(hashes), np.concatenate(rows)
                    ids, hashes, rows, n = [], [], [], 0
        if n:
            yield np.concatenate(ids), np.concatenate(hashes), np.concatenate(rows)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for ids, h, row in pools(parted):
            group, start = windows(own, h, row)
            if not len(group):
                continue
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
            item, start = candidates(own, h, cut[row[start] + 1], group, start)
            best: dict[tuple[int, int], int] = {}
            done: dict[tuple[int, int], int] = {}
            for i, s in zip(item.tolist(), start.tolist(), strict=True):
                r, k, n = int(row[s]), int(own.k[i]), int(own.n[i])
                if done.get((i, r), -1) > s or best.get((r, i)) == 0:
                    continue  # a stretch compared before holds this one
                done[i, r] = s + k
                a, z = max(int(cut[r]), s - 2 * k), min(int(cut[r + 1]), s + n + 2 * k)
                d = distance(own.words[i], h[a:z])
                if d <= k:
                    best[r, i] = min(d, best.get((r, i), d))
            if best:
                keys = list(best)
                at = [i for _, i in keys]
                yield pa.record_batch({"doc_id": pa.array(ids[[r for r, _ in keys]]), "item_id": pa.array(own.ids[at]), "edits": pa.array([best[x] for x in keys], pa.int32()), "item_words": pa.array(own.n[at].astype(np.int32))})

    return docs.mapInArrow(run, "doc_id long, item_id long, edits int, item_words int")


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """A row for each document and item that contaminates it: doc_id, item_id, edits (the least), item_words."""
    docs = shared.with_id(docs, key, text).filter("id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        own = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), ratio)
        part = _search(docs, own)
        if blocks > 1:
            part = shared.materialize(part)
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("item_words").alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its columns, without contaminated documents; rows without a doc_id stay."""
    found = matches(docs, benchmark, key, text).select(F.col("doc_id").alias("__id")).distinct()
    return docs.withColumn("__id", F.col(key).cast("long")).join(found, "__id", "left_anti").select(*docs.columns)
