"""N-gram Jaccard join by chosen paths.

The set of a text is its distinct five-word shingles (see words; a text of one to four words has all of them as its
only shingle).  Texts with equal sets are one class, so copies cost nothing.  Each run draws a hash function; a set x
chooses the tokens whose hash is below 1 / (0.8 |x|), 1.25 on average, and similar sets choose a common one with
probability of at least 1 - exp(-1) = 0.63, the case of a set within the other.  Buckets (paths of chosen tokens) with more than a stated number of
sets are split again on tokens drawn anew for that path, up to a stated depth; small ones are compared by brute
force, first by 16 min-hashes, then on whole sets.  The number of runs follows from the target recall of a pair at
the threshold whose buckets are all split to the last level, where it needs a common choice at each.

Links are pairs of different classes with a similarity of at least 0.8.  They are counted where they are found and
never listed, so a group of n near copies costs n rows, not n squared: a pair is counted in the first of the groups
that its two sets share.

Null or empty texts, or such without a word, have no set: they link to nothing, and each is its own class.  Rows
without a doc_id take no part.  Of repeated doc_ids the set with the greatest hash counts, the same one in every run;
keep_one keeps one row of such a doc_id, the one with the greatest hash of all its columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import setjoin, shared, words

SKETCH = 16
ENTRY = np.dtype([("node", "<u8"), ("set", "<u8"), ("size", "<u4"), ("sketch", "<u2", (SKETCH,))])
#: Paths that are split at most; the largest buckets come first, so this bounds a broadcast and drops nothing.
HEAVY = 20_000
#: Bits of their bitmap.
HEAVY_BITS = 1 << 20
_U = np.uint64
_ALL = 2.0**64


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair at the threshold has been found with probability recall."""
    once = 1 - math.exp(-1)  # at worst: the smaller set is within the larger, which chooses 1 / similarity tokens, shared ones once
    return math.ceil(math.log(1 - recall) / math.log(1 - once**depth))


class Sets:
    """Shingle sets of a tokenised batch; rows without any are left out."""

    def __init__(self, b: words.Batch, width: int):
        n = b.last - b.first
        self.hash, self.index = words.shingles(b.hash, b.row, n, width)
        self.size = np.bincount(self.index, minlength=n)
        self.row = np.flatnonzero(self.size)
        total = words.row_sums(words.mix(self.hash), self.index, n) + self.size.astype(_U)
        self.index = np.searchsorted(self.row, self.index)
        self.size, self.set = self.size[self.row], words.mix(total)[self.row]
        self.first = np.cumsum(self.size) - self.size

    def take(self, at: np.ndarray) -> None:
        """Keep the sets of these (sorted) numbers only."""
        keep = np.zeros(len(self.size), dtype=bool)
        keep[at] = True
        own = keep[self.index]
        self.hash = self.hash[own]
        self.row, self.size, self.set = self.row[keep], self.size[keep], self.set[keep]
        self.index = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size


def _each(parted: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, Sets]]:
    for batch in parted:
        ids = shared.ints(batch.column("id"))
        for b in words.batches(batch.column("text")):
            x = Sets(b, width)
            if len(x.row):
                yield ids[b.first : b.last], x


def memberships(docs: DataFrame, width: int) -> DataFrame:
    """(doc, set) of every document that has a set."""

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _each(parted, width):
            yield pa.record_batch({"doc": pa.array(ids[x.row]), "set": shared.u64(x.set)})

    return docs.mapInArrow(run, "doc long, set long")


class Heavy:
    """A set of paths.  A bitmap tells most others apart, so that a lookup costs no sort of the whole set."""

    def __init__(self, paths: np.ndarray):
        self.paths = np.sort(paths)
        at = self.paths & _U(HEAVY_BITS - 1)
        self.bits = np.zeros(HEAVY_BITS // 64, dtype=_U)
        np.bitwise_or.at(self.bits, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))

    def has(self, node: np.ndarray) -> np.ndarray:
        out = setjoin.maybe_in(self.bits, node)
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.paths, node[at]), len(self.paths) - 1)
            out[at] = self.paths[place] == node[at]
        return out


def _paths(x: Sets, runs: int, heavy: Heavy, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(set numbers, leaf paths, depth): paths in heavy are split once more.

    A set chooses the tokens whose hash, drawn anew for each path, is below its limit; each leads to a child path.
    """
    most = np.minimum(_ALL / (similarity * x.size), _ALL * (1 - 1e-12)).astype(_U)
    limit = most[x.index]
    for run in words.seeded(5, runs):
        h = words.mix(x.hash ^ run)
        at = np.flatnonzero(h < limit)
        own, node, depth = x.index[at], words.mix(h[at] + _U(1)), 1
        while len(own):
            split = heavy.has(node)
            yield own[~split], node[~split], depth
            own, node, depth = own[split], node[split], depth + 1
            if len(own):
                size = x.size[own]
                token = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x.first[own], size)
                which = np.repeat(np.arange(len(own)), size)
                h = words.mix(x.hash[token] ^ node[which])
                at = np.flatnonzero(h < most[own][which])
                own, node = own[which[at]], words.mix(h[at] + _U(1))


def _sketches(x: Sets) -> np.ndarray:
    out = np.zeros((len(x.size), SKETCH), dtype=np.uint16)
    for k, m in enumerate(words.seeded(6, SKETCH) | _U(1)):
        out[:, k] = np.minimum.reduceat((x.hash * m) >> _U(32), x.first) & _U(0xFFFF)
    return out


def _buckets(docs: DataFrame, width: int, similarity: float, runs: int, limit: int, depth: int) -> DataFrame:
    """Split level by level: (node, set) counts name the heavy paths, which the next level's scan splits."""
    heavy = np.zeros(0, dtype=_U)
    context = docs.sparkSession.sparkContext
    for level in range(1, depth):
        sent = context.broadcast(Heavy(heavy))

        def nodes(parted: Iterator[pa.RecordBatch], sent=sent, level=level) -> Iterator[pa.RecordBatch]:
            for _, x in _each(parted, width):
                _, one = np.unique(x.set, return_index=True)
                x.take(np.sort(one))
                for own, node, at in _paths(x, runs, sent.value, similarity):
                    if at == level:
                        yield pa.record_batch({"node": shared.u64(node), "set": shared.u64(x.set[own])})

        counts = docs.mapInArrow(nodes, "node long, set long").groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        found = counts.orderBy(F.desc("n"), "node").limit(HEAVY).select("node").toArrow().column("node")
        if not len(found):
            break
        heavy = np.concatenate([heavy, np.asarray(found).view(_U)])
    sent = context.broadcast(Heavy(heavy))
    parts = shared.partitions(docs, 64)
    pack = shared.blobs(ENTRY, parts, 500_000)

    def entries(parted: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, x in _each(parted, width):
            _, one = np.unique(x.set, return_index=True)
            x.take(np.sort(one))
            sketch = _sketches(x)
            for own, node, _ in _paths(x, runs, sent.value, similarity):
                e = np.zeros(len(own), dtype=ENTRY)
                e["node"], e["set"], e["size"], e["sketch"] = node, x.set[own], x.size[own], sketch[own]
                yield node % _U(parts), e

    return docs.mapInArrow(lambda x: pack(entries(x)), "part int, blob binary")


def candidates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.9999, limit: int = 200, depth: int = 3) -> DataFrame:
    """Groups (comp, set) of sets that may be similar, from the brute force of the leaves by size and sketch."""
    runs = runs_for(recall, similarity, depth)
    slack = 4.5 * math.sqrt(similarity * (1 - similarity) * SKETCH)
    least = max(1, math.floor(similarity * SKETCH - slack))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        e = shared.unpack(table, ENTRY)
        e = e[np.lexsort((e["set"], e["size"], e["node"]))]
        again = np.zeros(len(e), dtype=bool)
        again[1:] = (e["set"][1:] == e["set"][:-1]) & (e["node"][1:] == e["node"][:-1])
        e = e[~again]
        node, size, sketch = (np.ascontiguousarray(e[k]) for k in ("node", "size", "sketch"))
        found = np.zeros(len(e), dtype=bool)
        active, step = np.arange(len(e) - 1), 1
        while len(active):
            active = active[active + step < len(e)]
            j = active + step
            live = (node[active] == node[j]) & (size[active] >= similarity * size[j] - 1e-6)
            active, j = active[live], j[live]
            ok = (sketch[active] == sketch[j]).sum(axis=1) >= least
            found[active[ok]], found[j[ok]] = True, True
            step += 1
        e = e[found]
        which, index = np.unique(e["node"], return_inverse=True)
        comp = words.mix(words.row_sums(words.mix(e["set"]), index, len(which)))[index] if len(e) else e["set"]
        return pa.table({"comp": shared.u64(comp), "set": shared.u64(e["set"])})

    packed = _buckets(docs, width, similarity, runs, limit, depth)
    return packed.groupBy("part").applyInArrow(search, "comp long, set long").distinct()


def _tokens(docs: DataFrame, needed: np.ndarray, width: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(needed)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _each(parted, width):
            one, at = np.unique(x.set, return_index=True)
            at = at[setjoin.maybe_in(sent.value, one)]
            yield pa.record_batch({"set": shared.u64(x.set[at]), "tokens": pa.array([x.hash[x.first[i] : x.first[i] + x.size[i]].tobytes() for i in at], pa.binary())})

    return docs.mapInArrow(run, "set long, tokens binary").groupBy("set").agg(F.first("tokens").alias("tokens"))


def links(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.9999, limit: int = 200, depth: int = 3) -> DataFrame:
    """Per set with links: (set, n_links, partner): links found in each group, and edges that connect the same sets.

    A set has several rows.  The edges (set, partner) have the connected components of all links, and a set at most
    one for each group.
    """
    groups = candidates(docs, width, similarity, recall, limit, depth)
    groups = shared.checkpoint(groups)
    comps = groups.groupBy("set").agg(F.sort_array(F.collect_list("comp")).alias("comps"))
    sets = _tokens(docs, setjoin.presence_filter(groups, "set"), width)
    rows = setjoin.dealt(groups).join(sets.join(comps, "set"), "set")

    def judge(data: dict[str, np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        comp, n, own = data["comp"][0], len(tokens), data["own"]
        lower = [x[x < comp] for x in data["comps"]]
        which, column = np.unique(np.concatenate(lower), return_inverse=True)
        before = np.zeros((n, len(which)), dtype=np.float32)
        before[np.repeat(np.arange(n), [len(x) for x in lower]), column] = 1
        across = data["a"][0] != data["b"][0]
        count, label = np.zeros(n, dtype=np.int64), np.arange(n)
        for lo, hi, same in setjoin.similar(tokens, similarity):
            same[np.arange(hi - lo), np.arange(lo, hi)] = False
            if across:
                same &= own[lo:hi, None] != own[None, :]
            new = same & (before[lo:hi] @ before.T == 0) if len(which) else same
            count[lo:hi] = new.sum(axis=1)
            for i in np.flatnonzero(same.any(axis=1)):
                near = np.append(np.flatnonzero(same[i]), i + lo)
                old = np.unique(label[near])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        keep = (count > 0) | (label != np.arange(n)) | np.isin(np.arange(n), label[label != np.arange(n)])
        return pa.record_batch({"set": pa.array(data["set"][keep]), "n_links": pa.array(count[keep]), "partner": pa.array(data["set"][label[keep]])})

    return setjoin.compare(rows, shared.partitions(docs, 16), judge, "set long, n_links long, partner long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) from edges (a, b): the least node of each connected component.

    Each round links every node's neighbours to the least of them, first all, then the greater ones, until nothing
    changes (alternating large and small stars); rows stay within a few times the edges.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = least.select("a", F.col("m").alias("b"))
        return joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).filter("a != b").distinct()

    e = shared.checkpoint(edges.filter("a != b").select("a", "b").distinct())
    state = None
    for _ in range(rounds):
        e = shared.checkpoint(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components haven't settled in {rounds} rounds")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """A row for each doc_id: doc_id, class_id, n_links, group_id.

    class_id: the least doc_id with the same set of shingles.  n_links: other classes linked to this one.  group_id:
    the least doc_id among all classes that links connect.
    """
    docs = shared.with_id(docs, key, text).filter(F.col("id").isNotNull())
    width = int(how.get("width", 5))
    member = memberships(docs, width).groupBy("doc").agg(F.max("set").alias("set"))
    found = shared.checkpoint(links(docs, **how))
    least = member.groupBy("set").agg(F.min("doc").alias("class_id"))
    counts = found.groupBy("set").agg(F.sum("n_links").alias("n_links"))
    names = shared.checkpoint(least.join(counts, "set"))  # only sets with links
    ends = found.select("set", "partner").filter("set != partner").distinct()
    pair = ends.join(names.select("set", F.col("class_id").alias("a")), "set").join(names.select(F.col("set").alias("partner"), F.col("class_id").alias("b")), "partner")
    roots = components(pair.select("a", "b"))
    linked = names.join(roots, names.class_id == roots.node, "left").select("set", "n_links", F.coalesce("root", "class_id").alias("group_id"))
    per_set = least.join(linked, "set", "left")
    every = docs.select(F.col("id").alias("doc_id")).distinct()
    out = every.join(member, F.col("doc") == F.col("doc_id"), "left").join(per_set, "set", "left")
    own = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", own).alias("group_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """docs with its columns, one document of each group: the one with the least doc_id.  Rows without a doc_id stay."""
    kept = classes(docs, key, text, **how).filter("doc_id = group_id").select(F.col("doc_id").alias("__id"))
    named = docs.withColumn("__id", F.col(key).cast("long"))
    found = named.filter("__id is not null").join(kept, "__id", "left_semi")
    out = found.groupBy("__id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__id", "__row.*")
    return out.unionByName(named.filter("__id is null")).select(*docs.columns)
