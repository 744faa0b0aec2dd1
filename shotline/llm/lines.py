"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line is a piece of a text between line feeds; its set is its distinct words (see words).  A line is removed if an
earlier line of the corpus, by (doc_id, line number), has a Jaccard similarity of at least 0.8 with it.  Lines
without a word always stay; those with fewer than least distinct words too, but report and dedup take all.

Words are ordered by rarity (counts over all documents, of hash classes that grow with them; equal counts by hash), so that
similar lines share a word among the first |x| - ceil(0.8 |x|) + 1 of each.  Lines that share such a word are
candidates if length, position and a 128-bit parity signature allow the similarity; all tests are lossless.  Sets too
small to be similar to any but an equal one (up to three words at 0.8) need no candidates: equal sets are one set.
Candidates are verified on their whole sets, with words as 64-bit hashes.

Null or empty texts have no lines to remove.  Repeated doc_ids: their rows count as one document with the lines of
each.  Rows without a doc_id stay as they are and match nothing.  Equal lines differ by (doc_id, line number); where
even that is equal, in repeated rows, both stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import setjoin, shared, words

#: Classes of words that are counted, at least and at most: four documents a class between the two.
COUNTERS = (1 << 17, 1 << 24)
ENTRY = np.dtype([("node", "<u4"), ("size", "<u2"), ("pos", "<u2"), ("set", "<u8"), ("bits", "<u8", (2,))])
#: Lines under one word that a task takes at most; words with more are dealt out as pairs of blocks.
NODE_LINES = 100_000
#: A line that is more than one in HOT of all lines is joined by broadcast, so that no task gets all its places.
HOT = 1000


class Lines:
    """The sets of a tokenised batch: distinct words by line, for lines with at least least of them."""

    def __init__(self, b: words.Batch, least: int):
        breaks = np.flatnonzero(b.buf == 10)
        before = np.searchsorted(breaks, b.offsets)  # line feeds before each row
        line = np.searchsorted(breaks, b.starts) + b.row  # a key that grows with row and line
        self.hash, key = words.distinct(b.hash, line)
        own, first, self.size = np.unique(key, return_index=True, return_counts=True)
        keep = self.size >= least
        self.row = np.searchsorted(before[1:] + np.arange(len(before) - 1), own, "left")
        self.line = own - self.row - before[self.row]
        self.first = first
        kept = np.repeat(keep, self.size)
        self.hash = self.hash[kept]
        self.row, self.line, self.size = self.row[keep], self.line[keep], self.size[keep]
        self.first = np.cumsum(self.size) - self.size
        self.index = np.repeat(np.arange(len(self.size)), self.size)
        self.set = words.mix(words.row_sums(words.mix(self.hash), self.index, len(self.size)) + self.size.astype(np.uint64))


def _each(parted: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, Lines]]:
    for batch in parted:
        ids = shared.ints(batch.column("id"))
        for b in words.batches(batch.column("text")):
            yield ids[b.first : b.last], Lines(b, least)


TALLY = np.dtype([("k", "<i4"), ("n", "<i8")])


def line_rows(docs: DataFrame, least: int, paired: int) -> tuple[DataFrame, np.ndarray]:
    """((set, doc, line) of every line with at least least distinct words, word counts), from one pass over the texts.

    Word counts: in how many lines of at least paired distinct words the words of each hash class are; the number of
    classes is a power of two.
    """
    classes, n = COUNTERS[0], docs.count()
    while classes < min(COUNTERS[1], n // 4):
        classes *= 2
    schema = pa.schema([("set", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("tally", pa.binary())])

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes, dtype=np.int64)
        for ids, x in _each(parted, least):
            words_of = x.hash[np.repeat(x.size >= paired, x.size)]
            total += np.bincount((words_of & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
            yield pa.record_batch([shared.u64(x.set), pa.array(ids[x.row]), pa.array(x.line.astype(np.int32)), pa.nulls(len(x.set), pa.binary())], schema=schema)
        at = np.flatnonzero(total)
        tally = np.zeros(len(at), dtype=TALLY)
        tally["k"], tally["n"] = at, total[at]
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.record_batch([*none, pa.array([tally.tobytes()], pa.binary())], schema=schema)

    def add(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes, dtype=np.int64)
        for b in parted:
            for x in b.column("tally"):
                tally = np.frombuffer(x.as_py(), dtype=TALLY)
                total[tally["k"]] += tally["n"]
        at = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    made = shared.materialize(docs.mapInArrow(run, "set long, doc long, line int, tally binary"))
    table = made.filter("tally is not null").select("tally").mapInArrow(add, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(classes, dtype=np.int64)
    counts[np.asarray(table.column("k"))] = np.asarray(table.column("n"))
    return made.filter("tally is null").select("set", "doc", "line"), counts


def _prefixes(x: Lines, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a batch's distinct lines, and a node's estimated lines for each entry."""
    _, one = np.unique(x.set, return_index=True)
    mine = np.zeros(len(x.set), dtype=bool)
    mine[one] = True
    bits = np.zeros((len(x.set), 2), dtype=np.uint64)
    place = words.mix(x.hash) >> np.uint64(57)
    np.bitwise_xor.at(bits, (x.index, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    n = counts[(x.hash & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = words.order_by_row(x.index, np.minimum(n, (1 << 22) - 1).astype(np.uint64) << np.uint64(42), x.hash)
    node = ((x.hash >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[order]
    pos = np.arange(len(order)) - x.first[x.index]
    prefix = (x.size - np.ceil(t * x.size - 1e-9) + 1)[x.index]
    own = np.flatnonzero((pos < prefix) & mine[x.index])
    i, pos = x.index[own], pos[own]
    out = np.zeros(len(own), dtype=ENTRY)
    out["node"], out["set"], out["bits"] = node[own], x.set[i], bits[i]
    out["size"], out["pos"] = np.minimum(x.size[i], 65535), np.minimum(pos, 65535)
    return out, n[order][own]


def _allowed(e: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Whether two entries of a node, i not the larger, may be lines of similarity t that share no word before it.

    Tests: position (of the smaller within its indexed prefix, and what is left of both) and signature.
    """
    a, b = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
    left, right = e["pos"][i].astype(np.int64), e["pos"][j].astype(np.int64)
    need = np.ceil(t / (1 + t) * (a + b) - 1e-6).astype(np.int64)
    ok = (left <= a - np.ceil(2 * t / (1 + t) * a - 1e-6)) & (np.minimum(a - left, b - right) >= need)
    i, j, huge = i[ok], j[ok], b[ok] == 65535
    differ = setjoin.POPCOUNT(e["bits"][i] ^ e["bits"][j]).sum(axis=1, dtype=np.int64)
    out = ok.copy()
    out[ok] = huge | (differ <= a[ok] + b[ok] - 2 * need[ok])
    return out | (b == 65535)


def _roots(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest member of each entry's linked set; the paths walked are cut short."""
    found = root[at]
    while (up := root[found] != found).any():
        found[up] = root[found[up]]
    root[at] = found
    return found


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Link entries i with entries j, in place."""
    while len(i):
        a, b = _roots(root, i), _roots(root, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def smallest(t: float) -> int:
    """The least size of a set that a different set can be similar to: with one word more, n / (n + 1) >= t."""
    n = 1
    while n < t * (n + 1) - 1e-9:
        n += 1
    return n


def candidates(docs: DataFrame, counts: np.ndarray, t: float, least: int) -> DataFrame:
    """Groups (comp, set) of lines that may be similar; a similar pair shares a group.

    A group is what candidate pairs link under one word.  It is named by its sets, so that lines which meet under several
    words, without others in between, make one group.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    parts = shared.partitions(docs, 64)
    pack = shared.blobs(ENTRY, parts)

    def entries(parted: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, x in _each(parted, least):
            e, n = _prefixes(x, sent.value, t)
            part = words.mix(e["node"].astype(np.uint64)) % np.uint64(parts)
            hot = n > NODE_LINES * 8  # a class of words counts more than any word in it
            yield part[~hot], e[~hot]
            blocks = np.ceil(n[hot] / (NODE_LINES * 8)).astype(np.int64)
            for k in np.unique(blocks):
                own = e[hot][blocks == k]
                a = (own["set"] % np.uint64(k)).astype(np.int64)
                for j in range(k):
                    pair = np.minimum(a, j) * k + np.maximum(a, j)
                    yield (words.mix(own["node"].astype(np.uint64)) + words.mix(pair.astype(np.uint64))) % np.uint64(parts), own

    def search(key: tuple, table: pa.Table) -> pa.Table:
        e = shared.unpack(table, ENTRY)
        e = e[np.lexsort((e["set"], e["size"], e["node"]))]
        again = np.zeros(len(e), dtype=bool)
        again[1:] = (e["set"][1:] == e["set"][:-1]) & (e["node"][1:] == e["node"][:-1])
        e = e[~again]
        root = np.arange(len(e))
        active, step = np.arange(len(e) - 1), 1
        while len(active):
            active = active[active + step < len(e)]
            j = active + step
            live = (e["node"][active] == e["node"][j]) & (e["size"][active] >= t * e["size"][j] - 1e-6)
            active, j = active[live], j[live]
            ok = _allowed(e, active, j, t)
            _unite(root, active[ok], j[ok])
            step += 1
        root = _roots(root, np.arange(len(e)))
        linked = np.bincount(root, minlength=len(e))[root] > 1
        order = np.argsort(root[linked], kind="stable")
        e, root = e[linked][order], root[linked][order]
        own, index = np.unique(root, return_inverse=True)
        comp = words.mix(words.row_sums(words.mix(e["set"]), index, len(own)))[index] if len(e) else e["set"]
        return pa.table({"comp": shared.u64(comp), "set": shared.u64(e["set"])})

    packed = docs.mapInArrow(lambda x: pack(entries(x)), "part int, blob binary")
    return packed.groupBy("part").applyInArrow(search, "comp long, set long").distinct()


def _sets(docs: DataFrame, needed: np.ndarray, least: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(needed)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, x in _each(parted, least):
            one, at = np.unique(x.set, return_index=True)
            at = at[setjoin.maybe_in(sent.value, one)]
            if len(seen) < 500_000:  # spares the shuffle most repetitions
                at = np.array([i for i in at.tolist() if x.set[i] not in seen], dtype=np.int64)
                seen.update(x.set[at].tolist())
            yield pa.record_batch({"set": shared.u64(x.set[at]), "tokens": pa.array([x.hash[x.first[i] : x.first[i] + x.size[i]].tobytes() for i in at], pa.binary())})

    return docs.mapInArrow(run, "set long, tokens binary")


def later_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, least: int = 5) -> DataFrame:
    """(doc long, line int) of every line that an earlier similar line makes superfluous; lines count from 0."""
    docs = shared.with_id(docs, key, text).filter(F.col("id").isNotNull())
    paired = max(least, smallest(similarity)) if similarity < 1 else least
    every, counts = line_rows(docs, least, paired)
    groups = shared.materialize(candidates(docs, counts, similarity, paired))
    firsts = every.groupBy("set").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    ours = groups.select("set").distinct()
    first = firsts.join(ours, "set", "left_semi").select("set", "first.doc", "first.line")
    sets = _sets(docs, setjoin.presence_filter(groups, "set"), paired).groupBy("set").agg(F.first("tokens").alias("tokens"))
    rows = setjoin.dealt(groups).join(sets.join(first, "set"), "set")

    def judge(data: dict[str, np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((data["line"], data["doc"]))
        tokens = [tokens[i] for i in order]
        late = np.zeros(len(order), dtype=bool)
        for lo, hi, same in setjoin.similar(tokens, similarity):
            late[lo:hi] = np.tril(same, lo - 1).any(axis=1)
        return pa.record_batch({"set": pa.array(data["set"][order[late]])})

    late = setjoin.compare(rows, shared.partitions(docs, 16), judge, "set long").distinct().withColumn("late", F.lit(True))
    gone = firsts.join(late, "set", "left").filter("n > 1 or late").select("set", "first", "late", "n")
    gone = shared.materialize(gone)
    total = every.count()
    often = gone.filter(F.col("n") * HOT > total)  # fewer than HOT lines, whatever the corpus
    extra = lambda found: found.filter(F.col("late").isNotNull() | (F.struct("doc", "line") > F.col("first"))).select("doc", "line")
    hot = extra(every.join(F.broadcast(often), "set"))
    rest = every.join(F.broadcast(often.select("set")), "set", "left_anti")
    found = hot.unionByName(extra(rest.join(gone.filter(F.col("n") * HOT <= total), "set")))
    return found.distinct()


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, least: int = 1) -> DataFrame:
    """A row for each doc_id that has text: doc_id, n_lines, n_removed, removed_lines (line numbers from 0, sorted)."""
    lines = docs.select(F.col(key).cast("long").alias("doc_id"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n_lines"))
    lines = lines.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    removed = later_matches(docs, key, text, similarity, least).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    out = lines.join(removed, F.col("doc") == F.col("doc_id"), "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(gone).alias("n_removed"), gone.alias("removed_lines"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, least: int = 1) -> DataFrame:
    """docs with its columns, later matching lines cut out of the texts.

    A document that loses every line, or keeps only blank ones, goes; one that was blank before stays.
    """
    removed = later_matches(docs, key, text, similarity, least).groupBy("doc").agg(F.collect_set("line").alias("__gone"))
    hit = docs.withColumn("__id", F.col(key).cast("long")).join(removed.withColumnRenamed("doc", "__id"), "__id", "left")
    pieces = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    out = hit.withColumn("__new", F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    out = out.filter(F.col("__gone").isNull() | (F.trim(F.regexp_replace("__new", r"\s+", " ")) != ""))
    return out.select(*[F.col("__new").alias(c) if c == text else F.col(c) for c in docs.columns])
