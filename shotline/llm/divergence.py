"""Source divergence audit: how the words of each source of a language differ from the other sources' and the language's.

Identical texts of a language are collapsed first (by SHA-256): how often each source has a text is counted with partial
counts before the shuffle, and each distinct text is tokenized once; its word counts, and one document for each distinct
word, are added to its sources as often as these have it.  Words in enough documents of their language are kept.  Pairs of
sources are then compared on sparse lists of word counts: words that neither source has have one closed form, words of
one only need a sorted list, and words of both are visited.  Sources are dealt to blocks and words to parts, so that a task holds
two blocks of sources over one part of the words; only sums travel.

A word is a run of characters other than ASCII non-letters; only A to Z are lower-cased.  Null text, lang and source count as
empty.  A source without kept words is compared like any other; in a language without kept words every pair's value is 0.
Repeated rows count as often as they occur.  An empty table gives no rows.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.llm import shared

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text from which its words are taken one by one rather than as a list.
LONG = 1 << 22
#: Counts that a task holds before it sends them on.
HELD = 500_000
#: Sources of a block, and counts of a part of the words, on average.
BLOCK = 128
PART = 200_000
UNIT, PRIOR = 1_000_000_000, 5


def words_of(text: bytes) -> Counter[bytes]:
    text = text.translate(LOWER)
    return Counter(TERM.findall(text) if len(text) < LONG else (m.group() for m in TERM.finditer(text)))


def add_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, source, n, text), equal keys side by side -> (lang, term, source, count, docs), summed as far as HELD allows; the last three are lists, so that a word travels once for all its sources."""
    held: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}
    size, before, words = 0, None, Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in {k[0] for k in held}:
            own = [(source, counts, docs) for (x, source), (counts, docs) in held.items() if x == lang]
            coded = pa.array([t for _, counts, _ in own for t in counts], pa.binary()).dictionary_encode()
            code = np.asarray(coded.indices)
            order = pa.array(np.argsort(code, kind="stable"))
            at = pa.array(np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))), pa.int32())
            listed = lambda x, kind, at=at, order=order: pa.ListArray.from_arrays(at, pa.array(x, kind).take(order))
            yield pa.record_batch({
                "lang": pa.array([lang] * len(coded.dictionary), pa.string()), "term": coded.dictionary.cast(pa.string()), "source": listed([s for s, counts, _ in own for _ in counts], pa.string()),
                "count": listed([c for _, counts, _ in own for c in counts.values()], pa.int64()), "docs": listed([d for _, _, docs in own for d in docs.values()], pa.int64()),
            })
        held.clear()

    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        for lang, key, source, n, text in zip(b.column("lang").to_pylist(), b.column("key").to_pylist(), b.column("source").to_pylist(), b.column("n").to_pylist(), texts, strict=True):
            if (lang, key) != before:
                before, words = (lang, key), words_of(text.as_py())
            counts, docs = held.setdefault((lang, source), ({}, {}))
            size -= len(counts)
            for term, c in words.items():
                counts[term] = counts.get(term, 0) + c * n
                docs[term] = docs.get(term, 0) + n
            size += len(counts)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) over all documents."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "key", "source").agg(F.count("*").alias("n"))
    distinct = rows.groupBy("lang", "key").agg(F.first("text").alias("text"))
    each = distinct.join(copies, ["lang", "key"]).select("lang", "key", "source", "n", "text")
    packed = each.mapInArrow(add_terms, "lang string, term string, source array<string>, count array<long>, docs array<long>").repartition("lang", "term")
    found = packed.select("lang", "term", F.explode(F.arrays_zip("source", "count", "docs")).alias("x")).select("lang", "term", "x.source", "x.count", "x.docs")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact; decimals where a long might not hold it."""
    short = F.lit(UNIT).cast("long") * (count + PRIOR)
    below = total + PRIOR * terms
    call = lambda a, b: F.call_function("div", a, b)
    wide = call((count.cast("decimal(38,0)") + PRIOR) * F.lit(UNIT), below.cast("decimal(38,0)"))
    return F.when(below > 0, F.when(count < 9_000_000_000, call(short, below)).otherwise(wide) + 1).otherwise(0)


def compare(table: pa.Table) -> pa.Table:
    """Entries (gid, tid, p, block, lo, hi) of two blocks over a part of the words -> (a, b, value, terms): sums over the words that a or b has.

    An entry with tid -1 is a source's mark: its p is that of words it doesn't have.
    """
    col = {c: shared.ints(table.column(c).combine_chunks()) for c in ("gid", "tid", "p", "block", "lo", "hi")}
    lo, hi = int(col["lo"][0]), int(col["hi"][0])
    order = np.lexsort((col["tid"], col["gid"]))
    gid, tid, p, block = (col[c][order] for c in ("gid", "tid", "p", "block"))
    mark = tid < 0
    sources, none, own = gid[mark], p[mark], block[mark]
    gid, p = gid[~mark], p[~mark]
    terms, at = np.unique(tid[~mark], return_inverse=True)
    begin = np.searchsorted(gid, sources)
    end = np.searchsorted(gid, sources, "right")
    whose = np.repeat(np.arange(len(sources)), end - begin)
    out = []
    right = np.flatnonzero(own == hi)
    for a in np.flatnonzero(own == lo):
        others = right[right > a] if lo == hi else right
        if not len(others):
            continue
        mine = slice(begin[a], end[a])
        full, has = np.full(len(terms), none[a]), np.zeros(len(terms), dtype=bool)
        full[at[mine]], has[at[mine]] = p[mine], True
        here = full[at]
        both = has[at]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        per = lambda x, s=others: (c := upto(x))[end[s]] - c[begin[s]]
        theirs = per(np.abs(here - p))  # words of the other, whether or not of a
        shared_words = per(both.astype(np.int64))
        again = per(np.where(both, np.abs(here - none[whose]), 0))
        ordered = np.sort(p[mine])
        sums, below = upto(ordered), np.searchsorted(ordered, none[others])
        alone = none[others] * below - sums[below] + (sums[-1] - sums[below]) - none[others] * (len(ordered) - below)
        out.append((np.full(len(others), sources[a]), sources[others], theirs + alone - again, (end - begin)[others] + len(ordered) - shared_words))
    a, b, value, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"a": a, "b": b, "value": value, "terms": n})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by distance ("pair"), and the words that a
    source has most in excess of its language ("term", the first top), each by falling value, then item."""
    spark = docs.sparkSession
    counts = shared.materialize(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = shared.materialize(kept.select("lang", "term", "lang_count", F.monotonically_increasing_id().alias("tid")))
    entries = shared.materialize(counts.select("lang", "source", "term", "count").join(kept, ["lang", "term"]))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    parts = entries.groupBy("lang").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    groups = docs.select(text("lang"), text("source")).distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left").join(parts, "lang", "left").join(blocks, "lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    groups = groups.select("lang", "source", zero("n").alias("n"), zero("v").alias("v"), zero("lang_n").alias("lang_n"), F.coalesce("parts", F.lit(1)).alias("parts"), "blocks")
    groups = groups.withColumn("none", share(F.lit(0).cast("long"), F.col("n"), F.col("v")).cast("long")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = shared.materialize(groups.withColumn("gid", F.monotonically_increasing_id()))

    own = entries.join(groups, ["lang", "source"])
    own = own.withColumn("p", share(F.col("count"), F.col("n"), F.col("v")).cast("long"))
    over = own.withColumn("q", share(F.col("lang_count"), F.col("lang_n"), F.col("v")).cast("long")).filter((F.col("count") > 0) & (F.col("p") > F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    words = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)

    sent = own.select("lang", "gid", "tid", "p", "block", "blocks", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("slot"))
    marks = groups.select("lang", "gid", F.lit(-1).cast("long").alias("tid"), F.col("none").alias("p"), "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot"))
    both = sent.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("lang", "gid", "tid", "p", "block", "slot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    some = both.groupBy("lang", "lo", "hi", "slot").applyInArrow(compare, "a long, b long, value long, terms long")
    pairs = some.groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    twice = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "value", "terms").select("e.a", "e.b", "value", "terms")
    one = groups.select(F.col("gid").alias("a"), "lang", "source", "v", F.col("none").alias("none_a"))
    two = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"), F.col("none").alias("none_b"))
    far = twice.join(one, "a").join(two, "b").withColumn("value", F.col("value") + (F.col("v") - F.col("terms")) * F.abs(F.col("none_a") - F.col("none_b")))
    near = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return near.unionByName(words).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
