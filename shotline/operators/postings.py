"""F3 on a stored inverted index: texts are tokenised once, searches read the lists of the words they ask for.

The list of a token is cut into blocks of RANGE ids.  A block's ids are sorted and kept as differences, seven bits a byte; its least and
greatest id and their number stand beside it.  Files are sorted by token, so that Parquet's statistics skip what isn't asked for.  A search
starts from each query's rarest token and meets the other tokens' blocks range by range; a block is decoded only if a query needs it there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.functions import text as T
from shotline.operators.search import materialize, ranked, shared_dir

RANGE = 65_536
#: Queries that meet a range of ids in one task.
ASKS = 16_384
#: Words, or entries of lists, that a task sorts at once.
WORK = 1 << 20


class Index(NamedTuple):
    """lists: (token, range, least, greatest, n, ids); names: (doc, point_id) where ids of points aren't whole numbers."""

    lists: DataFrame
    names: DataFrame | None


def blobs(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary column: bytes of data from each begin to the next one."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    ends = np.append(begin * data.itemsize, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def encode(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Lists of rising numbers, one from each begin, as differences, seven bits a byte, low bits first; the high bit says that more follow."""
    d = np.diff(ids, prepend=0)
    d[begin] = ids[begin]
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(3):
        own = size > k
        out[at[own] + k] = ((d[own] >> (7 * k)) & 127) | np.where(size[own] > k + 1, 128, 0)
    return blobs(out, at[begin])


def decode(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8)
    last = raw < 128
    end = np.flatnonzero(last)
    first = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    place = np.arange(len(raw)) - np.repeat(first, end - first + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)) if len(end) else np.zeros(0, np.int64)


def pieces(batches: Iterator[pa.RecordBatch], weights: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose rows weigh WORK together, or are one row; an Arrow batch is bounded in rows alone."""
    for b in batches:
        upto = np.cumsum(np.asarray(weights(b).fill_null(0)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORK, "right")))
            yield b.slice(at, to - at)
            at = to


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words) -> (token, range, ids): each slice's distinct ids of a token in a range, as offsets."""
    for b in pieces(batches, lambda b: pc.list_value_length(b.column("words"))):
        words = b.column("words")
        size = np.asarray(words.value_lengths()).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        token, doc = np.asarray(coded.indices).astype(np.int64), np.repeat(np.asarray(b.column("doc")), size)
        if not len(token):
            continue
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc = token[new], doc[new]
        where = doc // RANGE
        head = np.ones(len(token), dtype=bool)
        head[1:] = (token[1:] != token[:-1]) | (where[1:] != where[:-1])
        first = np.flatnonzero(head)
        offsets = (doc - where * RANGE).astype(np.uint16)
        yield pa.record_batch({"token": coded.dictionary.take(pa.array(token[first])), "range": pa.array(where[first]), "ids": blobs(offsets, first)})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, range, size, parts) -> a row of the index each; size: bytes of the parts."""
    for b in pieces(batches, lambda b: pc.divide(b.column("size"), 2)):
        parts = b.column("parts")
        bytes_of = np.asarray(pc.binary_length(parts.flatten())).astype(np.int64) // 2
        row = np.repeat(np.repeat(np.arange(b.num_rows), np.asarray(parts.value_lengths())), bytes_of)
        key = np.unique(row * RANGE + np.frombuffer(b"".join(parts.flatten().to_pylist()), dtype=np.uint16))
        row, ids = key // RANGE, key % RANGE
        first = np.searchsorted(row, np.arange(b.num_rows))
        last = np.append(first[1:], len(row)) - 1
        start = np.asarray(b.column("range")) * RANGE
        yield pa.record_batch({
            "token": b.column("token"), "range": b.column("range"), "least": pa.array(start + ids[first]), "greatest": pa.array(start + ids[last]),
            "n": pa.array((last - first + 1).astype(np.int32)), "ids": encode(ids, first),
        })


def build(texts: DataFrame, path: str | None = None) -> Index:
    """Write the index of texts (point_id, text_blob) to path, or else to the shared folder.

    Ids that aren't whole numbers are numbered in their order.  Rows with a null id aren't indexed; a null text has no tokens.
    """
    spark = texts.sparkSession
    path = path or f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    rows = texts.filter("point_id is not null").select("point_id", T.words(F.col("text_blob")).alias("words"))
    if dict(texts.dtypes)["point_id"] in ("bigint", "int", "smallint", "tinyint"):
        rows = rows.select(F.col("point_id").cast("long").alias("doc"), "words")
    else:
        ordered = texts.filter("point_id is not null").select("point_id").distinct().repartitionByRange("point_id").sortWithinPartitions("point_id")
        ordered.select(F.monotonically_increasing_id().alias("doc"), "point_id").write.parquet(f"{path}/names")
        rows = rows.join(spark.read.parquet(f"{path}/names"), "point_id").select("doc", "words")
    parts = rows.mapInArrow(_lists, "token string, range long, ids binary").groupBy("token", "range").agg(F.sum(F.length("ids")).alias("size"), F.collect_list("ids").alias("parts"))
    lists = parts.mapInArrow(_merged, "token string, range long, least long, greatest long, n int, ids binary")
    lists.sortWithinPartitions("token", "range").write.parquet(f"{path}/lists")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """The index at path, as build wrote it; it outlives the session that built it."""
    names = None
    names_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/names")
    if names_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(names_path):
        names = spark.read.parquet(f"{path}/names")
    return Index(spark.read.parquet(f"{path}/lists"), names)


def match(index: Index, queries: DataFrame, k: int | None = 20) -> DataFrame:
    """Points that hold every token of a query (query_id, text); score 1 / (place by point_id).  k None: all of them."""
    asked = queries.select("query_id", T.tokens(F.col("text"), []).alias("t")).filter(F.size("t") > 0)
    asked = materialize(asked)
    used = asked.select(F.explode("t").alias("token")).distinct()
    lists = index.lists.join(used, "token", "left_semi")
    counts = lists.groupBy("token").agg(F.sum("n").alias("df"))
    known = asked.select("query_id", "t", F.explode("t").alias("token")).join(counts, "token")
    rarest = known.groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.first("t").alias("t"), F.count("*").alias("m")).filter(F.col("m") == F.size("t"))
    parts = max(1, -(-asked.count() // ASKS))
    asks = rarest.join(lists.select("token", "range"), "token").select("range", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "t")
    held = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("range", "part", "token", "least", "greatest", "n", "ids")
    kind = dict(queries.dtypes)["query_id"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        who, docs = [], []
        if left.num_rows and right.num_rows:
            start = int(right.column("range")[0].as_py()) * RANGE
            least, greatest, n = (np.asarray(right.column(c)) for c in ("least", "greatest", "n"))
            at = {t: i for i, t in enumerate(right.column("token").to_pylist())}
            decoded: dict[int, np.ndarray] = {}
            for row, tokens in enumerate(left.column("t").to_pylist()):
                own = [at.get(t, -1) for t in tokens]
                if min(own) < 0 or least[own].max() > greatest[own].min():
                    continue
                own.sort(key=lambda i: n[i])
                found = None
                for i in own:
                    if i not in decoded:
                        decoded[i] = decode(right.column("ids")[i].as_py()).astype(np.uint16)  # offsets in a range
                    ids = decoded[i]
                    if found is None:
                        found = ids
                    else:
                        place = np.searchsorted(ids, found)
                        found = found[ids[np.minimum(place, len(ids) - 1)] == found]
                    if not len(found):
                        break
                who += [row] * len(found[:k])
                docs.append(found[:k].astype(np.int64) + start)
        return pa.table({"query_id": left.column("query_id").take(pa.array(who, pa.int64())), "doc": pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64), pa.int64())})

    found = asks.groupBy("range", "part").cogroup(held.groupBy("range", "part")).applyInArrow(meet, f"query_id {kind}, doc long")
    best = ranked(found, "query_id", F.asc("doc"), k=k)  # docs are numbered in the order of ids
    if index.names is not None:
        best = best.join(index.names, "doc")
    else:
        best = best.withColumn("point_id", F.col("doc"))
    return best.select("query_id", "point_id", (1.0 / F.col("rank")).alias("score"), "rank")


def token_match(queries: DataFrame, texts: DataFrame | Index, k: int | None = 20) -> DataFrame:
    """match over texts, which are indexed first unless they are an index."""
    return match(texts if isinstance(texts, Index) else build(texts), queries, k)
