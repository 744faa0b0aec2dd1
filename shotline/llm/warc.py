"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record a row, payload the html in UTF-8 (null: empty).  Of records with equal payloads of at least 1000
bytes, that with the largest page_id is a response and the others are revisits of it, without payload; smaller ones
are all responses.  Rows that share that largest page_id are all responses.  A null page_id is the smallest.

Reading: for each place of the magic WARC/1. in a file, also inside payloads, a task parses the header that would be
there and emits a candidate with its offset and the offset of the record that would follow.  Pointer jumping from
the start of each file (joins that double the reach in each round) keeps the candidates that the chain of records
reaches, so magic inside a payload is rejected whatever it looks like.  A file that is cut off or broken gives the
records up to there.  Each file is one task's work; the writer bounds the records and the bytes of a file: pages are
written by size class, the larger ones with fewer records to a file.  A .gz file may have any number of members, such
as one for each record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import shared

CRLF = "\r\n"
LEAST = 1000
#: Revisits up to which their list is broadcast; beyond, pages are joined to it by shuffle.
FEW = 200_000
PER_FILE = 4000
#: Bytes of payloads in a file at most, but for a single page that has more.
FILE_BYTES = 1 << 28
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r$", re.M)


def _record(kind: Column, original: Column) -> Column:
    """The text of a record, without the two line ends after it."""
    revisit = kind == "revisit"
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("__html")))
    url = F.regexp_replace(F.coalesce(F.col("__url"), F.lit("")), r"[\r\n]", " ")
    page = F.coalesce(F.col("__page").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), page,
        F.lit(f">{CRLF}WARC-Date: 2000-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("__digest"), F.lit(f"{CRLF}Payload-Length: "), F.col("__bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), original.cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    """Write the archives of pages under path: files of up to PER_FILE records and about FILE_BYTES bytes."""
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("__page"), F.col(url).cast("string").alias("__url"), text.alias("__html"))
    rows = rows.withColumn("__bytes", F.octet_length("__html").cast("long")).withColumn("__digest", F.sha1(F.col("__html").cast("binary")))
    large = rows.select("__page", "__digest").filter(F.col("__bytes") >= LEAST)
    groups = large.groupBy("__digest").agg(F.max("__page").alias("__last"), F.count("*").alias("n")).filter("n > 1 and __last is not null")
    groups = shared.materialize(groups.select("__digest", "__last"))
    if groups.count() <= FEW:
        joined = rows.join(F.broadcast(groups), "__digest", "left")
    else:  # small pages stay where they are; of the others a popular one is split, as each has one row to meet
        last = F.lit(None).cast("long").alias("__last")
        joined = rows.filter(F.col("__bytes") >= LEAST).join(groups, "__digest", "left").unionByName(rows.filter(F.col("__bytes") < LEAST).select("*", last))
    again = (F.col("__bytes") >= LEAST) & F.col("__last").isNotNull() & ~F.col("__page").eqNullSafe(F.col("__last"))
    kind = F.when(again, "revisit").otherwise("response")
    written = F.when(again, 0).otherwise(F.col("__bytes")) + 1024
    least = FILE_BYTES // PER_FILE
    klass = F.greatest(F.lit(0), F.ceil(F.log2(written / least) / 4)).cast("int")  # each class holds pages up to 16 times as large as the one below
    for k in sorted(r[0] for r in rows.select(F.greatest(F.lit(0), F.ceil(F.log2((F.col("__bytes") + 1024) / least) / 4)).cast("int").alias("k")).distinct().collect()) or [0]:  # few: they grow with the logarithm
        out = joined.filter(klass == k).select(_record(kind, F.col("__last")).alias("value"))
        out.write.mode("append").option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", max(1, PER_FILE >> (4 * k))).text(path)


CANDIDATE = "file long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def parse(file: int, data: bytes) -> list[tuple]:
    """Candidates of a file, for every place where the magic is."""
    out = []
    for m in _MAGIC.finditer(data):
        end = data.find(b"\r\n\r\n", m.start())
        if end < 0:
            continue
        fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(data[m.end() : end + 2])}
        size = fields.get(b"content-length", b"")
        if not size.isdigit() or end + 4 + int(size) + 4 > len(data):
            continue
        block = end + 4
        close = block + int(size)
        if data[close : close + 4] != b"\r\n\r\n":
            continue
        kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
        body = data.find(b"\r\n\r\n", block, close)
        payload = memoryview(data)[body + 4 if body >= 0 else block : close]
        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
        if kind == "revisit":
            digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
            length = int(fields.get(b"payload-length", b"0")) if fields.get(b"payload-length", b"0").isdigit() else 0
        out.append((file, m.start(), close + 4, _number(fields.get(b"warc-record-id")), length, digest, kind, _number(fields.get(b"warc-refers-to"))))
    return out


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file; of one that is cut off or broken, what comes before."""
    out = []
    while data:
        member = zlib.decompressobj(47)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of all files under path; .gz files are unpacked."""

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parted:
            for file, name, data in zip(b.column("file").to_pylist(), b.column("path").to_pylist(), b.column("content"), strict=True):
                data = data.as_py()
                found = parse(file, unpacked(data) if name.endswith(".gz") else data)
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=schema)

    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in CANDIDATE.split(", ")])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.xxhash64("path").alias("file"), "path", "content").mapInArrow(run, CANDIDATE)


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain from offset 0 of each file reaches, by pointer jumping."""
    jump = shared.checkpoint(edges.select("file", "at", "next"))
    reached = shared.checkpoint(jump.filter("at = 0").select("file", "at"))
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = edges.select("file", "at")
        reached = shared.checkpoint(reached.union(ahead.join(known, ["file", "at"], "left_semi")).distinct())
        now = reached.count()
        if now == n:
            return reached
        n = now
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = shared.checkpoint(jump.join(onward, ["file", "next"]).select("file", "at", F.col("far").alias("next")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = shared.materialize(candidates(spark, path))
    kept = reachable(found)
    return found.join(kept, ["file", "at"], "left_semi").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them."""
    spark = pages.sparkSession
    path = f"{shared.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path)
