"""K1, K2, T4: a table of points in versions.  A version's files never change; a manifest, put in place last and at once, says which they are.

A table is cut into buckets by a hash of the video.  A commit writes the touched buckets anew, into a folder of its own, and then renames a manifest to the
next number; that fails if another writer has taken the number, and the commit starts again from what is there now.  Readers take the manifest
with the greatest number, so they see all of a commit or nothing of it.  A manifest holds a folder for each bucket, of which there is a fixed number, and
a ledger: the last batch of each stream that writes here.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotline.sources.files import schema_violations
from shotline.sources.sinks import merged, newest

BUCKETS = 64
BUCKET = "__bucket"
RETRIES = 20


class Manifest(NamedTuple):
    """folders: of each bucket that has rows, relative to the table; ledger: last batch by stream."""

    version: int
    buckets: int
    schema: str
    folders: dict[str, str]
    ledger: dict[str, int]


class Conflict(RuntimeError):
    """Another writer took the version's number."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are."""
    where, fs = _files(spark, f"{path}/manifests")
    if not fs.exists(where):
        return []
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The latest manifest, or that of a version; None if there is none."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        return None
    text = spark.read.text(f"{path}/manifests/{have[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Put the manifest in place: it's written beside first, then renamed; Conflict if its number is taken."""
    own, fs = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(new._asdict()).encode()))
    out.close()
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{new.version:012d}.json")
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without overwriting
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(own), fs.makeQualified(target), kinds)
    except Py4JJavaError as e:
        fs.delete(own, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"version {new.version} of {path} is there already") from None
        raise


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its latest version, or of an earlier one."""
    m = manifest(spark, path, version)
    if m is None:
        raise ValueError(f"no version {'' if version is None else version} at {path}")
    return _rows(spark, path, m, list(m.folders))


def _rows(spark: SparkSession, path: str, m: Manifest, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(m.schema))
    folders = [f"{path}/{m.folders[b]}" for b in buckets if b in m.folders]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bucket(by: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(buckets)).cast("int")


def _change(points: DataFrame, path: str, by: str, batch: tuple[str, int] | None, combine, dim: int | None) -> int | None:  # noqa: ANN001
    """Commit combine(old rows of the touched buckets, points); the version's number, or None if the batch was there already."""
    if dim is not None and (bad := schema_violations(points, dim).collect()):
        raise ValueError(f"vectors of other lengths than {dim}: {bad}")
    spark = points.sparkSession
    for _ in range(RETRIES):
        old = manifest(spark, path)
        if batch is not None and old is not None and old.ledger.get(batch[0], -1) >= batch[1]:
            return None
        buckets = old.buckets if old else BUCKETS
        touched = [str(r[0]) for r in points.select(_bucket(by, buckets).alias("b")).distinct().collect()]  # at most buckets
        rows = combine(_rows(spark, path, old, touched) if old else None)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, _bucket(by, buckets)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
        where, fs = _files(spark, f"{path}/{folder}")
        there = {x.getPath().getName().split("=")[1] for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in (old.folders if old else {}).items() if b not in touched}
        folders |= {b: f"{folder}/{BUCKET}={b}" for b in touched if b in there}
        ledger = (old.ledger if old else {}) | ({batch[0]: batch[1]} if batch else {})
        try:
            commit(spark, path, Manifest((old.version if old else 0) + 1, buckets, rows.schema.json(), folders, ledger))
            return (old.version if old else 0) + 1
        except Conflict:
            fs.delete(where, True)
    raise Conflict(f"{RETRIES} tries to write to {path} met other writers")


def upsert(points: DataFrame, path: str, dim: int | None = None, by: str = "source_file", key: str = "point_id", version: str | None = None, batch: tuple[str, int] | None = None) -> int | None:
    """K1: insert points by key, or replace those that are there; other points stay.  batch: (stream, number), numbers rise.

    Of points that share a key the newest counts (sinks.newest).  A point's video has to stay the same.
    """
    once = newest(points, key, version)
    return _change(once, path, by, batch, lambda old: once if old is None else merged(old, once, key), dim)


def rebuild(points: DataFrame, path: str, dim: int | None = None, by: str = "source_file", batch: tuple[str, int] | None = None) -> int | None:
    """K2: replace all points of the videos that points has."""

    def combine(old: DataFrame | None) -> DataFrame:
        return points if old is None else points.unionByName(old.join(points.select(by).distinct(), by, "left_anti"), allowMissingColumns=True)

    return _change(points, path, by, batch, combine, dim)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but for the latest keep, and the folders that only they name; what was deleted.  Not while others write."""
    have = versions(spark, path)
    kept = {f.rpartition("/")[0] for v in have[-keep:] for f in manifest(spark, path, v).folders.values()}
    gone = []
    for v in have[:-keep]:
        where, fs = _files(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(where, False)
    where, fs = _files(spark, f"{path}/data")
    for x in fs.listStatus(where) if fs.exists(where) else []:
        if f"data/{x.getPath().getName()}" not in kept:
            fs.delete(x.getPath(), True)
            gone.append(x.getPath().getName())
    return gone
