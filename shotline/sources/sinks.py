"""Sinks: idempotent tables and result files."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from shotline.operators.search import checkpoint
from shotline.sources.files import schema_violations


def merged(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """K1 as a plan: new points, and the old ones that they don't replace."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def newest(points: DataFrame, key: str = "point_id", version: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest version, or else with the greatest hash of the whole row."""
    order = [F.col(version).desc_nulls_last()] if version else []
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64(*points.columns).desc()))
    return points.withColumn("__n", place).filter("__n = 1").drop("__n")


def rebuild(points: DataFrame, path: str, dim: int | None = None, by: str = "source_file") -> None:
    """K2: replace the partitions of the videos that points has; running it again changes nothing.

    With dim, a wrong vector length fails the job before anything is written.
    """
    if dim is not None and (bad := schema_violations(points, dim).collect()):
        raise ValueError(f"vectors of other lengths than {dim}: {bad}")
    points.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def upsert(points: DataFrame, path: str, dim: int | None = None, by: str = "source_file", key: str = "point_id", version: str | None = None) -> None:
    """K1: insert points by key, or replace those that are there; other points of their videos stay.

    Only the partitions of videos that points has are read and written again.  Of points that share a key the newest
    counts (see newest).  Running it again changes nothing.  The merged rows are checkpointed before the partitions
    they come from are replaced, so that a task that runs again still finds them.
    """
    if dim is not None and (bad := schema_violations(points, dim).collect()):
        raise ValueError(f"vectors of other lengths than {dim}: {bad}")
    spark = points.sparkSession
    once = newest(points, key, version)
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched = once.select(by).distinct()
        old = old.withColumn(by, F.col(by).cast(once.schema[by].dataType)).join(touched, by, "left_semi")
        once = checkpoint(merged(old, once, key))
    once.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def batch_results(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """K3: per query its ranked answers, and the first as result (N/A if there is none)."""
    lists = answers.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "answer"))), lambda x: x["answer"]).alias("results"))
    rows = queries.join(lists, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast("array<string>")))
    return rows.withColumn("result", F.coalesce(F.get("results", F.lit(0)), F.lit("N/A")))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_first(queries: DataFrame, answers: DataFrame, path: str) -> None:
    """K4: the first answer of each query as CSV."""
    first = answers.filter("rank = 1").select("query_id", "answer")
    queries.join(first, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("N/A")).alias("answer")).write.mode("overwrite").csv(path)


def write_ranked(answers: DataFrame, path: str, most: int = 100) -> None:
    """K5: a row for each query and rank."""
    answers.filter(F.col("rank") <= most).select("query_id", "rank", "answer").write.mode("overwrite").csv(path)


def answer_text(kind: int, *parts: str) -> F.Column:
    """What a submission says for a query of this type: the parts, separated by a comma and a space."""
    return F.concat_ws(", ", *[F.col(p).cast("string") for p in parts])


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """K6: evaluation summary and details, side by side."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def append_log(lines: DataFrame, path: str) -> None:
    """K7."""
    lines.write.mode("append").json(path)


def _files(path: str) -> tuple[fs.FileSystem, str] | None:
    """The store of path as tasks reach it, and the folder in it; None if only Spark reaches it."""
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return None


def write_named(texts: DataFrame, path: str, ending: str) -> None:
    """Texts (name, value) as files path/name + ending, one each; a name may hold folders.

    Each task writes the files of its names, under another name first, so that a task that runs again replaces whole files; nothing
    passes through the driver.  In a store that only Spark reaches, Spark writes the files, and the driver renames them.
    """
    if _files(path) is None:
        return _write_renamed(texts, path, ending)

    def write(rows: Iterator[Row]) -> Iterator[str]:
        store, folder = _files(path)
        made, twice = set(), None
        for name, own in itertools.groupby(rows, lambda r: r["name"]):
            value = next(own)["value"]
            if next(own, None) is not None:
                twice = name
                continue
            target = f"{folder}/{name}{ending}"
            parent, _, last = target.rpartition("/")
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            hidden = f"{parent}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden, compression=None) as out:
                out.write(f"{'' if value is None else value}\n".encode())
            store.move(hidden, target)
        if twice is not None:
            yield twice

    keyed = texts.select("name", "value").repartition("name").sortWithinPartitions("name")
    if bad := keyed.rdd.mapPartitions(write).collect():  # one a task at most
        raise ValueError(f"{bad[0]} has several texts")


def _write_renamed(texts: DataFrame, path: str, ending: str) -> None:
    spark = texts.sparkSession
    own = f"{path}/.{uuid.uuid4().hex}"
    keyed = texts.select(F.hex(F.col("name").cast("binary")).alias("name"), "value")
    keyed.repartition("name").write.partitionBy("name").text(own)
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in store.listStatus(jvm.org.apache.hadoop.fs.Path(own)):
        if not folder.isDirectory():
            continue
        name = bytes.fromhex(folder.getPath().getName().split("=")[1]).decode()
        files = [x.getPath() for x in store.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise ValueError(f"{name} has {len(files)} texts")
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{ending}")
        store.mkdirs(target.getParent())
        store.rename(files[0], target)
    store.delete(jvm.org.apache.hadoop.fs.Path(own), True)
