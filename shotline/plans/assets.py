"""Queries that write asset files and tables from the given tables, read them back, and are compared with SQL over the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.operators import compose, search, shots
from shotline.plans import oracle, rules
from shotline.plans.queries import _boxes, _candidates, frames, r6, table, token_queries
from shotline.sources import files, sinks, versions
from shotline.streaming import log


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{search.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stem(c: str = "source_file") -> F.Column:
    return F.regexp_replace(c, r"\.mp4$", "")


def _lines(rows: DataFrame, name: F.Column, order: str, line: F.Column, head: str = "") -> DataFrame:
    """(name, value): a text a name, its lines in order."""
    listed = rows.select(name.alias("name"), F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy("name").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("name", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("value"))


def _write_bounds(spark: SparkSession, sf_dir: str, path: str) -> None:
    times = shots.scene_times(frames(spark, sf_dir))
    line = F.when(F.col("scene_id") % 3 == 0, F.concat_ws(",", F.col("start"), F.col("end"))).otherwise(F.concat_ws("\t", F.concat(F.lit("s"), F.col("scene_id")), F.col("start"), F.col("end")))
    sinks.write_named(_lines(times, _stem(), "scene_id", line, "# id start end\n\nnot a shot\n"), path, ".txt")


def shot_bound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot files of the scenes; every third line has no id, and a head of three lines counts as lines."""
    path = folder(spark, "msb")
    _write_bounds(spark, sf_dir, path)
    return files.shot_bounds(spark, path).select("source_file", "shot_id", r6("start"), r6("end"))


def _write_asr(spark: SparkSession, sf_dir: str, path: str, name: F.Column) -> None:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    start = F.col("event_id") % 4000
    line = F.concat_ws(",", start.cast("string"), (start + 2).cast("string"), F.concat(F.lit('"'), F.regexp_replace("props", '"', '""'), F.lit('"')), F.lit(" end "))
    sinks.write_named(_lines(e, name, "event_id", line, "start,end,text\n5,3,turned round\n"), path, ".csv")


def speech_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: speech of view events, a user's a file, texts quoted."""
    path = folder(spark, "asr")
    _write_asr(spark, sf_dir, path, F.concat(F.lit("u"), F.col("user_id")))
    return files.asr(spark, path).select("source_file", r6("start"), r6("end"), "text")


def _write_metadata(spark: SparkSession, sf_dir: str, path: str) -> None:
    n = frames(spark, sf_dir).groupBy("source_file", "label").agg(F.count("*").alias("n"))
    good = F.to_json(F.struct(F.concat(F.lit("Title "), F.col("label")).alias("title"), F.col("n").cast("string").alias("description")))
    sinks.write_named(n.select(_stem().alias("name"), F.when(F.col("label") % 4 == 3, "[1, 2").otherwise(good).alias("value")), path, ".json")


def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object a video; broken ones give an empty map."""
    path = folder(spark, "metadata")
    _write_metadata(spark, sf_dir, path)
    return files.metadata(spark, path).select("source_file", F.col("meta")["title"].alias("title"), F.col("meta")["description"].alias("description"), F.size("meta").alias("n"))


def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export a hundred vectors, their boxes with y first; every fifth box has three sides only."""
    path = folder(spark, "objects")
    b = _boxes(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("f"), "vec_id", F.posexplode("dets").alias("k", "d"))
    side = F.transform(F.array(F.col("d.bbox")[1], F.col("d.bbox")[0], F.col("d.bbox")[3], F.col("d.bbox")[2]), lambda x: F.round(x, 3))
    whole = F.when((F.col("vec_id") * 8 + F.col("k")) % 5 == 0, F.slice(side, 1, 3)).otherwise(side)
    each = b.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("vec_id", "k", whole.alias("b"), F.col("d.label").alias("l"), F.round("d.conf", 6).alias("c")))).alias("x"))
    part = lambda n: F.transform("x", lambda x: x[n])
    value = F.to_json(F.struct(part("b").alias("detection_boxes"), part("l").alias("detection_class_names"), part("c").alias("detection_scores")))
    sinks.write_named(each.select(F.concat(F.lit("V"), F.col("f") % 3, F.lit("/"), F.col("f")).alias("name"), value.alias("value")), path, ".json")
    d, box = files.detections(spark, path), F.col("bbox")
    return d.select("source_file", "frame_id", "label", *[box[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], "conf")


def keyframe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each video's frames with their numbers."""
    path = folder(spark, "keyframes")
    f = frames(spark, sf_dir).select("source_file", F.concat(F.lit("k"), F.col("point_id"), F.lit(".jpg")).alias("name"), "frame_idx")
    value = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "frame_idx")))))
    sinks.write_named(f.groupBy("source_file").agg(value.alias("value")).select(F.concat(_stem(), F.lit("/frame_index")).alias("name"), "value"), path, ".json")
    return files.keyframe_index(spark, path)


def media_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a file, of a kind by its number; those in an asset folder don't count."""
    path = folder(spark, "media")
    i = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in ("MP4", "jpg", "wav", "txt")]), (i % 4 + 1).cast("int"))
    where = F.when(i % 5 == 0, "asr/").when(i % 5 == 1, "sub/dir/").otherwise("")
    sinks.write_named(table(spark, sf_dir, "pages").select(F.concat(where, F.lit("p"), i, F.lit("."), ending).alias("name"), F.coalesce("url", F.lit("")).alias("value")), path, "")
    return files.manifest(spark, path).select("name", "length", "kind")


def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in a JSON file; some without a type, some without text."""
    path = folder(spark, "queries")
    q = token_queries(spark, sf_dir)
    n = F.col("query_id")
    rows = q.select("query_id", F.struct(F.when(n % 300 > 0, (n % 3 + 1).cast("int")).alias("type"), F.when(n % 500 == 0, " ").otherwise(F.col("text")).alias("query")).alias("q"))
    sinks.write_named(_lines(rows, F.lit("all"), "query_id", F.to_json("q")).select("name", F.concat(F.lit("["), F.regexp_replace("value", "\n", ",\n"), F.lit("]")).alias("value")), path, ".json")
    return files.queries(spark, path).select("type", "query")


def work_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages in three lists; every fourth is done."""
    path = folder(spark, "lists")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h/d/p"), F.col("page_id"), F.lit(".ZIP")).alias("url"))
    sinks.write_named(_lines(p, F.concat(F.lit("list"), F.col("page_id") % 3), "page_id", F.col("url")), path, ".txt")
    done = p.filter("page_id % 4 = 0").select(F.concat(F.lit("list"), F.col("page_id") % 3, F.lit("/p"), F.col("page_id"), F.lit(".done")).alias("path"))
    return files.work_list(spark, path, done).select("key", "url")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.lit("interaction").alias("type"), F.col("event_type").alias("action"), F.when(i % 3 > 0, F.concat(F.lit("q"), i)).alias("query"), F.array(i.cast("string")).alias("result_ids"),
        F.col("props").alias("details"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("user_id").cast("string").alias("session_id"),
    )


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is appended to in two goes, then scanned."""
    path = folder(spark, "log")
    lines = _log_lines(spark, sf_dir)
    for part in (0, 1):
        sinks.append_log(lines.filter(F.pmod(F.xxhash64("session_id"), F.lit(2)) == part), path)
    return files.log(spark, path).select("action", "query", F.get("result_ids", F.lit(0)).alias("result_id"), "details", "timestamp_ms", "session_id")


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream of what is there, written by it as a table."""
    path = folder(spark, "stream")
    sinks.append_log(_log_lines(spark, sf_dir), f"{path}/log")
    rows = log.read(spark, f"{path}/log").select("session_id", "action", "timestamp_ms")
    q = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("session_id string, action string, timestamp_ms long").parquet(f"{path}/out")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("point_id", "source_file", "frame_idx", F.lit(0).alias("n"))


def upserted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: two thirds of the points, then two thirds again with another number: those that were there are replaced."""
    path = folder(spark, "points")
    p, i = _points(spark, sf_dir), F.col("point_id")
    versions.upsert(p.filter(i % 3 < 2), path)
    versions.upsert(p.filter(i % 3 > 0).withColumn("n", F.lit(1)), path, batch=("query", 0))
    versions.upsert(p.withColumn("n", F.lit(2)), path, batch=("query", 0))  # the same batch again writes nothing
    return versions.read(spark, path).select("point_id", "source_file", "frame_idx", "n")


def rebuilt_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: all points, then every other point of the even videos in place of all of theirs."""
    path = folder(spark, "points")
    p = _points(spark, sf_dir)
    versions.rebuild(p, path)
    even = F.substring("source_file", 4, 1).cast("int") % 2 == 0
    versions.rebuild(p.filter(even & (F.col("point_id") % 2 == 0)).withColumn("n", F.lit(1)), path)
    return versions.read(spark, path).select("point_id", "source_file", "frame_idx", "n")


def ranked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: answers as CSV, the ranked ones and the first ones (N/A without any)."""
    path = folder(spark, "answers")
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    answers = e.filter("user_id % 5 > 0").select(F.col("user_id").alias("query_id"), F.concat(F.lit('say "'), i, F.lit('", a')).alias("answer"), "event_id")
    answers = search.ranked(answers, "query_id", F.asc("event_id"))
    sinks.write_ranked(answers, f"{path}/ranked", 20)
    sinks.write_first(e.select(F.col("user_id").alias("query_id")).distinct(), answers, f"{path}/first")
    ranked = spark.read.option("escape", "\\").csv(f"{path}/ranked", schema="query_id long, rank int, answer string")
    return ranked.unionByName(spark.read.option("escape", "\\").csv(f"{path}/first", schema="query_id long, answer string").withColumn("rank", F.lit(0)))


def index_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 from files: media, shots of the even videos, speech and metadata are written, then read and indexed; odd videos are cut by predictions."""
    root = folder(spark, "collection")
    c = _candidates(spark, sf_dir).drop("scene_id").withColumn("source_file", _stem())
    videos = c.select("source_file").distinct()
    even = F.substring("source_file", 4, 1).cast("int") % 2 == 0
    sinks.write_named(videos.select(F.concat(F.lit("raw/"), F.col("source_file")).alias("name"), F.lit("media").alias("value")), root, ".mp4")
    times = shots.scene_times(frames(spark, sf_dir).withColumn("source_file", _stem())).filter(even)
    line = F.concat_ws("\t", F.concat(F.lit("s"), F.col("scene_id")), F.col("start"), F.col("end"))
    sinks.write_named(_lines(times, F.col("source_file"), "scene_id", line), f"{root}/msb", ".txt")
    _write_asr(spark, sf_dir, f"{root}/asr", F.concat(F.lit("V"), F.lpad((F.col("user_id") % 10).cast("string"), 3, "0")))
    _write_metadata(spark, sf_dir, f"{root}/metadata")
    most = c.groupBy("source_file").agg(F.max("frame_idx").alias("m"))
    chunk = most.select("source_file", "m", F.explode(F.sequence(F.lit(0), F.col("m"), F.lit(50))).alias("chunk_start"))
    preds = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.when((F.col("chunk_start") + k - 25) % 45 == 7, 0.9).otherwise(0.1))
    predictions = chunk.filter(~even).select("source_file", "chunk_start", F.least(F.lit(50), F.col("m") + 1 - F.col("chunk_start")).cast("int").alias("valid"), preds.alias("preds"))
    out = compose.index_files(spark, root, c, predictions, 25.0, 6.0)
    return out.select("point_id", "source_file", "scene_id", "shot_id", "frame_idx", r6("sharpness"), F.md5("text_blob").alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        shot_bound_files, speech_files, metadata_files, detection_files, keyframe_files, media_manifest, query_files, work_lists, log_scan, log_stream, upserted_points,
        rebuilt_videos, ranked_files, index_from_files,
    )
}

_EVEN = "substr(source_file, 4, 1)::INT % 2 = 0"

SQL: dict[str, str] = {
    "shot_bound_files": f"""WITH {oracle._F}, {rules._TIMES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY scene_id) + 2 AS line FROM times)
        SELECT replace(source_file, '.mp4', '') AS source_file, CASE WHEN scene_id % 3 = 0 THEN 'shot' || lpad(line::VARCHAR, 6, '0') ELSE 's' || scene_id END AS shot_id, round(start, 6) AS start, round(stop, 6) AS end FROM n WHERE stop > start""",
    "speech_files": """SELECT 'u' || user_id AS source_file, (event_id % 4000)::DOUBLE AS start, (event_id % 4000 + 2)::DOUBLE AS end, trim(props) || ' end' AS text FROM events WHERE event_type = 'view'""",
    "metadata_files": """WITH v AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
        SELECT 'V' || lpad(label::VARCHAR, 3, '0') AS source_file, CASE WHEN label % 4 <> 3 THEN 'Title ' || label END AS title, CASE WHEN label % 4 <> 3 THEN n::VARCHAR END AS description, CASE WHEN label % 4 <> 3 THEN 2 ELSE 0 END::INTEGER AS n FROM v""",
    "detection_files": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings), l AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e),
        s AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN hi > lo THEN round((x - lo) / (hi - lo) * 100, 3) ELSE 0 END) AS c FROM l),
        u AS (SELECT vec_id, unnest(range(0, 8)) AS k, unnest([{", ".join(oracle._box(k) for k in range(8))}]) AS b FROM s)
        SELECT 'V' || (vec_id // 100 % 3) AS source_file, (vec_id // 100)::VARCHAR AS frame_id, b.label AS label, round(b.x1, 3) AS x1, round(b.y1, 3) AS y1, round(b.x2, 3) AS x2, round(b.y2, 3) AS y2, round(b.conf, 6) AS conf FROM u WHERE (vec_id * 8 + k) % 5 > 0""",
    "keyframe_files": f"WITH {oracle._F} SELECT replace(source_file, '.mp4', '') AS source_file, 'k' || point_id || '.jpg' AS name, frame_idx AS native_idx FROM f",
    "media_manifest": """SELECT 'p' || page_id || '.' || ['MP4', 'jpg', 'wav', 'txt'][page_id % 4 + 1] AS name, (strlen(coalesce(url, '')) + 1)::BIGINT AS length, ['video', 'image', 'audio'][page_id % 4 + 1] AS kind FROM pages WHERE page_id % 4 < 3 AND page_id % 5 > 0""",
    "query_files": rf"""WITH q AS (SELECT doc_id AS n, {oracle._FIRST} AS t FROM documents WHERE doc_id % 100 = 0)
        SELECT CASE WHEN n % 300 > 0 THEN n % 3 + 1 ELSE 1 END::INTEGER AS type, t AS query FROM q WHERE n % 500 > 0 AND t <> ''""",
    "work_lists": "SELECT 'list' || (page_id % 3) || '/p' || page_id AS key, 'http://h/d/p' || page_id || '.ZIP' AS url FROM pages WHERE page_id % 4 > 0",
    "log_scan": """SELECT event_type AS action, CASE WHEN event_id % 3 > 0 THEN 'q' || event_id END AS query, event_id::VARCHAR AS result_id, props AS details, epoch_us(ts) // 1000 AS timestamp_ms, user_id::VARCHAR AS session_id FROM events""",
    "log_stream": "SELECT user_id::VARCHAR AS session_id, event_type AS action, epoch_us(ts) // 1000 AS timestamp_ms FROM events",
    "upserted_points": f"WITH {oracle._F} SELECT point_id, source_file, frame_idx, (point_id % 3 > 0)::INTEGER AS n FROM f",
    "rebuilt_videos": f"WITH {oracle._F} SELECT point_id, source_file, frame_idx, ({_EVEN})::INTEGER AS n FROM f WHERE NOT ({_EVEN}) OR point_id % 2 = 0",
    "ranked_files": """WITH a AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS rank, 'say "' || event_id || '", a' AS answer FROM events WHERE user_id % 5 > 0)
        SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT DISTINCT user_id, 0, coalesce(answer, 'N/A') FROM events LEFT JOIN a ON query_id = user_id AND rank = 1""",
}
