"""Sources: asset files as DataFrames.  Malformed content gives no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of raw media.
VIDEO, IMAGE, AUDIO = ("mp4", "avi", "mkv", "mov"), ("jpg", "jpeg", "png"), ("mp3", "wav", "m4a")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _number(x: Column) -> Column:
    n = F.trim(x).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def frames(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    """Points of one modality; tables are partitioned by it, so the filter prunes."""
    df = spark.read.parquet(path)
    return df if modality is None else df.filter(F.col("modality") == modality)


def shot_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One text file a video: id, start, end in any order of columns.

    Each file is one row, so line numbers survive; a line without an id is named by its number, counted from 0, blank
    lines and comments included.
    """
    files = spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("source_file"), "value")
    lines = files.select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    used = lines.filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("line", ",", "\t"), r"\s+"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.filter(F.transform("parts", _number), lambda x: x.isNotNull())
    name = F.get(F.filter("parts", lambda x: _number(x).isNull()), F.lit(0))
    rows = used.withColumn("parts", parts).withColumn("n", numbers).filter(F.size("n") >= 2)
    out = rows.select("source_file", F.coalesce(name, F.format_string("shot%06d", F.col("pos"))).alias("shot_id"), F.get("n", F.lit(0)).alias("start"), F.get("n", F.lit(1)).alias("end"))
    return out.filter("end > start")


def _named(path: Column) -> Column:
    """Path of a file from its address, in which some characters are encoded; a plus sign is none of them."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


# Bytes up to which a file is read at once.
AT_ONCE = 1 << 24


def _file_lines(spark: SparkSession, path: str, endings: str) -> DataFrame:
    """(source_file, path, value): the lines of all files with these endings, without empty ones.

    Files up to AT_ONCE bytes are read at once, which costs a fraction of what the text source does to set up each, and named
    once; larger ones are read line by line.  Both filters are on sizes as listed, so that no file is opened twice.
    """
    size, glob = F.col("_metadata.file_size"), f"*.{endings}"
    small = spark.read.format("binaryFile").load(path, pathGlobFilter=glob).filter(size <= AT_ONCE)
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")  # the text source leaves this mark out, too
    lines = small.select(_stem(F.col("path")).alias("source_file"), "path", text.alias("text")).select("source_file", "path", F.explode(F.split("text", "\r\n|\r|\n")).alias("value"))
    large = spark.read.text(path, pathGlobFilter=glob).filter(size > AT_ONCE).select(_named(F.col("_metadata.file_path")).alias("path"), "value")
    return lines.unionByName(large.select(_stem(F.col("path")).alias("source_file"), "path", "value")).filter("value <> ''")


def asr(spark: SparkSession, path: str) -> DataFrame:
    """S3: files of start, end and text, .csv by commas, .tsv and .txt by tabs, quoted as CSV is.

    The text is all further fields, trimmed, the empty ones left out, joined by a space.
    """
    quoted = lambda sep: F.regexp_extract_all("value", F.lit(rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1))
    fields = F.when(F.col("path").endswith(".csv"), quoted(",")).otherwise(quoted("\t"))
    plain = F.transform("f", lambda x: F.trim(F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)))
    lines = _file_lines(spark, path, "{csv,tsv,txt}").select("source_file", fields.alias("f"))
    rows = lines.withColumn("f", plain).filter(F.size("f") >= 3)
    text = F.trim(F.array_join(F.filter(F.slice("f", 3, F.size("f")), lambda x: x != ""), " "))
    return rows.select("source_file", _number(F.get("f", F.lit(0))).alias("start"), _number(F.get("f", F.lit(1))).alias("end"), text.alias("text")).filter("start < end and text <> ''")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a video as a map; anything else is an empty map."""
    files = spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("source_file"), "value")
    return files.select("source_file", F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("meta"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Exported detections, a file video/frame.json each: normalised boxes [y1, x1, y2, x2] with classes and scores.

    Boxes are zipped with classes and scores, as many as all three have; names win over class numbers; boxes of other
    lengths than 4 go; bbox is [x1, y1, x2, y2].
    """
    schema = "detection_boxes array<array<double>>, detection_class_names array<string>, detection_classes array<string>, detection_scores array<double>"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path, multiLine=True)
    named = rows.select(
        _folder(F.input_file_name()).alias("source_file"), _stem(F.input_file_name()).alias("frame_id"), F.col("detection_boxes").alias("b"),
        F.coalesce("detection_class_names", "detection_classes").alias("l"), F.col("detection_scores").alias("s"),
    )
    n = F.least(F.size("b"), F.size("l"), F.size("s"))
    each = named.filter(n > 0).select("source_file", "frame_id", F.explode(F.slice(F.arrays_zip("b", "l", "s"), F.lit(1), n)).alias("d")).filter(F.size("d.b") == 4)
    box = F.col("d.b")
    return each.select("source_file", "frame_id", F.col("d.l").alias("label"), F.array(*[F.get(box, F.lit(k)) for k in (1, 0, 3, 2)]).alias("bbox"), F.col("d.s").alias("conf"))


def keyframe_index(spark: SparkSession, path: str) -> DataFrame:
    """video/frame_index.json, a JSON object keyframe name -> native frame index."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(_folder(F.input_file_name()).alias("source_file"), "value")
    return files.select("source_file", F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "native_idx")).filter("native_idx is not null")


def features_of(keyframes: DataFrame, matrix: DataFrame) -> DataFrame:
    """Row i of a video's matrix (source_file, row, vector) belongs to its i-th keyframe by name; none: null."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source_file").orderBy("name")) - 1
    return keyframes.withColumn("row", place).join(matrix, ["source_file", "row"], "left")


# Folders of assets, whose files are no raw media.
ASSET_FOLDERS = ("msb", "keyframes", "metadata", "asr", "objects", "analysis")


def manifest(spark: SparkSession, root: str, skip: tuple[str, ...] = ASSET_FOLDERS) -> DataFrame:
    """Media files under root with their kind, without those in a folder below root that skip names; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ending.isin(*VIDEO), "video").when(ending.isin(*IMAGE), "image").when(ending.isin(*AUDIO), "audio")
    base = root.rstrip("/").split("://")[-1]
    below = F.split(F.substring_index("path", f"{base}/", -1), "/")
    folders = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    kept = files.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in skip]).cast("array<string>")))
    return kept.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "kind")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Annotated or plain queries; rows without text go, a missing type is 1."""
    truth = "struct<video_name: string, timestamp: double, frame_id: bigint, answer: string, event_frames: array<struct<timestamp: double, frame_id: bigint>>, reference_summary: string>"
    rows = spark.read.schema(f"type int, query string, ground_truth {truth}").json(path, multiLine=True)
    return rows.filter(F.coalesce(F.trim("query"), F.lit("")) != "").withColumn("type", F.coalesce("type", F.lit(1)))


def work_list(spark: SparkSession, lists: str, done: DataFrame) -> DataFrame:
    """Urls of list files, keyed list/name without .zip, but for those with a marker key.done in done (path)."""
    rows = spark.read.text(lists).select(F.trim("value").alias("url"), _stem(F.input_file_name()).alias("dir"))
    name = F.regexp_extract("url", r"([^/]+)$", 1)
    keyed = rows.filter(name != "").withColumn("key", F.concat_ws("/", "dir", F.regexp_replace(name, r"(?i)\.zip$", "")))
    marked = done.filter(F.col("path").endswith(".done")).select(F.regexp_replace("path", r"\.done$", "").alias("key")).distinct()
    return keyed.join(marked, "key", "left_anti")


def schema_violations(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """How many points have no vector or one of another length."""
    size = F.size(vector)
    return points.filter(F.col(vector).isNull() | (size != dim)).groupBy(F.when(F.col(vector).isNull(), -1).otherwise(size).alias("found_dim")).agg(F.count("*").alias("n"))


LOG = "type string, action string, query string, result_ids array<string>, details string, timestamp_ms long, session_id string"


def log(spark: SparkSession, path: str) -> DataFrame:
    """The interaction log, JSON lines."""
    return spark.read.schema(LOG).json(path)
