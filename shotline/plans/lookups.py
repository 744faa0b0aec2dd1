"""Queries of lookups, reports and parsing rules over the given tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotline.functions import hooks
from shotline.functions import media as M
from shotline.functions import text as T
from shotline.operators import boxes, evaluate, search, session, temporal
from shotline.plans import oracle
from shotline.plans.queries import _asr, _boxes, _hits, _turns, frames, placed, r6, table


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget the mean estimate, measured tokens ("n/a" left out), seconds and likeness to the image's best caption; an event is a run, a user an image."""
    i = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image"), (i % 4 * 256 + 256).alias("budget"), (i % 1000).cast("double").alias("estimate"),
        F.when(i % 5 == 0, "n/a").otherwise((i % 700).cast("string")).alias("measured"), F.col("value").alias("seconds"), F.repeat(F.lit("x"), (i % 50 + 1).cast("int")).alias("caption"),
    )
    return evaluate.token_budgets(runs).select("budget", *[r6(c) for c in ("mean_estimate", "mean_measured", "mean_seconds", "mean_similarity")], "n")


def video_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of one video, with their places."""
    rows = search.timeline(frames(spark, sf_dir), "V001.mp4")
    return rows.select("point_id", "source_file", "frame_idx", r6("timestamp"))


def pending_clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that each user turn's predecessor got is what it refers to."""
    t = _turns(spark, sf_dir).withColumnRenamed("answer", "clarification")
    return session.pending_clarification(t).select("session_id", "turn", F.md5("answers").alias("answers_md5"))


def clarify_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript, latest query and the first three events of the session's number as numbered candidates."""
    t = _turns(spark, sf_dir)
    latest = t.groupBy("session_id").agg(F.max_by("query", "turn").alias("query"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("props").alias("line"))
    first = search.ranked(e, "session_id", F.asc("event_id"), k=3, name="place").select("session_id", "place", "line")
    return session.model_input(session.transcript(t), latest, first)


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of boxes joined, empty ones left out, letters and their marks composed."""
    part = lambda c: F.struct(c.alias("text"))
    boxes = F.array(part(F.concat(F.lit(" "), F.col("lang"), F.lit(" "))), part(F.lit("  ")), part(F.lit(None).cast("string")), part(F.concat(F.lit("é"), F.col("doc_id").cast("string"))), part(F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", hooks.ocr_text(boxes).alias("ocr_text"))


def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with the distinct labels of the detections."""
    attrs = F.struct(F.col("vec_id").alias("scene"), F.array().cast("array<string>").alias("objects"))
    rows = _boxes(spark, sf_dir).select("vec_id", hooks.merged_attributes(attrs, F.col("dets")).alias("a"))
    return rows.select("vec_id", F.array_join("a.objects", ",").alias("objects"), F.size("a.detected_objects").alias("n"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a region on its frame of 64 x 48; regions outside of it give none."""
    i = F.col("vec_id").cast("int")
    region = F.array(*[x.cast("double") for x in (i % 90 - 10, i % 60 - 5, i % 90 + 30, i % 60 + 20)])
    moved = hooks.on_frame(region, F.col("dets"), F.lit(64), F.lit(48))
    rows = _boxes(spark, sf_dir).select("vec_id", F.posexplode(moved).alias("place", "d"))
    return rows.select("vec_id", "place", "d.label", *[F.round(F.col("d.bbox")[k], 3).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight evenly spaced places in clips of up to forty frames."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.posexplode(M.even_positions((F.col("event_id") % 41).cast("int"))).alias("i", "position"))


def decompositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries of responses, or else the query itself."""
    i, q = F.col("event_id"), F.concat(F.lit("q"), F.col("user_id").cast("string"))
    listed = F.concat(F.lit('{"sub_queries": ["a", " ", "b'), q, F.lit('"]}'))
    raw = F.when(i % 5 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(i % 5 == 1, listed).when(i % 5 == 2, '{"sub_queries": []}').when(i % 5 == 3, "sorry").otherwise('{"events": ["x"]}')
    rows = table(spark, sf_dir, "events").select("event_id", T.string_list(raw, "sub_queries", q).alias("s"))
    return rows.select("event_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sub_queries"))


def verification_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of responses, only if there are three."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    ask = lambda *x: F.concat(F.lit('{"questions": ['), F.concat_ws(", ", *[F.concat(F.lit('"'), y, F.lit('"')) for y in x]), F.lit("]}"))
    raw = F.when(i % 4 == 0, ask(F.lit("red?"), u, F.lit("blue?"))).when(i % 4 == 1, ask(F.lit("red?"), F.lit(" "), u)).when(i % 4 == 2, ask(F.lit("a"), F.lit("b"), F.lit("c"), u)).otherwise("no")
    rows = table(spark, sf_dir, "events").select("event_id", T.exactly(raw, 3).alias("q"))
    return rows.select("event_id", F.array_join("q", "|").alias("questions"))


def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the collection by modality."""
    audio = temporal.audio_segments(table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source_file")).agg(F.round(F.sum("value"), 2).alias("duration")))
    kinds = [frames(spark, sf_dir).select(F.lit("visual").alias("modality")), _asr(spark, sf_dir).select(F.lit("speech").alias("modality")), audio.select(F.lit("audio").alias("modality"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("modality").agg(F.count("*").alias("n"))


def video_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct videos among each query's first ten hits, and the share of repeats."""
    return evaluate.coverage(placed(_hits(spark, sf_dir), spark, sf_dir)).select("query_id", "videos", r6("duplicate_rate"))


def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches kept by stage and hour and merged by stage; true where they're within the rank error of the exact ones."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), "ts")
    kept = evaluate.latency_sketches(e)
    got = evaluate.merged_latency(kept, ["stage"])
    seconds = e.filter("seconds is not null and not isnan(seconds)").join(got.select("stage", "p50", "p95"), "stage")
    rank = lambda p: (F.sum((F.col("seconds") < F.col(p)).cast("int")) / F.count("*"), F.sum((F.col("seconds") <= F.col(p)).cast("int")) / F.count("*"))
    near = lambda p, share: (rank(p)[0] - evaluate.RANK_ERROR <= share) & (rank(p)[1] + evaluate.RANK_ERROR >= share)
    held = seconds.groupBy("stage").agg(near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))
    return got.join(held, "stage").select("stage", "n", "hours", "p50_near", "p95_near")


def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found in overlapping tiles of a frame, moved onto it; what two tiles have both found counts once.

    Eight vectors are a frame of 220 x 160, one a tile of 100 x 100.
    """
    n = F.col("vec_id") % 8
    found = _boxes(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("frame_id"), (n % 4 * 40).alias("x"), (F.floor(n / 4) * 60).alias("y"), F.explode("dets").alias("d"))
    kept = boxes.suppress(boxes.placed(found.select("frame_id", "x", "y", "d.label", "d.bbox", "d.conf")), 0.3)
    b = F.col("bbox")
    return kept.select("frame_id", "label", *[F.round(b[k], 3).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], r6("conf"))


def text_model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and every hundredth of them as a query through a model that workers load once; the five nearest of each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), hooks.batch_model(hooks.word_digits)(F.col("text")).alias("vector"))
    d = search.materialize(d)  # the model reads a text once, however many blocks of queries there are
    q = d.filter("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    return search.knn(q, d, 5).select("query_id", "point_id", r6("score"), "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_budgets, video_timeline, pending_clarifications, clarify_inputs, ocr_texts, merged_objects, region_boxes, sample_positions, decompositions,
        verification_questions, modality_counts, video_coverage, latency_sketches, tile_boxes, text_model_search,
    )
}

_TURNS = "n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_DETS = f"""e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings), l AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e),
        s AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN hi > lo THEN round((x - lo) / (hi - lo) * 100, 3) ELSE 0 END) AS c FROM l),
        d AS (SELECT vec_id, [{", ".join(oracle._box(k) for k in range(8))}] AS d FROM s)"""

SQL: dict[str, str] = {
    "token_budgets": """
        WITH r AS (SELECT user_id AS image, event_id % 4 * 256 + 256 AS budget, event_id % 1000 AS estimate, CASE WHEN event_id % 5 > 0 THEN event_id % 700 END AS measured, value AS seconds, event_id % 50 + 1 AS len FROM events),
        b AS (SELECT image, len AS best FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY budget DESC, len DESC) AS n FROM r) WHERE n = 1)
        SELECT budget, round(avg(estimate::DOUBLE), 6) AS mean_estimate, round(avg(measured::DOUBLE), 6) AS mean_measured, round(avg(seconds), 6) AS mean_seconds,
        round(avg(round(2.0::DOUBLE * least(len, best) / (len + best), 3)), 6) AS mean_similarity, count(*) AS n FROM r JOIN b USING (image) GROUP BY budget""",
    "video_timeline": f"WITH {oracle._F} SELECT point_id, source_file, frame_idx, round(timestamp, 6) AS timestamp FROM f WHERE source_file = 'V001.mp4'",
    "pending_clarifications": f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, CASE WHEN r = 'assistant' THEN x END AS answer FROM n WHERE role = 'user')
        SELECT conv_id AS session_id, turn::INTEGER AS turn, md5(lag(answer) OVER (PARTITION BY conv_id ORDER BY turn)) AS answers_md5 FROM t""",
    "clarify_inputs": f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, text, concat_ws(chr(10), CASE WHEN coalesce(text, '') <> '' THEN 'User: ' || text END, CASE WHEN r = 'assistant' AND coalesce(x, '') <> '' THEN 'System: ' || x END) AS t FROM n WHERE role = 'user'),
        s AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE t <> '') AS said, arg_max(text, turn) AS latest FROM t GROUP BY conv_id),
        c AS (SELECT user_id, string_agg(n || '. ' || props, chr(10) ORDER BY n) AS list FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id)
        SELECT conv_id AS session_id, concat_ws(chr(10) || chr(10), CASE WHEN coalesce(said, '') <> '' THEN 'Conversation:' || chr(10) || said END, 'Query: ' || latest, 'Candidates:' || chr(10) || list) AS input FROM s LEFT JOIN c ON user_id = conv_id""",
    "ocr_texts": "SELECT doc_id, concat_ws(' ', nullif(trim(lang), ''), chr(233) || doc_id, nullif(trim(source), '')) AS ocr_text FROM documents",
    "merged_objects": f"WITH {_DETS} SELECT vec_id, array_to_string(list_sort(list_distinct(list_transform(d, lambda b: b.label))), ',') AS objects, len(d)::INTEGER AS n FROM d",
    "region_boxes": f"""WITH {_DETS}, u AS (SELECT vec_id, unnest(range(0, 8))::INTEGER AS place, unnest(d) AS b, greatest(vec_id % 90 - 10, 0) AS x, greatest(vec_id % 60 - 5, 0) AS y,
            least(greatest(vec_id % 90 + 30, 0), 64) AS xx, least(greatest(vec_id % 60 + 20, 0), 48) AS yy FROM d)
        SELECT vec_id, place, b.label AS label, round(b.x1 + x, 3) AS x1, round(b.y1 + y, 3) AS y1, round(b.x2 + x, 3) AS x2, round(b.y2 + y, 3) AS y2 FROM u WHERE xx > x AND yy > y""",
    "sample_positions": """WITH e AS (SELECT event_id, event_id % 41 AS n, least(event_id % 41, 8) AS m FROM events), u AS (SELECT event_id, n, m, unnest(range(0, m)) AS i FROM e)
        SELECT event_id, i::INTEGER AS i, (i * (n - 1) // greatest(m - 1, 1))::INTEGER AS position FROM u""",
    "decompositions": """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 2 ELSE 1 END::INTEGER AS n, CASE WHEN event_id % 5 < 2 THEN 'a|bq' || user_id ELSE 'q' || user_id END AS sub_queries FROM events""",
    "verification_questions": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'red?|' || user_id || '|blue?' ELSE '' END AS questions FROM events",
    "modality_counts": """WITH d AS (SELECT user_id, round(sum(value), 2) AS s FROM events GROUP BY user_id)
        SELECT 'visual' AS modality, count(*) AS n FROM embeddings UNION ALL SELECT 'speech', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'audio', sum(ceil(s / 10))::BIGINT FROM d WHERE s > 0""",
    "video_coverage": f"""{oracle._H}, p AS (SELECT query_id, source_file FROM h JOIN f USING (point_id) WHERE rank <= 10)
        SELECT query_id, count(DISTINCT source_file) AS videos, round(1 - count(DISTINCT source_file) / count(*), 6) AS duplicate_rate FROM p GROUP BY query_id""",
    "latency_sketches": """SELECT event_type AS stage, count(value) AS n, count(DISTINCT date_trunc('hour', ts)) FILTER (WHERE value IS NOT NULL) AS hours, true AS p50_near, true AS p95_near FROM events GROUP BY event_type""",
    "tile_boxes": f"""WITH {_DETS}, m AS (SELECT vec_id // 8 AS frame_id, unnest(d) AS b, vec_id % 8 % 4 * 40 AS x, vec_id % 8 // 4 * 60 AS y FROM d),
        t AS (SELECT frame_id, list_transform(list_sort(list({{'k': b.k, 'label': b.label, 'x1': b.x1 + x, 'y1': b.y1 + y, 'x2': b.x2 + x, 'y2': b.y2 + y, 'conf': b.conf}})), lambda x: [x]) AS d FROM m GROUP BY frame_id),
        n AS (SELECT frame_id, list_reduce(d, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o: o.label = b[1].label AND {oracle._AREAS} - {oracle._INTER} > 0 AND {oracle._INTER} / ({oracle._AREAS} - {oracle._INTER}) >= 0.3)) > 0 THEN kept ELSE list_concat(kept, b) END) AS kept FROM t),
        u AS (SELECT frame_id, unnest(kept) AS b FROM n)
        SELECT frame_id, b.label AS label, round(b.x1, 3) AS x1, round(b.y1, 3) AS y1, round(b.x2, 3) AS x2, round(b.y2, 3) AS y2, round(b.conf, 6) AS conf FROM u""",
    "text_model_search": rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents), c AS (SELECT doc_id, md5(w)[1] AS g, count(*) AS n FROM w GROUP BY ALL),
        k AS (SELECT unnest(string_split('0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f', ',')) AS g), v AS (SELECT doc_id, list(coalesce(n, 0)::DOUBLE ORDER BY g) AS v FROM documents CROSS JOIN k LEFT JOIN c USING (doc_id, g) GROUP BY doc_id),
        s AS (SELECT q.doc_id AS query_id, d.doc_id AS point_id, round(coalesce(list_cosine_similarity(q.v, d.v), 0), 9) AS score FROM v q CROSS JOIN v d WHERE q.doc_id % 100 = 0),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank FROM s) SELECT query_id, point_id, round(score, 6) AS score, rank FROM h WHERE rank <= 5""",
}
