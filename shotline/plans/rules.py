"""Queries that show single rules over the given tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.functions import media as M
from shotline.functions import text as T
from shotline.operators import evaluate, search, session, shots
from shotline.plans import oracle
from shotline.plans.queries import _boxes, _turns, frames, placed, r6, table, vectors


def _video(n: F.Column) -> F.Column:
    return F.concat(F.lit("V"), F.lpad(n.cast("string"), 3, "0"), F.lit(".mp4"))


def stitched_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector gives the predictions of a window of a hundred frames, fifty after the one before."""
    e = table(spark, sf_dir, "embeddings")
    preds = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.get("embedding", (i % 64).cast("int")).cast("double"))
    rows = e.select(F.col("label").cast("string").alias("source_file"), (F.col("vec_id") * 50).alias("chunk_start"), F.when(F.col("vec_id") % 10 == 9, 30).otherwise(50).alias("valid"), preds.alias("preds"))
    return shots.stitch(rows).select("source_file", "frame_idx", r6("prob"))


def frame_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every eighth frame of each scene."""
    f = frames(spark, sf_dir)
    times = shots.scene_times(f)
    return shots.frame_step(f.select("point_id", "source_file", "frame_idx"), times, 25.0, 3.0).select("point_id", "source_file", "scene_id")


def shots_submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene that holds each event's time."""
    e = table(spark, sf_dir, "events")
    sent = e.select("event_id", _video(F.col("user_id") % 12).alias("source_file"), (F.col("event_id") % 400 / 10.0).alias("t"))
    times = shots.scene_times(frames(spark, sf_dir)).withColumn("shot_id", F.lpad(F.col("scene_id").cast("string"), 4, "0"))
    return evaluate.submissions_on_shots(sent, times).select("event_id", "shot_id")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each query: its hits are the first three, the purchases among fifty events its submissions."""
    q = vectors(spark, sf_dir)
    hits = placed(search.knn(q, frames(spark, sf_dir), 3), spark, sf_dir).filter("point_id <> query_id")
    truth = q.select("query_id", _video(F.col("label")).alias("source_file"))
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    sent = e.select((F.col("event_id") - F.col("event_id") % 50).alias("query_id"), _video(F.col("user_id") % 10).alias("source_file"))
    return evaluate.failures(truth, hits, sent, 3)


def verified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of questions answered YES, blended into scores of both types."""
    e = table(spark, sf_dir, "events")
    answers = e.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 40).alias("point_id"), F.when(F.col("event_type") == "view", " yes, clearly").when(F.col("event_type") == "click", "YES").otherwise("No").alias("raw"))
    ratios = evaluate.yes_ratio(answers)
    p = F.col("point_id")
    hits = answers.select("query_id", "point_id").distinct().select("query_id", "point_id", (1 / (60 + p)).alias("score"), F.when(p % 7 > 0, p % 11 / 10.0).alias("parsed"))
    one, two = (evaluate.rerank_score(hits, ratios, k).select("query_id", "point_id", F.col("rerank_score").alias(f"type_{k}")) for k in (1, 2))
    return one.join(two, ["query_id", "point_id"]).select("query_id", "point_id", r6("type_1"), r6("type_2"))


def public_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without local paths and malformed numbers."""
    i = F.col("event_id")
    idx = F.when(i % 5 == 0, "true").when(i % 5 == 1, F.concat(i.cast("string"), F.lit(".5"))).when(i % 5 == 2, F.concat(F.lit("-"), i.cast("string"))).when(i % 5 == 3, F.concat(i.cast("string"), F.lit(".0"))).otherwise(i.cast("string"))
    at = F.when(i % 3 == 0, "nan").when(i % 3 == 1, "12.5").otherwise("-1")
    payload = F.create_map(F.lit("keyframe_path"), F.lit("/a"), F.lit("frame_idx"), idx, F.lit("timestamp"), at, F.lit("props"), F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", T.public_payload(payload).alias("p"))
    return e.select("event_id", F.col("p")["frame_idx"].alias("frame_idx"), F.col("p")["timestamp"].alias("timestamp"), F.col("p")["props"].alias("props"), F.size("p").alias("n"))


def scene_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: event lists of responses, whatever shape they have."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit('```json\n{"actions": ["run", "a'), u, F.lit('"], "ordered_events": [{"action": "run", "time_sec": 1.5}, {"action": "b'), u, F.lit('", "time_sec": 2}]}\n```')))
        .when(i % 4 == 1, F.lit('{"actions": "run", "ordered_events": {"action": "run"}}')).when(i % 4 == 2, F.lit("sorry")).otherwise(F.concat(F.lit('{"actions": ["c'), u, F.lit('"]}')))
    )
    e = table(spark, sf_dir, "events").select("event_id", T.event_lists(raw).alias("l"))
    return e.select("event_id", F.array_join("l.actions", ",").alias("actions"), F.size("l.ordered_events").alias("n_events"), F.get("l.ordered_events", F.lit(1))["action"].alias("second"), F.get("l.ordered_events", F.lit(1))["time_sec"].alias("at"))


def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's words, from its search text or else from its parts."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    dets = F.array(F.struct(F.lit("Red Car").alias("label")), F.struct(F.lit(None).cast("string").alias("label")))
    said = T.candidate_text(F.when(i % 2 == 0, F.col("text")).when(i % 2 == 1, ""), F.concat(F.lit("Caption "), F.col("lang")), F.col("source"), F.lit(""), F.array(F.lit("Run")), dets)
    return d.select("doc_id", F.when(i % 2 == 1, said).alias("said"), F.size(T.tokens(said)).alias("n_words"))


def keyframes_of_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframe files of scenes; even videos have one a scene, odd ones some named by scene, some thrice."""
    f = frames(spark, sf_dir)
    times = shots.scene_times(f).withColumn("shot_id", F.concat(F.lit("Shot"), F.col("scene_id").cast("string"), F.lit("_")))
    even = F.substring("source_file", 4, 1).cast("int") % 2 == 0
    plain = times.filter(even).select("source_file", F.concat(F.lit("k"), F.lpad(F.col("scene_id").cast("string"), 4, "0"), F.lit(".jpg")).alias("name"))
    named = times.filter(~even & (F.col("scene_id") % 3 > 0)).select("source_file", F.explode(F.when(F.col("scene_id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).alias("x"), "scene_id")
    files = plain.unionByName(named.select("source_file", F.concat("x", F.lit("_shot"), F.col("scene_id").cast("string"), F.lit("_.jpg")).alias("name")))
    return shots.attach_keyframes(times.select("source_file", "shot_id", "start", "end"), files).select("source_file", "shot_id", "keyframe")


def video_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's best frames of its own video."""
    q = vectors(spark, sf_dir).withColumn("source_file", _video(F.col("label")))
    return search.in_video(q, frames(spark, sf_dir), 5).select("query_id", "point_id", r6("score"), "rank")


def gated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure enough boxes of frames with a region, as pixels of a frame of 64 x 48."""
    b = _boxes(spark, sf_dir).withColumnRenamed("vec_id", "point_id")
    regions = b.filter("point_id % 3 <> 0").select("point_id")
    kept = shots.on_regions(b, regions).select("point_id", F.posexplode(M.confident(F.col("dets"), 0.05)).alias("place", "d"))
    box = M.crop(F.col("d.bbox"), F.lit(64), F.lit(48))
    return kept.select("point_id", "place", *[box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def rewrite_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's transcript, with feedback on some turns, before its latest query."""
    t = _turns(spark, sf_dir)
    none = F.array().cast("array<string>")
    n = F.col("turn")
    t = t.withColumn("rejected", F.when(n % 3 == 0, F.array(F.lit("one"), F.concat(F.lit("r"), n.cast("string")))).otherwise(none)).withColumn("accepted", F.when(n % 4 == 0, F.array(F.lit("two"))).otherwise(none))
    latest = t.groupBy("session_id").agg(F.max_by("query", "turn").alias("query"))
    return session.rewrite_input(session.transcript(t), latest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (stitched_windows, frame_steps, shots_submitted, failure_classes, verified_scores, public_payloads, scene_events, candidate_words, keyframes_of_shots, video_search, gated_boxes, rewrite_inputs)
}

_TIMES = """m AS (SELECT source_file, scene_id, min(timestamp) AS start, max(timestamp) AS last FROM f GROUP BY ALL),
    times AS (SELECT source_file, scene_id, start, coalesce(lead(start) OVER (PARTITION BY source_file ORDER BY scene_id), last) AS stop FROM m)"""

SQL: dict[str, str] = {
    "stitched_windows": """WITH p AS (SELECT label::VARCHAR AS source_file, vec_id * 50 AS start, CASE WHEN vec_id % 10 = 9 THEN 30 ELSE 50 END AS valid, embedding, unnest(range(25, 75)) AS pos FROM embeddings)
        SELECT source_file, start + pos - 25 AS frame_idx, round(embedding[pos % 64 + 1]::DOUBLE, 6) AS prob FROM p WHERE pos < 25 + valid""",
    "frame_steps": f"""WITH {oracle._F}, {_TIMES} SELECT point_id, f.source_file, t.scene_id FROM f JOIN times t ON t.source_file = f.source_file AND frame_idx >= floor(start * 25) AND frame_idx < floor(stop * 25)
        WHERE (frame_idx - floor(start * 25)::BIGINT) % 8 = 0""",
    "shots_submitted": f"""WITH {oracle._F}, {_TIMES}, s AS (SELECT event_id, 'V' || lpad((user_id % 12)::VARCHAR, 3, '0') || '.mp4' AS source_file, (event_id % 400) / 10.0::DOUBLE AS t FROM events),
        j AS (SELECT s.event_id, lpad(scene_id::VARCHAR, 4, '0') AS shot_id FROM s JOIN times USING (source_file) WHERE t >= start AND t < stop) SELECT s.event_id, min(shot_id) AS shot_id FROM s LEFT JOIN j USING (event_id) GROUP BY s.event_id""",
    "failure_classes": f"""WITH {oracle._F}, {oracle._top('h', 'q', 'f', 3)}, t AS (SELECT query_id, 'V' || lpad(label::VARCHAR, 3, '0') || '.mp4' AS source_file FROM q),
        seen AS (SELECT DISTINCT h.query_id FROM h JOIN f USING (point_id) JOIN t ON t.query_id = h.query_id AND t.source_file = f.source_file WHERE h.point_id <> h.query_id),
        sent AS (SELECT DISTINCT t.query_id FROM events JOIN t ON t.query_id = event_id - event_id % 50 AND t.source_file = 'V' || lpad((user_id % 10)::VARCHAR, 3, '0') || '.mp4' WHERE event_type = 'purchase')
        SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM sent) THEN 'solved' WHEN query_id IN (SELECT query_id FROM seen) THEN 'not_submitted' ELSE 'never_retrieved' END AS outcome FROM t""",
    "verified_scores": """WITH a AS (SELECT user_id AS query_id, event_id % 40 AS point_id, avg((event_type IN ('view', 'click'))::INT) AS ratio FROM events GROUP BY ALL),
        h AS (SELECT *, 1 / (60 + point_id) AS score, CASE WHEN point_id % 7 > 0 THEN (point_id % 11) / 10.0::DOUBLE ELSE 0 END AS own FROM a)
        SELECT query_id, point_id, round(0.7::DOUBLE * own + 0.3::DOUBLE * ratio, 6) AS type_1, round(0.3::DOUBLE * score + 0.5::DOUBLE * own + 0.2::DOUBLE * ratio, 6) AS type_2 FROM h""",
    "public_payloads": """SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN event_id::VARCHAR END AS frame_idx, CASE WHEN event_id % 3 = 1 THEN '12.5' END AS timestamp, props,
        (1 + (event_id % 5 >= 3)::INT + (event_id % 3 = 1)::INT)::INTEGER AS n FROM events""",
    "scene_events": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'run,a' || user_id WHEN 3 THEN 'c' || user_id ELSE '' END AS actions, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END::INTEGER AS n_events,
        CASE WHEN event_id % 4 = 0 THEN 'b' || user_id END AS second, CASE WHEN event_id % 4 = 0 THEN 2.0::DOUBLE END AS at FROM events""",
    "candidate_words": rf"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 OR coalesce(text, '') = '' THEN lower(concat_ws(' ', nullif('Caption ' || lang, ''), nullif(source, ''), 'Run', 'Red Car')) ELSE lower(text) END AS said FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN said END AS said, len(list_filter({oracle._TOK.format("said")}, lambda w: NOT list_contains({oracle._STOPS}, w)))::INTEGER AS n_words FROM s""",
    "keyframes_of_shots": f"""WITH {oracle._F}, {_TIMES}, s AS (SELECT *, substr(source_file, 4, 1)::INT % 2 = 0 AS even FROM times)
        SELECT source_file, 'Shot' || scene_id || '_' AS shot_id, CASE WHEN even THEN 'k' || lpad(scene_id::VARCHAR, 4, '0') || '.jpg' WHEN scene_id % 3 = 1 THEN 'a_shot' || scene_id || '_.jpg' END AS keyframe FROM s""",
    "rewrite_inputs": """WITH n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        t AS (SELECT conv_id, turn, text, concat_ws(chr(10), CASE WHEN coalesce(text, '') <> '' THEN 'User: ' || text END, CASE WHEN r = 'assistant' AND coalesce(x, '') <> '' THEN 'System: ' || x END,
              CASE WHEN turn % 3 = 0 THEN 'Operator rejected: one; r' || turn END, CASE WHEN turn % 4 = 0 THEN 'Operator confirmed: two' END) AS t FROM n WHERE role = 'user'),
        s AS (SELECT conv_id, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') AS said, coalesce(arg_max(text, turn), '') AS latest FROM t GROUP BY conv_id)
        SELECT conv_id AS session_id, 'History:' || chr(10) || said || chr(10) || 'Latest Query: ' || latest || chr(10) || 'Rewritten Query:' AS input FROM s""",
    "video_search": f"""WITH {oracle._F}, s AS (SELECT query_id, point_id, round(list_cosine_similarity(q.v, f.v), 9) AS score FROM q JOIN f ON f.label = q.label),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INTEGER AS rank FROM s) {oracle._OUT} h WHERE rank <= 5""",
    "gated_boxes": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings WHERE vec_id % 3 <> 0), l AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e),
        s AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN hi > lo THEN round((x - lo) / (hi - lo) * 100, 3) ELSE 0 END) AS c FROM l),
        d AS (SELECT vec_id, list_filter([{", ".join(oracle._box(k) for k in range(8))}], lambda b: b.conf >= 0.05) AS d FROM s),
        u AS (SELECT vec_id AS point_id, unnest(range(0, len(d)))::INTEGER AS place, unnest(d) AS b FROM d),
        n AS (SELECT point_id, place, b.x1 >= 0 AND b.y1 >= 0 AND b.x2 <= 1 AND b.y2 <= 1 AS small, b FROM u),
        p AS (SELECT point_id, place, least(greatest(round_even(CASE WHEN small THEN b.x1 * 64 ELSE b.x1 END, 0), 0), 64)::INTEGER AS x1, least(greatest(round_even(CASE WHEN small THEN b.y1 * 48 ELSE b.y1 END, 0), 0), 48)::INTEGER AS y1,
              least(greatest(round_even(CASE WHEN small THEN b.x2 * 64 ELSE b.x2 END, 0), 0), 64)::INTEGER AS x2, least(greatest(round_even(CASE WHEN small THEN b.y2 * 48 ELSE b.y2 END, 0), 0), 48)::INTEGER AS y2 FROM n)
        SELECT point_id, place, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 ELSE 0 END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 ELSE 0 END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 ELSE 64 END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 ELSE 48 END AS y2 FROM p""",
}
