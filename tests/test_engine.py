"""The engine's operators against literal cases and brute force."""

import itertools
import json
import random
import uuid

from pyspark.sql import functions as F

from shotline.functions import ids, media, text
from shotline.operators import evaluate, fuse, session, shots, temporal
from shotline.sources import files, sinks
from shotline.streaming import log

SF = "/root/testdata/sf0.001"


def test_entry_has_rows_and_sql_names_match(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_islands(spark):
    p = [0.1, 0.9, 0.8, 0.1, 0.1, 0.9, 0.1]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(p)], "source_file string, frame_idx long, prob double")
    assert sorted((r.first_frame, r.last_frame) for r in shots.islands(df).collect()) == [(0, 0), (1, 4), (5, 6)]


def test_stitch_gives_each_frame_once(spark):
    rows = [("v", s, min(50, 130 - s), [float(s + k) for k in range(100)]) for s in range(0, 130, 50)]
    df = spark.createDataFrame(rows, "source_file string, chunk_start long, valid int, preds array<double>")
    assert sorted(r.frame_idx for r in shots.stitch(df).collect()) == list(range(130))


def test_uuid_equals_python(spark):
    names = ["V001.mp4:shot:000001", "a", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert all(str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) == r.u for r in got)


def test_nms_against_brute_force(spark):
    rng = random.Random(1)
    sets = []
    for i in range(30):
        boxes = []
        for _ in range(7):
            x, y = rng.uniform(0, 5), rng.uniform(0, 5)
            boxes.append((rng.choice("ab"), [x, y, x + rng.uniform(1, 5), y + rng.uniform(1, 5)], round(rng.random(), 3)))
        sets.append((i, boxes))

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    sets.append((99, [("a", [0.0, 0.0, 2.0, 1.0], 0.9), ("a", [0.0, 0.0, 2.0, 0.6], 0.8), ("b", [0.0, 0.0, 2.0, 0.6], 0.7)]))  # an overlap of 0.6 exactly
    df = spark.createDataFrame(sets, "i int, d array<struct<label:string,bbox:array<double>,conf:double>>")
    got = {r.i: [b.conf for b in r.k] for r in df.select("i", media.nms(F.col("d"), 0.3).alias("k")).collect()}
    for i, boxes in sets:
        kept = []
        for b in sorted(boxes, key=lambda b: (-b[2], b[0], b[1])):
            if not any(k[0] == b[0] and iou(k[1], b[1]) >= 0.3 for k in kept):
                kept.append(b)
        assert got[i] == [k[2] for k in kept]


def test_chain_against_brute_force(spark):
    rng = random.Random(2)
    schema = "query_id long, source_file string, frame_idx long, score double"
    lists = [[(1, "v", f, round(rng.random(), 2)) for f in rng.sample(range(400), 8)] for _ in range(3)]
    got = temporal.step_chain([spark.createDataFrame(x, schema) for x in lists], 150).collect()
    chains = [sum(c[3] for c in p) for p in itertools.product(*lists) if all(0 < b[2] - a[2] <= 150 for a, b in itertools.pairwise(p))]
    assert round(got[0].score, 9) == round(max(chains), 9) if chains else not got


def test_alignment_against_brute_force(spark):
    rng = random.Random(3)
    ev = [(1, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(3)]
    fr = [(1, i, "v", i * 4, [rng.gauss(0, 1) for _ in range(3)]) for i in range(7)]
    got = temporal.align_events(spark.createDataFrame(ev, "query_id long, event int, vector array<double>"), spark.createDataFrame(fr, "query_id long, point_id long, source_file string, frame_idx long, vector array<double>")).collect()[0]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    best = max(sum(cos(e[2], fr[j][4]) for e, j in zip(ev, js)) for js in itertools.combinations(range(7), 3))
    assert abs(got.score - best / 3) < 1e-6


def test_grounding_contract(spark):
    cases = {
        '{"found": true, "answer": "red", "confidence": 0.5}': None, "nope": "malformed_response", "[1]": "malformed_response",
        '{"found": "true", "answer": "x", "confidence": 1}': "answer_not_found", '{"found": true, "answer": "", "confidence": 1}': "missing_answer",
        '{"found": true, "answer": "Unknown", "confidence": 1}': "unknown_answer", '{"found": true, "answer": "x", "confidence": true}': "invalid_confidence",
        '{"found": true, "answer": "x", "confidence": 2}': "confidence_out_of_range", '{"found": true, "answer": "x", "confidence": "NaN"}': "confidence_out_of_range",
        '{"found": true, "answer": " na ", "confidence": 0.5}': "unknown_answer", '{"found": true, "answer": "x", "confidence": "much"}': "invalid_confidence", '{"found": true, "answer": 3, "confidence": 1}': "missing_answer", '```json\n{"found": true, "answer": "x", "confidence": "0.3"}\n```': None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.grounded(F.col("raw")).alias("g")).collect()
    assert {r.raw: r.g.reason for r in got} == cases


def test_dake_keeps_short_scenes_and_fills_gaps(spark):
    rows = [("v", 0, i, float(i == 9)) for i in range(20)] + [("v", 1, i, 1.0) for i in range(2)]
    out = shots.dake_keep(shots.dake_scores(spark.createDataFrame(rows, "source_file string, scene_id long, i long, size double")))
    kept = sorted(r.i for r in out.filter("kept and scene_id = 0").collect())
    assert all(b - a <= 4 for a, b in itertools.pairwise(kept)) and len(kept) >= 10
    assert out.filter("kept and scene_id = 1").count() == 2


def test_tied_scores_are_ambiguous_and_missing_videos_count(spark):
    rows = [(1, 1, 0.5, 1, None), (1, 2, 0.5, 2, None), (2, 3, 0.0, 1, "a")]
    got = {r.query_id: r for r in session.ambiguity(spark.createDataFrame(rows, "query_id int, point_id int, score double, rank int, source_file string")).collect()}
    assert got[1].margin == 1.0 and got[1].video_ratio == 0.5 and got[2].margin == 0.0


def test_sources_survive_malformed_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/v1.txt").write_text("# head\n\ns1\t0.0\t5.0\n6,9\nnot a shot\nx 5 5\n")
    got = sorted((r.shot_id, r.start, r.end) for r in files.shot_bounds(spark, str(tmp_path / "b")).collect())
    assert got == [("s1", 0.0, 5.0), ("shot000003", 6.0, 9.0)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"title": "t"}')
    (tmp_path / "m/b.json").write_text("nope")
    assert {r.source_file: r.meta for r in files.metadata(spark, str(tmp_path / "m")).collect()} == {"a": {"title": "t"}, "b": {}}


def test_upsert_twice_is_once(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "point_id int, source_file string, vector array<double>")
    sinks.upsert(df, p, 1)
    sinks.upsert(df.filter("source_file = 'a'"), p, 1)
    assert spark.read.parquet(p).count() == 2


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("search", 1, "q1", ["a", "b"]), ("clarify", 2, None, None), ("search", 3, "q2", None)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"session_id": "s", "action": a, "details": "d", "timestamp_ms": t, "query": q, "result_ids": r}) for a, t, q, r in rows))
    q = log.sessions(log.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r.turns, r.answers, r.queries_before, r.candidates) for r in spark.table("sess").orderBy("timestamp_ms").collect()]
    assert got == [(1, None, "", []), (1, None, "q1", ["a", "b"]), (2, "d", "q1", ["a", "b"])]


def test_streamed_points_of_one_video_in_two_batches_all_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "point_id int, source_file string, text string"
    for name, rows in (("a", [(1, "v", "x"), (2, "v", "y")]), ("b", [(2, "v", "z"), (3, "v", "w")])):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("point_id", "source_file", "text"), r))) for r in rows))
        q = log.upserting(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.point_id, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_first_sent_submission_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("t", "v", 1, False), ("t", "v", 2, True), ("t", "v", 3, True), ("t", "", 4, True), ("u", "v", 5, True)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"task": a, "video": v, "ts": f"2026-01-01T00:00:0{t}Z", "sent": s}) for a, v, t, s in rows))
    stream = spark.readStream.schema("task string, video string, ts timestamp, sent boolean").json(str(tmp_path / "in"))
    q = log.submitted_videos(stream).writeStream.format("memory").queryName("subs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.task, r.video) for r in spark.table("subs").collect()) == [("t", "v"), ("u", "v")]


def test_speech_files(spark, tmp_path):
    long = ",".join(f"w{i}" for i in range(40))
    (tmp_path / "a.csv").write_text(f'0.5,2.0, hello , world,,\n1,3,{long}\n2,1,late\n1,nan,x\n1,2,\n1,2\n3,4,"a, ""b"""\n')
    (tmp_path / "b.txt").write_text("0\t1\tone, two\tthree\n")
    (tmp_path / "c.tsv").write_text("0\t1\tx\n")
    got = sorted((r.source_file, r.start, r.end, r.text) for r in files.asr(spark, str(tmp_path)).collect())
    assert got == [("a", 0.5, 2.0, "hello world"), ("a", 1.0, 3.0, long.replace(",", " ")), ("a", 3.0, 4.0, 'a, "b"'), ("b", 0.0, 1.0, "one, two three"), ("c", 0.0, 1.0, "x")]


def test_exported_assets(spark, tmp_path):
    (tmp_path / "Objects/V1").mkdir(parents=True)
    (tmp_path / "Objects/V1/0007.json").write_text(json.dumps({"detection_boxes": [[0.1, 0.2, 0.3, 0.4], [1, 2, 3], [0, 0, 1, 1]], "detection_classes": [5, 6, 7], "detection_scores": [0.9, 0.8]}))
    (tmp_path / "Objects/V1/0008.json").write_text(json.dumps({"detection_boxes": [[0, 0, 1, 1]], "detection_classes": [5], "detection_class_names": ["cat"], "detection_scores": [0.5]}))
    (tmp_path / "Objects/V1/0009.json").write_text("{}")
    got = sorted((r.source_file, r.frame_id, r.label, r.bbox, r.conf) for r in files.detections(spark, str(tmp_path / "Objects")).collect())
    assert got == [("V1", "0007", "5", [0.2, 0.1, 0.4, 0.3], 0.9), ("V1", "0008", "cat", [0.0, 0.0, 1.0, 1.0], 0.5)]
    (tmp_path / "Keyframes/V2").mkdir(parents=True)
    (tmp_path / "Keyframes/V2/frame_index.json").write_text('{"0000.jpg": 120, "0001.jpg": 340}')
    got = sorted((r.source_file, r.name, r.native_idx) for r in files.keyframe_index(spark, str(tmp_path / "Keyframes")).collect())
    assert got == [("V2", "0000.jpg", 120), ("V2", "0001.jpg", 340)]


def test_manifest_and_work_list(spark, tmp_path):
    root = tmp_path / "keyframes/data"  # the root itself may lie in a folder of that name
    for name in ("a.MP4", "sub/b.jpg", "asr/c.mp3", "sub/objects/d.png", "e.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    assert sorted((r.name, r.kind) for r in files.manifest(spark, str(root)).collect()) == [("a.MP4", "video"), ("b.jpg", "image")]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/batch1.txt").write_text("http://h/x/One.ZIP\n\nhttp://h/two\nhttp://h/dir/\n")
    done = spark.createDataFrame([("batch1/two.done",), ("batch1/One",)], "path string")
    assert [r.key for r in files.work_list(spark, str(tmp_path / "lists"), done).collect()] == ["batch1/One"]


def test_upsert_is_by_id_and_rebuild_by_video(spark, tmp_path):
    p, schema = str(tmp_path / "t"), "point_id int, source_file string, n int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    sinks.upsert(rows((1, "a", 1), (2, "a", 1), (3, "b", 1)), p)
    sinks.upsert(rows((1, "a", 2), (1, "a", 3)), p, version="n")
    read = lambda: sorted((r.point_id, r.source_file, r.n) for r in spark.read.parquet(p).collect())
    assert read() == [(1, "a", 3), (2, "a", 1), (3, "b", 1)]
    sinks.rebuild(rows((9, "a", 9)), p)
    assert read() == [(3, "b", 1), (9, "a", 9)]


def test_result_files(spark, tmp_path):
    q = spark.createDataFrame([(1, 1), (2, 1)], "query_id int, type int")
    a = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "query_id int, rank int, answer string")
    assert {r.query_id: (r.result, r.results) for r in sinks.batch_results(q, a).collect()} == {1: ("x", ["x", "y"]), 2: ("N/A", [])}
    sinks.write_results(sinks.batch_results(q, a), str(tmp_path / "j"))
    sinks.write_first(q, a, str(tmp_path / "f"))
    sinks.write_ranked(a, str(tmp_path / "r"), 1)
    sinks.write_report(q, a, str(tmp_path / "rep"))
    sinks.append_log(q, str(tmp_path / "log"))
    sinks.append_log(q, str(tmp_path / "log"))
    lines = lambda d: sorted(r.value for r in spark.read.text(str(tmp_path / d)).collect())
    assert lines("f") == ["1,x", "2,N/A"] and lines("r") == ["1,1,x"] and len(lines("log")) == 4 and len(lines("j")) == len(lines("rep/summary")) == len(lines("rep/details")) == 2


def test_text_rules(spark):
    row = spark.createDataFrame([({"name": "N", "title": "T", "description": "", "x": "y", "keyframe_path": "/p", "frame_idx": "7.0", "timestamp": "nan"},)], "m map<string,string>")
    got = row.select(text.metadata_text(F.col("m")).alias("t"), text.public_payload(F.col("m")).alias("p")).first()
    assert got.t == "T . N" and got.p == {"name": "N", "title": "T", "description": "", "x": "y", "frame_idx": "7"}
    raws = ['{"questions": ["a?", " b? "]}', '{"questions": ["a?", ""]}', '["a?", "b?"]', '{"questions": ["a?", 3]}', "x", None]
    got = spark.createDataFrame([(r,) for r in raws], "r string").select(text.exactly(F.col("r"), 2).alias("q")).collect()
    assert [r.q for r in got] == [["a?", "b?"], [], [], [], [], []]
    raws = ['```json\n{"actions": ["run"], "ordered_events": [{"action": "run", "time_sec": 1.5}]}```', '{"actions": "run"}', "no"]
    got = [r.e for r in spark.createDataFrame([(r,) for r in raws], "r string").select(text.event_lists(F.col("r")).alias("e")).collect()]
    assert got[0].actions == ["run"] and [tuple(x) for x in got[0].ordered_events] == [("run", 1.5)] and [(e.actions, e.ordered_events) for e in got[1:]] == [([], []), ([], [])]
    df = spark.createDataFrame([("No, the xe là YES a", None, "3")], "t string, a string, b string")
    got = df.select(text.tokens(F.col("t")).alias("w"), text.seconds(F.col("a"), F.col("b")).alias("s")).first()
    assert got.w == ["no", "xe", "yes"] and got.s == 3.0
    c = spark.createDataFrame([("", "Cap", "nar", None, ["run"], [("Cat",), (None,)]), ("Blob", "x", None, None, None, None)], "t string, c string, n string, o string, a array<string>, d array<struct<label:string>>")
    assert [r[0] for r in c.select(text.candidate_text(*map(F.col, "tcnoad"))).collect()] == ["cap nar run cat", "blob"]


def test_boxes_and_regions(spark):
    from shotline.functions import hooks

    row = spark.range(1).select(media.crop(F.expr("array(0.1D, double('nan'), 0.5D, 0.9D)"), F.lit(100), F.lit(50)).alias("bad"), media.crop(F.expr("array(0.1D, 0D, 0.5D, 0.9D)"), F.lit(100), F.lit(50)).alias("good")).first()
    assert row.bad == [0, 0, 100, 50] and row.good == [10, 0, 50, 45]
    det = F.expr("array(named_struct('label', 'a', 'bbox', array(1D, 2D, 3D, 4D), 'conf', 0.2D), named_struct('label', 'a', 'bbox', array(1D, 2D, 3D, 4D), 'conf', 0.1D))")
    got = spark.range(1).select(hooks.on_frame(F.expr("array(10.7D, 5D, 30D, 40D)"), det, F.lit(100), F.lit(50)).alias("in_"), hooks.on_frame(F.expr("array(100D, 5D, 130D, 40D)"), det, F.lit(100), F.lit(50)).alias("out"), media.confident(det).alias("c"), hooks.merged_attributes(F.struct(F.lit("rain").alias("weather")), det).alias("m")).first()
    assert got.in_[0].bbox == [11.0, 7.0, 13.0, 9.0] and got.out == [] and len(got.c) == 1 and got.m.objects == ["a"] and got.m.weather == "rain" and len(got.m.detected_objects) == 2


def test_weak_boundaries_need_a_positive_mean_within(spark):
    rows = [("v", 0, 1, [1.0, 0.0]), ("v", 0, 2, [-1.0, 0.0]), ("v", 1, 3, [1.0, 0.0]), ("v", 1, 4, [-1.0, 0.0])]
    got = shots.boundary_similarity(spark.createDataFrame(rows, "source_file string, scene_id long, point_id long, vector array<double>")).first()
    assert got.within == -1.0 and got.weak is False


def test_merging_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    scenes, frame = [], []
    for v in range(4):
        at, base = 0.0, rng.normal(size=3)
        for s in range(14):
            length = float(rng.choice([0.4, 0.8, 2.0]))
            base = base if rng.random() < 0.7 else rng.normal(size=3)
            scenes.append((f"v{v}", s, round(at, 3), round(at + length, 3)))
            frame += [(f"v{v}", round(at + 0.2 * k, 3), (base + rng.normal(size=3) * 0.3).tolist()) for k in range(int(length / 0.2))]
            at += length

    def embeds(v, lo, hi):
        found = sorted((t, x) for w, t, x in frame if w == v and lo <= t < hi)
        return [np.array(x) / np.linalg.norm(x) for _, x in found]

    def pairwise(e):
        sims = [a @ b for a, b in itertools.combinations(e, 2)]
        return sum(sims) / len(sims) if sims else 1.0

    want = {}
    for v in {s[0] for s in scenes}:
        merged = [[i, i, a, b] for w, i, a, b in scenes if w == v]
        changed = True
        while changed:
            changed, i = False, 0
            while i < len(merged) - 1:
                cut = merged[i][3]
                a, b = embeds(v, max(merged[i][2], cut - 1.5), cut)[-3:], embeds(v, cut, min(merged[i + 1][3], cut + 1.5))[:3]
                within = (pairwise(a) + pairwise(b)) / 2
                if a and b and within > 0 and sum(x @ y for x in a for y in b) / len(a) / len(b) / within >= 0.9:
                    merged[i : i + 2] = [[merged[i][0], merged[i + 1][1], merged[i][2], merged[i + 1][3]]]
                    changed = True
                else:
                    i += 1
        want |= {(v, s): k for k, m in enumerate(merged) for s in range(m[0], m[1] + 1)}
    f = spark.createDataFrame(frame, "source_file string, timestamp double, vector array<double>")
    out = shots.merge_scenes(f, spark.createDataFrame(scenes, "source_file string, scene_id long, start double, end double")).collect()
    assert {(r.source_file, r.scene_id): r.merged for r in out} == want and 4 < len(set(want.items())) and max(want.values()) < 13


def test_diverse_keyframes_against_brute_force(spark):
    rng = random.Random(6)
    rows = [("v", s, i, i, [rng.gauss(0, 1) for _ in range(3)], rng.random(), 3) for s in range(3) for i in range(9 if s else 2)]
    got = {}
    for r in shots.diverse_keyframes(spark.createDataFrame(rows, "source_file string, scene_id long, point_id long, frame_idx long, vector array<double>, sharpness double, budget int")).collect():
        got.setdefault(r.scene_id, []).append((r.pick, r.point_id))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for s in range(3):
        rest = [r for r in rows if r[1] == s]
        kept = [rest.pop(0)]
        while len(kept) < 3 and rest:
            best = max(rest, key=lambda r: 1 - max(cos(r[4], k[4]) for k in kept) + 0.15 * r[5])
            kept.append(rest.pop(rest.index(best)))
        assert [p for _, p in sorted(got[s])] == [k[2] for k in kept]


def test_motion_samples_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows, want = [], set()
    for s in range(6):
        n = int(rng.integers(3, 60))
        times = np.cumsum(rng.uniform(0.05, 0.3, n)).round(3)
        energy = np.where(rng.random(n) < 0.5, 0, rng.exponential(size=n)).round(3) if s else np.zeros(n)
        rows += [("v", s, i, float(times[i]), float(energy[i])) for i in range(n)]
        k = int(min(16, max(4, round((times[-1] - times[0]) * 2.5))))
        if n <= k:
            want |= {(s, i) for i in range(n)}
            continue
        e = energy[:-1]
        w = np.maximum(e + (0.05 * e.mean() if e.mean() > 0 else 1.0), 1e-8)
        cdf = np.cumsum(w) / w.sum()
        for q in (np.arange(k) + 0.5) / k:
            seg = min(int(np.searchsorted(cdf, q)), len(w) - 1)
            before = cdf[seg - 1] if seg else 0.0
            t = times[seg] + (q - before) / (cdf[seg] - before) * (times[seg + 1] - times[seg])
            want.add((s, int(np.argmin(np.abs(times - t)))))
    got = shots.motion_samples(spark.createDataFrame(rows, "source_file string, scene_id long, i long, timestamp double, energy double"))
    assert {(r.scene_id, r.i) for r in got.collect()} == want


def test_keyframes_of_shots(spark):
    s = spark.createDataFrame([("a", "s1", 0.0, 1.0), ("a", "s2", 1.0, 2.0), ("b", "Shot1", 0.0, 1.0), ("b", "x", 1.0, 2.0), ("b", "zz", 2.0, 3.0), ("c", "q", 0.0, 1.0)], "source_file string, shot_id string, start double, end double")
    f = spark.createDataFrame([("a", "2.jpg"), ("a", "1.jpg"), ("b", "v_shot1.jpg"), ("b", "x1.jpg"), ("b", "x2.jpg"), ("b", "jpg.jpg")], "source_file string, name string")
    got = {(r.source_file, r.shot_id): r.keyframe for r in shots.attach_keyframes(s, f).collect()}
    assert got == {("a", "s1"): "1.jpg", ("a", "s2"): "2.jpg", ("b", "Shot1"): "v_shot1.jpg", ("b", "x"): None, ("b", "zz"): None, ("c", "q"): None}
    probs = spark.createDataFrame([("v", i, x) for i, x in enumerate([0.1, 0.9, 0.1, 0.2])] + [("w", 0, 0.9)], "source_file string, frame_idx long, prob double")
    got = sorted((r.source_file, r.start, r.end) for r in shots.shot_seconds(probs, 2.0).collect())
    assert got == [("v", 0.0, 0.5), ("v", 0.5, 2.0), ("w", 0.0, 0.5)]
    assert [r.point_id for r in shots.on_regions(spark.createDataFrame([(1,), (2,)], "point_id int"), spark.createDataFrame([(2,), (2,)], "point_id int")).collect()] == [2]


def test_sequence_recall_takes_the_first_sequence_of_the_video(spark):
    found = spark.createDataFrame([(1, 1, "w", [1], [0.1]), (1, 2, "v", [10, 90], [1.0, 9.0]), (1, 3, "v", [50, 60], [5.0, 6.0]), (2, 1, "v", None, [4.0, 3.0])], "query_id int, rank int, source_file string, frames array<long>, times array<double>")
    truth = spark.createDataFrame([(1, "v", [(50, 5.0), (12, 1.2)]), (2, "v", [(7, 4.5), (None, 9.0)]), (3, "v", [(1, 1.0)])], "query_id int, source_file string, events array<struct<frame_id:long,timestamp:double>>")
    got = {r.query_id: (r.video_rank, r.sequence_recall, r.in_order) for r in evaluate.sequences(found, truth).collect()}
    assert got == {1: (2, 0.5, True), 2: (1, 0.5, False), 3: (None, None, None)}


def test_evidence_gate_and_budgets(spark):
    good = '{"found": true, "answer": "red", "confidence": 0.5}'
    c = spark.createDataFrame([(1, 1, "a", good), (1, 2, "b", good), (1, 3, "a", "x"), (1, 4, "a", None)], "query_id int, point_id int, source_file string, raw string")
    got = {r.point_id: (r.vqa_valid, r.vqa_answer, r.vqa_score, r.vqa_reason) for r in evaluate.evidence(c, spark.createDataFrame([("a",)], "name string")).collect()}
    assert got == {1: (True, "red", 0.5, "grounded"), 2: (False, "UNKNOWN", 0.0, "frame_unavailable"), 3: (False, "UNKNOWN", 0.0, "malformed_response"), 4: (False, "UNKNOWN", 0.0, "malformed_response")}
    runs = spark.createDataFrame([("i", 100, 90.0, "n/a", 1.0, "a cat"), ("i", 200, 180.0, "170", 2.0, "a cat sat"), ("j", 200, 190.0, "190", 4.0, "dog")], "image string, budget int, estimate double, measured string, seconds double, caption string")
    got = {r.budget: (r.mean_measured, r.mean_similarity, r.n) for r in evaluate.token_budgets(runs).collect()}
    assert got == {100: (None, 0.714, 1), 200: (180.0, 1.0, 2)}


def test_scores_and_failures(spark):
    answers = spark.createDataFrame([(1, 1, " yes."), (1, 1, "no"), (1, 2, "YES")], "query_id int, point_id int, raw string")
    ratios = evaluate.yes_ratio(answers)
    hits = spark.createDataFrame([(1, 1, 0.5, 0.8), (1, 2, 0.5, None), (1, 3, 0.5, 1.0)], "query_id int, point_id int, score double, parsed double")
    score = lambda **k: {r.point_id: round(r.rerank_score, 6) for r in evaluate.rerank_score(hits, **k).collect()}
    assert score() == {1: 0.8, 2: 0.0, 3: 1.0} and score(kind=2) == {1: 0.68, 2: 0.2, 3: 0.8}
    assert score(ratios=ratios) == {1: 0.71, 2: 0.3, 3: 1.0} and score(ratios=ratios, kind=2) == {1: 0.65, 2: 0.35, 3: 0.85}
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "query_id int, source_file string")
    found = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "query_id int, source_file string, rank int")
    out = evaluate.failures(truth, found, spark.createDataFrame([(1, "a")], "query_id int, source_file string")).collect()
    assert {r.query_id: r.outcome for r in out} == {1: "solved", 2: "not_submitted", 3: "never_retrieved"}
    on = evaluate.submissions_on_shots(spark.createDataFrame([("v", 59.0), ("v", 61.0), ("v", 210.0), ("w", 1.0)], "source_file string, t double"), spark.createDataFrame([("v", "s1", 0.0, 60.0), ("v", "s2", 60.0, 200.0)], "source_file string, shot_id string, start double, end double"))
    assert sorted((r.source_file, r.t, r.shot_id) for r in on.collect()) == [("v", 59.0, "s1"), ("v", 61.0, "s2"), ("v", 210.0, None), ("w", 1.0, None)]
    cov = evaluate.coverage(spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id int, source_file string, rank int")).first()
    assert cov.videos == 2 and abs(cov.duplicate_rate - 1 / 3) < 1e-9


def test_sessions_in_batch(spark):
    t = spark.createDataFrame([("s", 1, "User: a")], "session_id string, turn int, transcript string")
    q = spark.createDataFrame([("s", "q"), ("n", "r")], "session_id string, query string")
    got = {r.session_id: r.input for r in session.rewrite_input(t, q).collect()}
    assert got == {"s": "History:\nUser: a\nLatest Query: q\nRewritten Query:", "n": "History:\n\nLatest Query: r\nRewritten Query:"}
    c = spark.createDataFrame([("s", 2, "y"), ("s", 1, "x")], "session_id string, place int, line string")
    assert "1. x\n2. y" in {r.session_id: r.input for r in session.model_input(t, q, c).collect()}["s"]
    p = session.pending_clarification(spark.createDataFrame([("s", 1, "c1"), ("s", 2, None), ("s", 3, None)], "session_id string, turn int, clarification string")).orderBy("turn").collect()
    assert [r.answers for r in p] == [None, "c1", None]
    hits = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, None), (1, 4, 4, "b")], "query_id int, point_id int, rank int, source_file string")
    assert [r.point_id for r in session.clarification_candidates(hits, 2).orderBy("place").collect()] == [1, 3]
    subs = spark.createDataFrame([(1, "v", 1, 1, True, None), (1, "v", 2, 2, True, None), (1, "v", 3, 3, False, True)], "task int, video string, ts int, id int, accepted boolean, forced boolean")
    assert [r.duplicate for r in session.duplicate_videos(subs).orderBy("id").collect()] == [False, True, False]
    boosted = session.clarification_boost(
        spark.createDataFrame([(1, 1, 0.4, 1, "a blue bus"), (1, 2, 0.3, 2, "the Red car"), (1, 3, 0.2, 3, "red car")], "query_id int, point_id int, score double, rank int, text_blob string"),
        spark.createDataFrame([(1, 2)], "query_id int, point_id int"), spark.createDataFrame([(1, "the car is red fast")], "query_id int, answer string"),
    )
    assert [(r.point_id, round(r.boosted, 6), r.overlap) for r in boosted.orderBy("rank").collect()] == [(2, 0.433333, 0.667), (1, 0.4, 0.0), (3, 0.2, 0.0)]


def test_steps_share_videos(spark):
    schema = "query_id int, source_file string, frame_idx int, score double"
    steps = [spark.createDataFrame(x, schema) for x in ([(1, "a", 1, 1.0), (1, "b", 1, 1.0)], [(1, "b", 2, 1.0), (2, "a", 2, 1.0)])]
    assert [[(r.query_id, r.source_file) for r in s.collect()] for s in temporal.in_every_step(steps)] == [[(1, "b")], [(1, "b")]]
    best = fuse.best_videos(spark.createDataFrame([(1, "a", 1, 0.2), (1, "b", 1, 0.9), (1, "a", 2, 0.5), (1, None, 3, 2.0)], schema), 1)
    assert [(r.source_file, r.score) for r in best.collect()] == [("b", 0.9)]
    names = ["caption", "x"]
    old, new = (spark.createDataFrame(r, "point_id int, v string") for r in ([(1, "o"), (2, "o")], [(2, "n"), (3, "n")]))
    assert sorted((r.point_id, r.v) for r in fuse.merge_first_wins(old, new, ["point_id"]).collect()) == [(1, "o"), (2, "o"), (3, "n")] and names


def test_index_build_is_what_its_steps_say(spark):
    from shotline.functions import vectors as V
    from shotline.plans import queries

    c = queries._candidates(spark, SF)
    kept = shots.dake_keep(shots.dake_scores(c.withColumn("i", F.col("frame_idx")))).filter("kept")
    by_scene = {}
    for r in shots.sharpness(kept).orderBy("frame_idx").collect():
        by_scene.setdefault((r.source_file, r.scene_id), []).append(r)
    want = {}
    for key, rows in by_scene.items():
        v = [[x for x in r.vector] for r in rows]
        mean = [sum(x) / len(v) for x in zip(*v)]
        var = sum((x - m) ** 2 for r in v for x, m in zip(r, mean)) / len(v) / len(mean)
        budget = 1 if var < 0.01 else 2 if var < 0.05 else min(8, max(1, int(var * 100)))
        want[key] = min(budget, len(rows))
    got = {}
    out = queries._index(spark, SF).collect()
    for r in out:
        got[r.source_file, r.scene_id] = got.get((r.source_file, r.scene_id), 0) + 1
        assert r.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.source_file}:{r.frame_idx}"))
        assert f"Title {r.source_file} . frames" in r.text_blob and "act" in r.text_blob
        even = int(r.source_file[3]) % 2 == 0
        assert r.shot_id == (f"{r.source_file}:s{r.scene_id}" if even else f"{r.source_file}:shot:{r.scene_id:06d}")
    assert got == want
    parents = queries.index_shots(spark, SF).collect()
    assert sum(r.frame_count for r in parents) == len(out) and all(abs(r.norm - 1) < 1e-6 for r in parents) and V


def test_avs_score(spark):
    rows = [(1, 1, "a", True), (1, 1, "b", False), (2, 1, "c", True)]
    got = {r.team: r.score for r in evaluate.avs_scores(spark.createDataFrame(rows, "team int, task int, video string, correct boolean")).collect()}
    assert round(got[1], 6) == 400.0 and round(got[2], 6) == 500.0


def test_knn_cells_recall(spark):
    from shotline.operators import search
    from shotline.plans import queries

    sf = "/root/testdata/sf0.01"
    want = {(r.query_id, r.point_id) for r in search.knn(queries.vectors(spark, sf), queries.frames(spark, sf), 10).collect()}
    got = {(r.query_id, r.point_id) for r in queries.knn_cells(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_queries_take_the_whole_job(spark, monkeypatch):
    from shotline.plans import queries

    f = queries.frames(spark, SF)
    enough = {r.source_file for r in f.groupBy("source_file").count().filter("count >= 3").collect()}
    assert {r.source_file for r in queries.event_alignment(spark, SF).collect()} == enough and max(enough) > "V003"
    budget = {(r.source_file, r.scene_id): min(r.budget, r.n) for r in queries.scene_variance(spark, SF).collect()}
    picks = {(r.source_file, r.scene_id): r["count"] for r in queries.diverse_keyframes(spark, SF).groupBy("source_file", "scene_id").count().collect()}
    assert picks == budget and set(budget.values()) != {3}
    seen = []
    monkeypatch.setattr(session, "clarification_boost", lambda tok, prior, answers: seen.append(answers) or tok.selectExpr("query_id", "point_id", "score overlap", "score boosted", "rank"))
    queries.clarification_boost(spark, SF)
    texts = {r.doc_id - 1: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 100 = 1").collect()}
    assert {r.query_id: r.answer for r in seen[0].collect()} == texts
