"""Searches, scans and joins on long videos and awkward rows, against brute force; one video is many blocks here."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.operators import blocks, boxes, cells, evaluate, postings, search, shots, temporal

FRAME = "point_id long, vector array<double>"


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0, 9)


def best(q, rows, k):
    ok = [(p, v) for p, v in rows if v is not None and len(v) == len(q) and all(x is not None and math.isfinite(x) for x in v)]
    return sorted(((-cos(q, v), p) for p, v in ok))[:k]


def test_knn_leaves_out_what_cannot_be_compared(spark):
    f = spark.createDataFrame([(1, [1.0, None]), (3, [0.0, 1.0])], FRAME)
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<double>")
    assert [(r.point_id, r.rank) for r in search.knn(q, f, 2).collect()] == [(3, 1)]


def test_knn_against_brute_force_on_ragged_rows(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda n: [round(rng.gauss(0, 1), 1) for _ in range(n)]
    rows = [(i, vector(rng.choice([3, 3, 3, 3, 2, 4, 0]))) for i in range(700)] + [(1000 + i, [1.0, 0.0, 0.0]) for i in range(400)]
    rows += [(2000, None), (2001, [1.0, None, 0.0]), (2002, [float("nan"), 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0]), (2004, [0.0, 0.0, 0.0])]
    asks = [(f"q{i}", vector(3)) for i in range(40)] + [("short", [1.0, 0.0]), ("null", None), ("nan", [float("nan"), 1.0, 1.0]), ("zero", [0.0, 0.0, 0.0])]
    f, q = spark.createDataFrame(rows, FRAME).repartition(5), spark.createDataFrame(asks, "query_id string, vector array<double>")
    want = {(i, n + 1, p, -s) for i, v in asks if i[0] == "q" or i == "zero" for n, (s, p) in enumerate(best(v, rows, 7))}
    for slices in ((4096, 256), (16, 3)):
        monkeypatch.setattr(search, "ROWS", slices[0])
        monkeypatch.setattr(search, "QUERIES", slices[1])
        assert {(r.query_id, r.rank, r.point_id, r.score) for r in search.knn(q, f, 7).collect()} == want
    monkeypatch.setattr(search, "BLOCK_QUERIES", 10)
    assert {(r.query_id, r.rank, r.point_id, r.score) for r in search.knn(q, f, 7).collect()} == want
    assert search.knn(q.limit(0), f, 7).count() == 0 and search.knn(q, f.limit(0), 7).count() == 0
    few = search.knn(q.filter("query_id = 'q1'"), f, 5000)
    assert few.count() == len(best(dict(asks)["q1"], rows, 5000))


def test_search_within_a_hot_video(spark, monkeypatch):
    monkeypatch.setattr(search, "SIDE", 8)
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"v{i % 5}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)] + [(900, "hot", None), (901, "hot", [1.0]), (902, None, [1.0, 0.0, 0.0])]
    asks = [(i, "hot" if i % 4 else "v0", [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    f = spark.createDataFrame(rows, "point_id long, source_file string, vector array<double>")
    q = spark.createDataFrame(asks, "query_id long, source_file string, vector array<double>")
    got = {(r.query_id, r.rank, r.point_id) for r in search.in_video(q, f, 4).collect()}
    assert got == {(i, n + 1, p) for i, s, v in asks for n, (_, p) in enumerate(best(v, [(p, x) for p, y, x in rows if y == s], 4))}
    hits = search.knn(q, f, 6)
    wider = search.refine_in_videos(q, hits, f, 2, 3).collect()
    had = {}
    for r in hits.collect():
        had.setdefault(r.query_id, {})[r.point_id] = r.score
    place = {p: s for p, s, _ in rows}
    for i, _, v in asks:
        videos = {}
        for p, s in had[i].items():
            videos[place[p]] = max(videos.get(place[p], -9), s)
        top = sorted(videos, key=lambda s: (-videos[s], s))[:2] if None not in videos else sorted((s for s in videos if s), key=lambda s: (-videos[s], s))[:2]
        fresh = {p for s in top for _, p in best(v, [(p, x) for p, y, x in rows if y == s and p not in had[i]], 3)}
        mine = {r.point_id for r in wider if r.query_id == i}
        if None not in videos:
            assert mine == set(had[i]) | fresh


def test_ranks_are_counted_anew(spark):
    h = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, point_id int, rank int")
    assert [(r.point_id, r.rank) for r in search.renumbered(h.filter("point_id <> 5"), 1).collect()] == [(6, 1)]


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_alignment_of_one_long_video_in_blocks(spark, span):
    rng = random.Random(6)
    pick = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(2)]  # noqa: E731  many ties
    ev = [(q, i, pick()) for q, n in ((1, 3), (2, 1), (3, 4)) for i in range(n)]
    fr = [(i, "long", i * 2, i * 0.5, pick()) for i in range(50)] + [(100 + i, "short", i, float(i), pick()) for i in range(2)] + [(200, "long", 7, 0.0, None)]
    f = spark.createDataFrame(fr, "point_id long, source_file string, frame_idx long, timestamp double, vector array<double>")
    e = spark.createDataFrame(ev, "query_id long, event int, vector array<double>")
    want = {}
    for q in (1, 2, 3):
        own = [v for i, _, v in ev if i == q]
        for video in ("long", "short"):
            rows = [(n, v) for _, s, n, _, v in fr if s == video and v is not None]
            state = [(cos(own[0], v), [n]) for n, v in rows]
            for x in own[1:]:
                new = []
                for j, (n, v) in enumerate(rows):
                    before = [s for s in state[:j] if s]
                    new.append(None if not before else (lambda b, n=n, v=v, x=x: (round(b[0] + cos(x, v), 9), [*b[1], n]))(max(before, key=lambda s: (s[0], s[1][::-1]))))
                state = new
            done = [s for s in state if s]
            if done:
                t, path = max(done, key=lambda s: (s[0], s[1][::-1]))
                want[q, video] = (round(t / len(own), 9), path)
    got = {(r.query_id, r.source_file): (round(r.score, 9), r.frames) for r in temporal.align_events(e, f, span=span).collect()}
    assert got == want
    pairs = spark.createDataFrame([(1, "long"), (3, "long"), (2, "short"), (2, "none")], "query_id long, source_file string")
    some = {(r.query_id, r.source_file): (round(r.score, 9), r.frames) for r in temporal.align_events(e, f, pairs, span).collect()}
    assert some == {k: v for k, v in want.items() if k in {(1, "long"), (3, "long"), (2, "short")}}


def signal(n=400, seed=8):
    rng = random.Random(seed)
    return [("v", 0, i * 3, round(i * 0.2, 3), rng.choice([0.1, 0.4, 0.6, 0.9]), float(rng.randrange(4) if i % 50 < 25 else 1)) for i in range(n)] + [(None, 1, i, float(i), 0.9, 1.0) for i in range(3)]


@pytest.mark.parametrize("span", [1, 60, 100_000])
def test_scans_of_one_long_scene_in_blocks(spark, span):
    """As many as 400 blocks of one video give what one block gives; that is held against plain loops."""
    rows = signal()
    df = spark.createDataFrame(rows, "source_file string, scene_id long, i long, timestamp double, prob double, size double")
    probs = df.select("source_file", F.col("i").alias("frame_idx"), "prob")
    got = {(r.source_file, r.shot, r.first_frame, r.last_frame) for r in shots.islands(probs, span=span).collect()}
    want = set()
    for video in ("v", None):
        own = [(i, p > 0.5) for s, _, i, _, p, _ in rows if s == video]
        cut = [0] + [j for j in range(1, len(own)) if own[j][1] and not own[j - 1][1]] + [len(own)]
        want |= {(video, n, own[a][0], own[b - 1][0]) for n, (a, b) in enumerate(itertools.pairwise(cut))}
    assert got == want
    scored = shots.dake_scores(df.select("source_file", "scene_id", "i", "size"), span=span)
    dake = {}
    for video in ("v", None):
        own = [(i, x) for s, _, i, _, _, x in rows if s == video]
        most = max(x for _, x in own)
        for j, (i, x) in enumerate(own):
            d = [(100 * abs(x - own[k][1]) / most, abs(k - j)) for k in range(max(0, j - 3), min(len(own), j + 4)) if k != j]
            dake[video, i] = sum(a / math.sqrt(g * g + a * a) for a, g in d)
    assert {(r.source_file, r.i): round(r.dake, 9) for r in scored.collect()} == {k: round(v, 9) for k, v in dake.items()}
    kept = {(r.source_file, r.i) for r in shots.dake_keep(scored, span=span).filter("kept").collect()}
    want = set()
    for video in ("v", None):
        own = sorted(i for s, i in dake if s == video)
        top = set(sorted(own, key=lambda i: (-round(dake[video, i], 9), i))[: round(len(own) * 0.5)])
        last = -1
        for pos, i in enumerate(own):
            if i in top or (pos - last) % 4 == 0 or len(own) <= 2:
                want.add((video, i))
            if i in top:
                last = pos
    assert kept == want
    moved = df.select("source_file", "scene_id", "i", "timestamp", F.col("size").alias("energy"))
    one = {(r.source_file, r.i) for r in shots.motion_samples(moved, span=10**9).collect()}
    assert {(r.source_file, r.i) for r in shots.motion_samples(moved, span=span).collect()} == one and len(one) == 16 + 3


def test_long_videos_are_many_tasks(spark):
    df = spark.createDataFrame(signal(4000), "source_file string, scene_id long, i long, timestamp double, prob double, size double")
    cut = blocks.cut(df, "i", 100).select("source_file", blocks.BLOCK).distinct()
    assert cut.filter("source_file = 'v'").count() >= 16


def test_nodes_cover_an_interval_once(spark):
    cases = [(0, 0), (0, 7), (3, 9), (-5, 6), (1, 1), (5, 4), (10, 10 + 3600 * 24 * 365), (-9, -1), (7, 8)]
    got = spark.createDataFrame(cases, "lo long, hi long").select("lo", "hi", temporal.nodes(F.col("lo"), F.col("hi")).alias("n")).collect()
    for r in got:
        spans = sorted((x.node << x.level, ((x.node + 1) << x.level) - 1) for x in r.n)
        if r.hi < r.lo:
            assert not spans
            continue
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(spans))
        assert len(spans) <= 2 * max(1, (r.hi - r.lo + 1).bit_length())


def test_interval_join_against_brute_force(spark):
    rng = random.Random(9)
    year = 3600.0 * 24 * 365
    spans = [(s, f"t{i}", a := round(rng.uniform(-50, 500), 1), round(a + rng.choice([0, 0.5, 3, 40, 300]), 1)) for i in range(60) for s in ["vw"[i % 2]]] + [("v", "year", -1000.0, year), ("v", "back", 5.0, 1.0), ("w", "null", None, 3.0)]
    points = [(i, "v" if i % 3 else "w", round(rng.uniform(-60, 560), 1)) for i in range(200)] + [(999, "v", year), (998, "v", year + 0.1), (997, "v", None), (996, None, 1.0)]
    p = spark.createDataFrame(points, "point_id long, source_file string, timestamp double")
    s = spark.createDataFrame(spans, "source_file string, text string, start double, end double")
    for width in (1.0, 30.0, 0.3):
        got = sorted((r.point_id, r.text) for r in temporal.interval_join(p, s, ["source_file"], "timestamp", "start", "end", width).collect())
        assert got == sorted((i, t) for i, x, at in points for y, t, a, b in spans if x == y and at is not None and a is not None and a <= at <= b)
    speech = {r.point_id: (r.speech, r.n_segments) for r in temporal.attach_speech(p, s.filter("start is not null"), 3.0).collect()}
    for i, x, at in points:
        own = sorted((a, t) for y, t, a, b in spans if x == y and at is not None and a is not None and a - 3 <= at <= b + 3)
        assert speech[i] == (" ".join(t for _, t in own), len(own))
    on = evaluate.submissions_on_shots(p.select("point_id", "source_file", F.col("timestamp").alias("t")), s.filter("start is not null").withColumnRenamed("text", "shot_id"))
    for r in on.collect():
        own = sorted(t for y, t, a, b in spans if r.source_file == y and r.t is not None and a is not None and a <= r.t < b)
        assert r.shot_id == (own[0] if own else None)
    assert temporal.interval_join(p, s.limit(0), ["source_file"], "timestamp", "start", "end").count() == 0


def test_lists_are_coded_and_decoded():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 65_536, n)) for n in (1, 2, 500, 30_000)] + [np.array([0]), np.array([65_535]), np.arange(65_536)]
    begin = np.cumsum([0, *[len(x) for x in lists]])[:-1]
    blobs = postings.encode(np.concatenate(lists), begin).to_pylist()
    assert all((postings.decode(b) == x).all() for b, x in zip(blobs, lists, strict=True))
    assert len(blobs[-1]) == 65_536 and len(blobs[2]) < 4 * 500


@pytest.mark.parametrize("ids", ["long", "string"])
def test_token_match_against_brute_force(spark, monkeypatch, tmp_path, ids):
    monkeypatch.setattr(postings, "RANGE", 16)
    monkeypatch.setattr(postings, "ASKS", 5)
    rng = random.Random(10)
    words = ["the", "cat", "Đường", "été", "x1", "dog_2", "a", "red", "sky"]
    name = (lambda i: i) if ids == "long" else (lambda i: f"p{i:03d}")
    texts = [(name(i), " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(150)] + [(name(150), None), (name(151), ""), (None, "the cat"), (name(152), "THE the Cat-dog_2"), (name(5), "sky red red")]
    asks = [(i, " ".join(rng.choices(words, k=rng.randrange(5)))) for i in range(30)] + [(90, None), (91, "nowhere the"), (92, "a"), (93, "THE")]
    t = spark.createDataFrame(texts, f"point_id {ids}, text_blob string").repartition(4)
    q = spark.createDataFrame(asks, "query_id long, text string")
    split = lambda x: {w for w in re.findall(r"\w+", (x or "").lower()) if len(w) >= 2}
    want = set()
    for i, x in asks:
        own = sorted({p for p, y in texts if p is not None and split(x) and split(x) <= set().union(*[split(z) for o, z in texts if o == p])})
        want |= {(i, p, n + 1) for n, p in enumerate(own[:6])}
    postings.build(t, str(tmp_path / "index"))
    index = postings.load(spark, str(tmp_path / "index"))  # outlives its builder
    assert {(r.query_id, r.point_id, r.rank) for r in postings.match(index, q, 6).collect()} == want
    every = postings.token_match(q, t, None)
    assert {(r.query_id, r.point_id, r.rank) for r in every.filter("rank <= 6").collect()} == want and every.filter("rank > 6").count() > 0
    assert postings.token_match(q, t.limit(0)).count() == 0 and postings.token_match(q.limit(0), t).count() == 0


def test_cells_are_visited_in_order_of_bounds(spark, tmp_path):
    """Frames in forty tight groups: an exact search reads fewer than half of the cells, and any effort finds nearly all."""
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 25, axis=0) + rng.normal(size=(1000, 16)) * 0.1
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 16), (5003, [0.0] * 16), (5004, rows0 := [float(c) for c in x[3]]), (5005, rows0)]
    asks = [(i, [float(c) for c in x[i] + 0.01]) for i in range(0, 1000, 50)] + [(7777, None)]
    f, q = spark.createDataFrame(rows, FRAME), spark.createDataFrame(asks, "query_id long, vector array<double>")
    cells.build(f, str(tmp_path / "cells"), 40)
    index = cells.load(spark, str(tmp_path / "cells"))  # outlives its builder
    n = index.centres.count()
    want = {(r.query_id, r.point_id, r.rank) for r in search.knn(q, f, 10).collect()}
    hits, reads = cells.search(index, q, 10)
    assert {(r.query_id, r.point_id, r.rank) for r in hits.collect()} == want
    assert sum(r.cells for r in reads.collect()) < n / 2 * reads.count() and reads.count() == 20
    for effort in (2, 4, 8):
        part, reads = cells.search(index, q, 10, effort)
        assert len({(r.query_id, r.point_id) for r in part.collect()} & {x[:2] for x in want}) >= 0.9 * len(want) and {r.cells for r in reads.collect()} == {effort}
    whole, _ = cells.search(index, q, 10, n)
    assert {(r.query_id, r.point_id, r.rank) for r in whole.collect()} == want
    none = cells.build(f.limit(0))
    assert cells.search(none, q, 10)[0].count() == 0 and cells.search(index, q.limit(0), 10)[0].count() == 0


@pytest.mark.parametrize(("least", "by_label"), [(0.3, True), (0.5, False), (1.0, True), (0.05, False)])
def test_suppression_in_rounds_against_one_by_one(spark, least, by_label):
    rng = random.Random(15)
    rows = []
    for frame in range(6):
        for _ in range(60):
            x, y, s = rng.uniform(-20, 40), rng.uniform(-20, 40), rng.choice([0.3, 3, 30, 30, 200])
            rows.append((frame, rng.choice("ab"), [x, y, x + s * rng.uniform(0.4, 1), y + s * rng.uniform(0.4, 1)], round(rng.random(), 2)))
    rows += [(1, "a", [5.0, 5.0, 5.0, 9.0], 0.9), (1, "a", [5.0, 5.0, 5.0, 9.0], 0.9), (2, "a", [0.0, 0.0, 8.0, 8.0], 0.99), (2, "a", [0.0, 0.0, 8.0, 8.0], 0.99), (2, "b", [float("nan"), 0.0, 1.0, 1.0], 0.1)]

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0.0) * max(h, 0.0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    want = []
    for frame in range(6):
        kept = []
        for b in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[3], r[1], r[2])):
            if not any((k[1] == b[1] or not by_label) and overlap(k[2], b[2]) >= least for k in kept):
                kept.append(b)
        want += kept
    df = spark.createDataFrame(rows, "frame_id int, label string, bbox array<double>, conf double").repartition(5)
    got = boxes.suppress(df, least, by_label)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert boxes.suppress(df.limit(0), least).count() == 0


def test_tiles_and_their_boxes(spark):
    f = spark.createDataFrame([("f", 1000, 600)], "frame_id string, width int, height int")
    assert sorted((r.x, r.y) for r in boxes.tiles(f, 640, 0.2).collect()) == [(0, 0), (360, 0)]
    found = spark.createDataFrame([("f", 0, 0, "cat", [350.0, 10.0, 450.0, 110.0], 0.9), ("f", 360, 0, "cat", [0.0, 10.0, 90.0, 110.0], 0.8)], "frame_id string, x int, y int, label string, bbox array<double>, conf double")
    assert [(r.bbox, r.conf) for r in boxes.suppress(boxes.placed(found)).collect()] == [([350.0, 10.0, 450.0, 110.0], 0.9)]  # cut by a tile's edge, found twice


def test_index_from_files_is_what_its_parts_say(spark, tmp_path):
    """V0 has official shots, V1 is cut by predictions, V2 isn't among the media."""
    from shotline.operators import compose

    rng = random.Random(16)
    frames = [(f"V{v}", i, i / 25.0, [rng.gauss(0, 1) for _ in range(4)], float(rng.randrange(90)), rng.random(), f"cap {i}", "", ["act"], [("dog",)]) for v in range(3) for i in range(200)]
    kind = "source_file string, frame_idx long, timestamp double, vector array<double>, size double, raw double, caption string, ocr_text string, actions array<string>, dets array<struct<label:string>>"
    f = spark.createDataFrame(frames, kind)
    for name, text in (("raw/V0.mp4", "x"), ("raw/V1.MP4", "x"), ("msb/V0.txt", "# head\n0,3\nb 3.0 8.0\nnonsense\n"), ("asr/V0.csv", "0.5,1.0,hello\nbad\n"), ("metadata/V0.json", '{"title": "T"}'), ("metadata/V1.json", "[")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rises = {60, 61, 120}
    chunks = [(f"V{v}", s, min(50, 200 - s), [0.9 if s + k - 25 in rises else 0.1 for k in range(100)]) for v in (0, 1) for s in range(0, 200, 50)]
    preds = spark.createDataFrame(chunks, "source_file string, chunk_start long, valid int, preds array<double>")
    got = compose.index_files(spark, str(tmp_path), f, preds, 25.0, 5.0)
    scenes = [("V0", 0, 0.0, 3.0, "shot000001"), ("V0", 1, 3.0, 8.0, "b"), ("V1", 0, 0.0, 2.4, None), ("V1", 1, 2.4, 4.8, None), ("V1", 2, 4.8, 8.0, None)]
    picked = [(*r, n) for r in frames for s, n, a, b, _ in scenes if r[0] == s and int(a * 25) <= r[1] < int(b * 25) and (r[1] - int(a * 25)) % 5 == 0]
    c = spark.createDataFrame(picked, kind + ", scene_id long")
    own = spark.createDataFrame([(s, n, o) for s, n, _, _, o in scenes], "source_file string, scene_id long, official_id string")
    asr = spark.createDataFrame([("V0", 0.5, 1.0, "hello")], "source_file string, start double, end double, text string")
    meta = spark.createDataFrame([("V0", {"title": "T"}), ("V1", {})], "source_file string, meta map<string,string>")
    columns = ["point_id", "source_file", "scene_id", "shot_id", "frame_idx", "text_blob"]
    want = sorted(map(str, compose.index(c, own, asr, meta).select(*columns).collect()))
    assert sorted(map(str, got.select(*columns).collect())) == want and len(want) >= 5 and any("hello" in w for w in want)


def test_shot_lines_that_begin_with_any_digit(spark, tmp_path):
    from shotline.sources import files

    (tmp_path / "a.txt").write_text("0.0,0.8\n1 2\nx 0 1\nshot\n3\n2.5,2.0\n")
    got = sorted((r.shot_id, r.start, r.end) for r in files.shot_bounds(spark, str(tmp_path)).collect())
    assert got == [("shot000000", 0.0, 0.8), ("shot000001", 1.0, 2.0), ("x", 0.0, 1.0)]
