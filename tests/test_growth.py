"""What a query costs beside its result: calls of the driver, memory of a task, rows that travel."""

import gc
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shotline.functions import hooks
from shotline.functions import vectors as V
from shotline.operators import cells, postings, search, shots
from shotline.plans import assets, queries
from shotline.sources import files, sinks


def calls(spark, monkeypatch, act):
    """How many commands the driver sends to the JVM while act runs."""
    client, n = spark.sparkContext._gateway._gateway_client, itertools.count()
    send = type(client).send_command
    with monkeypatch.context() as m:
        m.setattr(type(client), "send_command", lambda self, *a, **kw: (next(n), send(self, *a, **kw))[1])
        act()
    return next(n)


def test_the_driver_does_not_handle_each_named_file(spark, monkeypatch, tmp_path):
    texts = lambda n: spark.range(n).select(F.concat(F.lit("sub/d"), F.col("id") % 3, F.lit("/é"), F.col("id")).alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("text "), F.col("id"))).alias("value"))
    few = calls(spark, monkeypatch, lambda: sinks.write_named(texts(3), f"file://{tmp_path}/few", ".txt"))
    many = calls(spark, monkeypatch, lambda: sinks.write_named(texts(60), f"{tmp_path}/many", ".txt"))
    assert many < few + 30
    got = {str(p.relative_to(tmp_path / "many")): p.read_text() for p in (tmp_path / "many").rglob("*") if p.is_file() and p.suffix == ".txt"}
    assert got == {f"sub/d{i % 3}/é{i}.txt": f"text {i}\n" if i else "\n" for i in range(60)}
    assert files.manifest(spark, str(tmp_path / "many")).count() == 0 and len(list((tmp_path / "few").rglob("*.txt"))) == 3


def test_a_worker_keeps_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(hooks, "WORDS", 100, raising=False)
    model = hooks.word_digits()
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(50)]
    model(np.array(texts[:1], dtype=object))
    gc.collect()
    tracemalloc.start()
    out = model(np.array(texts, dtype=object))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000  # 50,000 words take five times as much
    assert out.shape == (50, 16) and np.allclose(np.linalg.norm(out, axis=1), 1)


def test_videos_and_cells_are_searched_without_moving_frames(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.normal(size=4)]
    rows = [(i, "hot" if i % 3 else f"v{i % 5}", vector()) for i in range(200)] + [(900, None, vector()), (901, "hot", None)]
    f = spark.createDataFrame(rows, "point_id long, source_file string, vector array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", "hot" if i % 4 else "v0", vector()) for i in range(20)], "query_id string, source_file string, vector array<double>")
    hits = search.knn(q, f, 6)
    taken = lambda df: {(r.query_id, r.point_id, r.rank) for r in df.collect()}
    act = lambda: (taken(search.in_video(q, f, 5)), taken(search.refine_in_videos(q, hits, f, 2, 3)), taken(cells.search(cells.build(f, cells=5), q, 6)[0]))
    monkeypatch.setattr(search, "_blocks", None)  # lists of vectors that would travel
    once = act()
    assert once[2] == taken(hits) and len(once[0]) == 100
    for name, n in (("BLOCK_QUERIES", 7), ("SLOTS", 5), ("ROWS", 16), ("QUERIES", 2)):
        monkeypatch.setattr(search, name, n)
    assert act() == once


def peak(act):
    gc.collect()
    tracemalloc.start()
    out = act()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, out


def test_an_index_is_built_in_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(postings, "WORK", 100_000, raising=False)
    every = np.arange(0, 65_536, 2, dtype=np.uint16)
    n = 100
    parts = pa.record_batch({
        "token": pa.array([f"t{i}" for i in range(n)]), "range": pa.array([1] * n, pa.int64()), "size": pa.array([2 * len(every)] * n, pa.int64()), "parts": pa.array([[every[:9].tobytes(), every[5:].tobytes()]] * n, pa.list_(pa.binary())),
    })
    most, rows = peak(lambda: [r for b in postings._merged(iter([parts, parts.slice(0, 0)])) for r in b.to_pylist()])
    assert most < 40_000_000 and [r["token"] for r in rows] == [f"t{i}" for i in range(n)]
    assert all((r["least"], r["greatest"], r["n"]) == (65_536, 131_070, 32_768) and (postings.decode(r["ids"]) == every).all() for r in rows[::30])
    docs = pa.record_batch({"doc": pa.array(range(3000), pa.int64()), "words": pa.array([["red", f"w{i}", "red"] * 100 for i in range(3000)] + [])})
    most, found = peak(lambda: [r for b in postings._lists(iter([docs])) for r in b.to_pylist()])
    assert most < 20_000_000
    red = np.concatenate([np.frombuffer(r["ids"], np.uint16) for r in found if r["token"] == "red"])
    assert (np.sort(red) == np.arange(3000)).all() and sum(r["token"] != "red" for r in found) == 3000


def test_speech_of_many_users_costs_the_driver_no_more(spark, monkeypatch, tmp_path):
    for n in (3, 60):
        spark.range(2 * n).select(F.col("id").alias("event_id"), (F.col("id") % n).alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/{n}/events.parquet")
    write = lambda n: assets._write_asr(spark, f"{tmp_path}/{n}", f"{tmp_path}/{n}/asr", F.concat(F.lit("u"), F.col("user_id")))
    assert calls(spark, monkeypatch, lambda: write(60)) < calls(spark, monkeypatch, lambda: write(3)) + 30
    assert sorted(r.source_file for r in files.asr(spark, f"{tmp_path}/60/asr").collect()) == sorted(f"u{i % 60}" for i in range(120))


def test_small_speech_files_are_read_at_once_and_large_ones_by_lines(spark, monkeypatch, tmp_path):
    (tmp_path / "a b+c%20é.csv").write_bytes('\ufeff0,1,"x, y"\r\n\n1,2,z\r2,3,w'.encode())
    (tmp_path / "long d+%.txt").write_text("".join(f"{i}\t{i + 1}\tt{i}\n" for i in range(3000)))
    (tmp_path / "none.tsv").write_text("")
    want = sorted([("a b+c%20é", 0.0, "x, y"), ("a b+c%20é", 1.0, "z"), ("a b+c%20é", 2.0, "w"), *(("long d+%", float(i), f"t{i}") for i in range(3000))])
    for most in (10, 1000, 1 << 24):
        monkeypatch.setattr(files, "AT_ONCE", most, raising=False)
        got = files.asr(spark, str(tmp_path))
        assert sorted((r.source_file, r.start, r.text) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and plan.count("FileScan text") == 1


def test_an_index_picks_its_keyframes_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    for name, rows in (("embeddings", [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(120)]),):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(120).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("user_id"), F.lit("view").alias("event_type"), F.lit("said").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    made = queries.index_shots(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Generate" in plan  # what is picked is a table; the speech is joined once
    assert plan.count("Generate") == 2 and made.count() == 12


def test_keyframes_of_scenes_across_batches(spark):
    rng = np.random.default_rng(7)
    rows = [(None if s == 2 else f"v{s % 3}", s // 2, 100 * s + i, i // 2, [float(x) for x in np.round(rng.normal(size=3))], None if i % 4 == 0 else float(i % 3) / 2, s % 6 + 1) for s in range(12) for i in range(1 + 3 * s)]
    f = spark.createDataFrame(rows, "source_file string, scene_id long, point_id long, frame_idx long, vector array<double>, sharpness double, budget int").repartition(5)
    want = set()
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        v = np.array([r[4] for r in own])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        chosen = [0]
        while len(chosen) < min(own[0][6], len(own)):
            gain = np.round(1 - (v @ v[chosen].T).max(axis=1) + 0.15 * np.array([r[5] or 0.0 for r in own]), 9)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        want |= {(*key, own[c][2], n) for n, c in enumerate(chosen)}
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = shots.diverse_keyframes(f).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_norm_is_computed_once_a_vector(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [2.0])]
    unit = spark.createDataFrame(rows, "i int, v array<float>").select("i", V.normalise(F.col("v")).alias("u"))
    assert unit._jdf.queryExecution().analyzed().toString().count("zip_with(") == 1
    assert {r.i: r.u for r in unit.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None, 3: [], 4: [1.0, None], 5: [1.0]}
