"""Streams with state, and tables in versions: against the batch rules, restarts and writers that fail."""

import json

import pytest
from pyspark.sql import functions as F

from shotline.operators import session
from shotline.plans import queries
from shotline.sources import versions
from shotline.streaming import log

SF = "/root/testdata/sf0.001"
BASE = 1_700_000_000_000  # what is older than the first watermark, 1970, counts as late


def test_sessions_equal_batch_over_conversations_and_restart(spark, tmp_path):
    """User turns search, assistant turns ask back (W16, W19); three runs from one checkpoint, each over a part of the turns."""
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    rows = [r for r in rows if r[2] in ("user", "assistant")]
    want, out = {}, {}
    for conv, turn, role, text in rows:
        turns, queries_before, pending, shown = want.setdefault(conv, [0, [], None, []])
        event = ["search" if role == "user" else "clarify", turns + (role == "user"), pending if role == "user" else None, "\n".join(queries_before), list(shown)]
        if role == "user":
            want[conv] = [turns + 1, [*queries_before, text or ""], None, [f"p{turn}", "x"]]
        else:
            want[conv][2] = text
        out[str(conv), BASE + 1000 * turn] = event
    source = tmp_path / "in"
    source.mkdir()
    cuts = [0, 1, 3, 10_000]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own = [r for r in rows if a <= r[1] < b]
        (source / f"{part}.json").write_text("\n".join(json.dumps({"session_id": str(c), "action": "search" if x == "user" else "clarify", "query": t if x == "user" else None, "details": t if x != "user" else None, "timestamp_ms": BASE + 1000 * n, "result_ids": [f"p{n}", "x"] if x == "user" else None}) for c, n, x, t in own))
        q = log.sessions(log.read(spark, str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = {(r.session_id, r.timestamp_ms): [r.action, r.turns, r.answers, r.queries_before, r.candidates] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == out and len(got) == len(rows) > 10
    state = lambda v: spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", v)
    turns = {r.key[0]: r.value[0] for r in state("turns").load().collect()}
    assert turns == {str(c): w[0] for c, w in want.items() if w[0]}
    history = {}
    for r in state("history").option("flattenCollectionTypes", "true").load().collect():
        history.setdefault(r.key[0], []).append(r.list_element[0])
    assert {k: sorted(v) for k, v in history.items()} == {str(c): sorted(w[1]) for c, w in want.items() if w[1]}


def test_idle_sessions_go(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    day = 86_400_000
    for part, (s, t) in enumerate([("a", 0), ("b", 2 * day), ("b", 3 * day), ("a", 4 * day)]):
        (source / f"{part}.json").write_text(json.dumps({"session_id": s, "action": "search", "query": f"q{t}", "timestamp_ms": BASE + t}))
        q = log.sessions(log.read(spark, str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    last = spark.read.parquet(str(tmp_path / "out")).filter(F.col("timestamp_ms") == BASE + 4 * day).collect()
    assert [(r.session_id, r.turns, r.queries_before) for r in last] == [("a", 1, "")]  # its first search is forgotten


def test_flags_equal_batch_over_events_in_batches(spark, tmp_path):
    s = queries._submissions(spark, SF).withColumn("accepted", F.col("correct")).withColumn("forced", F.col("id") % 11 == 0)
    s = s.select(F.col("task").cast("int").alias("task"), "id", F.when(F.col("id") % 13 > 0, F.col("video")).otherwise("").alias("video"), "ts", F.when(F.col("id") % 17 > 0, F.col("accepted")).alias("accepted"), F.when(F.col("id") % 5 > 0, F.col("forced")).alias("forced"))
    rows = sorted(s.collect(), key=lambda r: (r.ts, r.id))
    want = {r.id: r.duplicate for r in session.duplicate_videos(s).collect()}
    schema = s.schema
    source = tmp_path / "in"
    for part in range(4):
        own = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = log.flagged(spark.readStream.schema(schema).parquet(str(source)), "60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {r.id: r.duplicate for r in got} == want and 0 < sum(want.values()) < len(want)


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "point_id int, source_file string, n int")


def table(spark, path, version=None):
    return sorted((r.point_id, r.source_file, r.n) for r in versions.read(spark, path, version).collect())


def test_versions_are_whole(spark, tmp_path):
    p = str(tmp_path / "t")
    assert versions.manifest(spark, p) is None
    assert versions.upsert(points(spark, (1, "a", 1), (2, "a", 1), (3, "b", 1)), p) == 1
    assert versions.upsert(points(spark, (1, "a", 2), (1, "a", 3), (4, "c", 1)), p, version="n") == 2
    now = [(1, "a", 3), (2, "a", 1), (3, "b", 1), (4, "c", 1)]
    assert table(spark, p) == now and table(spark, p, 1) == [(1, "a", 1), (2, "a", 1), (3, "b", 1)]

    @F.udf("int")
    def fails(x):
        if x == 9:
            raise ValueError("the writer dies between files")
        return x

    bad = points(spark, *[(i, f"v{i}", i) for i in range(5, 12)]).repartition(7).withColumn("n", fails("n"))
    with pytest.raises(Exception, match="dies between files"):
        versions.upsert(bad, p)
    assert table(spark, p) == now and versions.versions(spark, p) == [1, 2]
    assert versions.rebuild(points(spark, (9, "a", 9)), p) == 3
    assert table(spark, p) == [(3, "b", 1), (4, "c", 1), (9, "a", 9)] and table(spark, p, 2) == now
    versions.rebuild(points(spark, (3, "b", 2), (4, "c", 2)), p)
    assert versions.vacuum(spark, p, 1) and table(spark, p) == [(3, "b", 2), (4, "c", 2), (9, "a", 9)]
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, p, 2)


def test_a_writer_between_loses_nothing(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "t")
    versions.upsert(points(spark, (1, "a", 1)), p)
    real, met = versions.commit, []

    def slow(s, path, new):
        if not met:
            met.append(new.version)
            monkeypatch.setattr(versions, "commit", real)
            versions.upsert(points(spark, (2, "a", 2)), p)  # another writer takes the number first
        real(s, path, new)

    monkeypatch.setattr(versions, "commit", slow)
    assert versions.upsert(points(spark, (3, "a", 3)), p) == 3 and met == [2]
    assert table(spark, p) == [(1, "a", 1), (2, "a", 2), (3, "a", 3)]


def test_a_batch_that_runs_twice_writes_nothing(spark, tmp_path):
    p = str(tmp_path / "t")
    first = points(spark, (1, "a", 1))
    assert versions.upsert(first, p, batch=("s", 0)) == 1 and versions.upsert(first, p, batch=("s", 0)) is None and versions.upsert(first, p, batch=("other", 0)) == 2
    (tmp_path / "in").mkdir()
    for name, rows in (("a", [(1, "v", "x"), (2, "v", "y")]), ("b", [(2, "v", "z"), (3, "v", "w")])):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("point_id", "source_file", "text"), r))) for r in rows))
        stream = spark.readStream.schema("point_id int, source_file string, text string").json(str(tmp_path / "in"))
        q = log.committing(stream, str(tmp_path / "s"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert sorted((r.point_id, r.text) for r in versions.read(spark, str(tmp_path / "s")).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert versions.manifest(spark, str(tmp_path / "s")).ledger == {"points": 1}
