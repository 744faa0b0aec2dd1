"""The interaction log as a stream, session state, and streamed index maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from shotline.sources import sinks, versions
from shotline.sources.files import LOG


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are appended."""
    return spark.readStream.schema(LOG).json(path).withColumn("ts", F.timestamp_millis("timestamp_ms"))


def action_counts(log: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """X1, an extension: tumbling counts of actions under a watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every), "action").agg(F.count("*").alias("n"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state below is of several variables a key, which only this store can hold; holds for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Expiring(StatefulProcessor):
    """A processor whose keys go once the watermark has passed their last event by wait_ms."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def touch(self, newest: int) -> None:
        """Move the key's only timer to wait_ms behind its newest event."""
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.wait_ms)
            self.handle.registerTimer(newest + self.wait_ms)
            self.last.update((newest,))

    def forget(self) -> None:
        self.last.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class Sessions(_Expiring):
    """State of a session: number of turns, a list of its queries, ids of the last search's results, and the pending clarification.

    Each is a variable of its own: a search appends one query, and what an event doesn't change isn't written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.turns = handle.getValueState("turns", "n int")
        self.pending = handle.getValueState("pending", "details string")
        self.history = handle.getListState("history", "query string")
        self.shown = handle.getListState("shown", "id string")

    def forget(self) -> None:
        super().forget()
        for state in (self.turns, self.pending, self.history, self.shown):
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted(rows, key=lambda r: (r.timestamp_ms, r.action or ""))
        turns = self.turns.get()[0] if self.turns.exists() else 0
        queries = [r[0] for r in self.history.get()] if self.history.exists() else []
        shown = [r[0] for r in self.shown.get()] if self.shown.exists() else []
        for r in events:
            answers, before, candidates = None, "\n".join(queries), list(shown)
            if r.action == "search":
                turns += 1
                if self.pending.exists():
                    answers = self.pending.get()[0]
                    self.pending.clear()
                queries.append(r.query or "")
                self.turns.update((turns,))
                self.history.appendValue((r.query or "",))
                shown = list(r.result_ids or [])
                self.shown.put([(x,) for x in shown]) if shown else self.shown.clear()
            elif r.action == "clarify" and r.details is not None:
                self.pending.update((r.details,))
            yield Row(session_id=key[0], timestamp_ms=r.timestamp_ms, action=r.action, turns=turns, answers=answers, queries_before=before, candidates=candidates)
        self.touch(events[-1].timestamp_ms)


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def sessions(log: DataFrame, idle: str = "1 hour") -> DataFrame:
    """For each event the turns of its session so far, the clarification that it answers, earlier queries and last candidates.

    log has ts.  State lives in RocksDB, variable by variable, and can be read back with the statestore source (path: the checkpoint; stateVarName:
    turns, pending, history or shown).  A session goes when the watermark, idle behind the newest event, has passed its last
    event by idle.  Events of one batch are taken in order of time; events older than the watermark are dropped.  A clarification without
    details doesn't count.
    """
    keep_state_in_rocksdb(log.sparkSession)
    schema = "session_id string, timestamp_ms long, action string, turns int, answers string, queries_before string, candidates array<string>"
    rows = log.withWatermark("ts", idle).select("session_id", "timestamp_ms", "action", "query", "details", "result_ids", "ts")
    return rows.groupBy("session_id").transformWithState(Sessions(_ms(idle)), schema, "Append", "EventTime")


class Flags(_Expiring):
    """State of a task: a map of the videos that were accepted for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.videos = handle.getMapState("videos", "video string", "id long")

    def forget(self) -> None:
        super().forget()
        self.videos.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted(rows, key=lambda r: (r.ts, r.id))
        for r in events:
            named = bool(r.video)
            seen = named and self.videos.containsKey((r.video,))
            if named and r.accepted and not seen:
                self.videos.updateValue((r.video,), (r.id,))
            yield Row(id=r.id, task=key[0], video=r.video, accepted=r.accepted, forced=r.forced, duplicate=bool(seen and not r.forced))
        self.touch(max(r.ms for r in events))


def flagged(submissions: DataFrame, keep: str = "1 day") -> DataFrame:
    """Every submission (id, task, video, ts, accepted, forced) with duplicate: its video was accepted for the task before it.

    Forced ones and those without a video are never duplicates; ones that weren't accepted are flagged, but don't make others
    duplicates.  Equals session.duplicate_videos as far as events come in order of time: one that is late by a batch is judged by what
    came before it.  A task's map goes once the watermark, keep behind the newest event, has passed its last event by keep.
    """
    keep_state_in_rocksdb(submissions.sparkSession)
    kinds = dict(submissions.dtypes)
    rows = submissions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", keep).select("task", F.col("id").cast("long").alias("id"), "video", "accepted", "forced", "ts", F.unix_millis("ts").alias("ms"))
    schema = f"id long, task {kinds['task']}, video string, accepted boolean, forced boolean, duplicate boolean"
    return rows.groupBy("task").transformWithState(Flags(_ms(keep)), schema, "Append", "EventTime")


def submitted_videos(log: DataFrame, keep: str = "1 day") -> DataFrame:
    """The first submission of each (task, video) that was sent; log has task, video, ts and sent.

    Failed ones and those without a video don't count.  The keyed state of a pair goes once the watermark, keep behind
    the newest event, has passed it, so a task may last up to keep.
    """
    good = log.filter("coalesce(video, '') <> '' and coalesce(sent, false)")
    return good.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["task", "video"])


def upserting(points: DataFrame, path: str, checkpoint: str, by: str = "source_file") -> DataStreamWriter:
    """T4: each batch is upserted by point id into plain Parquet; a batch that runs twice changes nothing.  Readers may see a batch half replaced."""
    return points.writeStream.foreachBatch(lambda df, _: sinks.upsert(df, path, by=by)).option("checkpointLocation", checkpoint)


def committing(points: DataFrame, path: str, checkpoint: str, by: str = "source_file", stream: str = "points") -> DataStreamWriter:
    """T4 into a table in versions: each batch is one commit, which readers see whole or not at all.

    The table's ledger knows the last batch of each stream: one that runs again writes nothing.
    """

    def run(df: DataFrame, batch: int) -> None:
        versions.upsert(df, path, by=by, batch=(stream, batch))

    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
