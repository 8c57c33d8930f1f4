"""Journals as streams: validation with typed state per stream, mirrors without state, sessions, a running reference."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tessera.session import new_folder
from tessera.sources import sinks

FAULTS = "stream_id string, sequence long, event_id string, fault string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def faults(rows: pd.DataFrame, upcoming: int, closed: bool) -> tuple[pd.DataFrame, int, bool]:
    """``(sequence, event_id, fault)`` of a stream's new events, which may come in any order, and what to expect after
    them: numbers are contiguous, so one below the next expected is a repeat, and the first event starts the journal."""
    rows = rows.sort_values(["sequence", "event_id"])
    s, event = rows["sequence"].to_numpy(np.int64), rows["event"].to_numpy()
    expected = np.maximum(np.concatenate(([upcoming], s[:-1] + 1)), upcoming)
    again = s < expected
    ends = ~again & (event == "history_closed")
    shut = closed | np.concatenate(([False], np.logical_or.accumulate(ends)[:-1]))
    kinds = {"repeat": again, "after close": ~again & shut, "gap": s > expected, "no start": ~again & (s == 1) & (event != "history_started")}
    found = [pd.DataFrame({"sequence": s[at], "event_id": rows["event_id"].to_numpy()[at], "fault": name}) for name, at in kinds.items()]
    return pd.concat(found), max(upcoming, int(s[-1]) + 1), closed or bool(ends.any())


class Validated(StatefulProcessor):
    """Two values of state a stream, whatever its length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", StructType().add("upcoming", "long").add("closed", "boolean"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upcoming, closed = self.at.get() if self.at.exists() else (1, False)
        new = pd.concat([r[["sequence", "event_id", "event"]] for r in rows])
        out, upcoming, closed = faults(new, int(upcoming), bool(closed))
        self.at.update((upcoming, closed))
        out.insert(0, "stream_id", key[0])
        yield out

    def close(self) -> None:
        pass


def validate_stream(events: DataFrame) -> DataFrame:
    """Faults of journals ``(stream_id, sequence, event_id, event)`` as they come: each micro-batch goes on where the one
    before ended, also after a restart. A task holds a stream's events of one micro-batch, which the source bounds."""
    keyed = events.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.col("sequence").cast("long").alias("sequence"),
        F.col("event_id").cast("string").alias("event_id"), "event"
    )
    return keyed.groupBy("stream_id").transformWithStateInPandas(Validated(), StructType.fromDDL(FAULTS), "Append", "None")


def mirror(spark: SparkSession, events: DataFrame, target: str, state: str, key: str = "event_id") -> DataFrame:
    """Each event once, by its id, however late it comes again: a micro-batch is held against the ids that are published,
    and only what is new is appended. No state is kept but the table itself; a batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        sinks.append_new(batch, target, key)

    query = events.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(target)


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by event time, an addition to what journals ordered by number have: events without a longer gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    out = timed.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


JUDGED = "stream_id string, sequence long, reference double, accepted boolean"


def judge(rows: Iterable[tuple[int, float | None]], recent: list[float]) -> tuple[list[tuple[int, float | None, bool]], list[float]]:
    """A stream's new frames ``(sequence, score)`` in order against the median of the last fifteen accepted scores; and
    these after them. The scores are kept in order of size too, so a frame costs no sorting."""
    out, recent, ranked = [], deque(recent), sorted(recent)
    for seq, score in sorted(rows, key=lambda r: r[0]):
        n = len(ranked)
        reference = (ranked[n // 2] + ranked[(n - 1) // 2]) / 2 if n >= 3 else None
        ok = score is not None and isfinite(score) and (reference is None or score >= 0.6 * reference)
        out.append((seq, reference, ok))
        if ok:
            recent.append(score)
            insort(ranked, score)
            if n == 15:
                ranked.pop(bisect_left(ranked, recent.popleft()))
    return out, list(recent)


class Judged(StatefulProcessor):
    """A stream's last accepted scores, fifteen at most, as one value. A stream's frames come as rows: most streams have a
    few dozen in a micro-batch, for which a table a stream would cost far more than judging them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", StructType().add("scores", ArrayType(DoubleType())))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.recent.get()
        out, recent = judge(((r.sequence, r.score) for r in rows), known[0] if known else [])
        if recent:
            self.recent.update((recent,))
        for sequence, reference, accepted in out:
            yield Row(stream_id=key[0], sequence=sequence, reference=reference, accepted=accepted)

    def close(self) -> None:
        pass


def _frames(frames: DataFrame) -> DataFrame:
    return frames.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.col("sequence").cast("long").alias("sequence"),
        F.col("score").cast("double").alias("score")
    )


def running_focus(frames: DataFrame) -> DataFrame:
    """Frames ``(stream_id, sequence, score)`` against the median of the last fifteen accepted scores of their stream;
    until three are accepted every finite score is. Whether one is accepted changes what later ones meet. State has no
    time to live: with one, a run over what is there would wait for it and never end."""
    return _frames(frames).groupBy("stream_id").transformWithState(Judged(), StructType.fromDDL(JUDGED), "Append", "None")


def running_focus_batch(frames: DataFrame) -> DataFrame:
    """The same over a finished journal, a stream per group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = judge(zip(pdf["sequence"].tolist(), pdf["score"].tolist(), strict=True), [])
        found = pd.DataFrame(out, columns=["sequence", "reference", "accepted"])
        found.insert(0, "stream_id", key[0])
        return found

    return _frames(frames).groupBy("stream_id").applyInPandas(run, JUDGED)


def run_available(spark: SparkSession, stream: DataFrame, name: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over what is there, write its result to the shared folder with its own checkpoint, and read it. With
    the folders of an earlier run it goes on from there. Typed state needs RocksDB as its store."""
    out, state = out or new_folder(spark, name), state or new_folder(spark, f"{name}-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
