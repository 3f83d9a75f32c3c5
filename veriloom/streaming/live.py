"""The same operators over streams: requests one row each, and session risk (an extension)."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators import cascade, enforce, segments

RISK_WINDOW = 5


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines as they come; lines that are none have a null request_id."""
    return spark.readStream.schema(segments.REQUEST).json(path)


def stage1_in_row(requests: DataFrame, config: cascade.Config = cascade.Config()) -> DataFrame:
    """request_id, session_id, outcome, blocked by Stage I, over the same normalised texts as in batches."""
    df = cascade.judged(cascade.inspected(requests, dataclasses.replace(config, stage2=False)))
    return df.select("request_id", "session_id", F.col("stage_1_syntactic").alias("outcome"), F.col("stage1_blocked").alias("blocked"))


def enforced_in_row(requests: DataFrame, config: cascade.Config = cascade.Config(stage2=True), **policy) -> DataFrame:
    """The whole cascade and its enforcement over a stream: the batch plan, stateless, a request stays one row."""
    return enforce.run(requests, config, **policy)


def risk_of(scores: list[float]) -> float:
    return sum(scores[-RISK_WINDOW:]) / len(scores[-RISK_WINDOW:])


def session_risk(turns: DataFrame) -> DataFrame:
    """Batch twin: (session_id, turn, score) with the mean of the last RISK_WINDOW scores of the session."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(1 - RISK_WINDOW, 0)
    return turns.withColumn("risk", F.avg("score").over(w))


def session_risk_stream(turns: DataFrame) -> DataFrame:
    """session_risk over a stream: the last scores of each session are its state; batches are taken in order of turn."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, score in zip(rows["turn"], rows["score"]):
            past = [*past, float(score)][-RISK_WINDOW:]
            out.append((key[0], int(turn), float(score), risk_of(past)))
        state.update((past,))
        yield pd.DataFrame(out, columns=["session_id", "turn", "score", "risk"])

    return turns.groupBy("session_id").applyInPandasWithState(update, "session_id string, turn long, score double, risk double", "scores array<double>", "append", "NoTimeout")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling or sliding windows, closing when the watermark passes."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    by = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of a user's events with no longer gap between."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sink(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """A telemetry stream to JSON lines, exactly once by the checkpoint."""
    w = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", False)
    return (w.trigger(availableNow=True) if once else w).start()


