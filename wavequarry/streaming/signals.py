"""Streams of events: windows, sessions, and ordered state (R10, R12, 2.14)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """Events as they arrive in ``folder``, with a timestamp that a watermark takes."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, late: str) -> DataFrame:
    """Energy per type and window; events later than ``late`` are left out."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
            .agg(F.count("*").alias("c"), F.sum(F.col("value") * F.col("value")).alias("energy")))


def sliding(events: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    """The peak of overlapping windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, hop), "event_type").agg(F.max("value").alias("peak"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's events with no gap of ``gap`` or more: active spans over time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("c"))


def running_mean(samples: DataFrame, alpha: float, most_waiting: int = 65_536) -> DataFrame:
    """The running mean of ``samples(channel, n, x)``: n numbers a channel's samples without gaps.

    Samples that come before their predecessors wait in the state; repeats are dropped.
    The output is the batch fold's, however the stream is cut. Where more than
    ``most_waiting`` of a channel's samples wait, the ones that are missing are given up.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, y, seen, ns, xs = state.get if state.exists else (0, 0.0, False, [], [])
        waiting = dict(zip(ns, xs, strict=True))
        for pdf in batches:
            waiting.update((int(n), float(x)) for n, x in zip(pdf["n"], pdf["x"], strict=True) if n >= nxt)
        out = []
        if nxt not in waiting and len(waiting) > most_waiting:
            nxt = min(waiting)
        while nxt in waiting:
            x = waiting.pop(nxt)
            y, seen = (alpha * y + (1 - alpha) * x if seen else x), True
            out.append((key[0], nxt, y))
            nxt += 1
            if nxt not in waiting and len(waiting) > most_waiting:
                nxt = min(waiting)
        state.update((nxt, y, seen, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["channel", "n", "y"])

    return samples.groupBy("channel").applyInPandasWithState(
        step, "channel string, n bigint, y double", "nxt bigint, y double, seen boolean, ns array<bigint>, xs array<double>", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns the table it made."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
