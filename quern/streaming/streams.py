"""Structured Streaming forms of the lifecycle operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.model import Unit
from quern.operators.aggregate import micros
from quern.sources.store import Session


def append_stream(session: Session, stream: DataFrame, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch once: its number is the operation id, so a batch that is retried replays."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            session.append(f"{name}:{number}", df)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def bucket_counts(stream: DataFrame, ts: str, width: dt.timedelta, late: dt.timedelta, by: tuple[str, ...] = (), origin: dt.datetime | None = None) -> DataFrame:
    """Counts of fixed UTC buckets over a stream, closed once the watermark has passed them."""
    us = lambda t: f"{t // dt.timedelta(microseconds=1)} microseconds"
    start = micros(origin) % (width // dt.timedelta(microseconds=1)) if origin else 0
    window = F.window(F.col(ts), us(width), us(width), f"{start} microseconds")
    return stream.withWatermark(ts, us(late)).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("bucket"), *by, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: dt.timedelta, late: dt.timedelta) -> DataFrame:
    """Session windows: runs of events of a key without a longer gap."""
    us = lambda t: f"{t // dt.timedelta(microseconds=1)} microseconds"
    return stream.withWatermark(ts, us(late)).groupBy(F.session_window(ts, us(gap)), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_per_key(stream: DataFrame, unit: Unit, key: str, ts: str) -> DataFrame:
    """The newest row of each key, as update rows; equal times go to the smaller unit key. State is one row a key."""
    ties = [(-F.col(k)) for k in unit.key]  # integer keys
    rest = [c for c in stream.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(ts), *ties)).alias("row")
    return stream.groupBy(key).agg(newest).select(key, "row.*")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: dt.timedelta) -> DataFrame:
    """Rows whose keys have not come within the watermark."""
    return stream.withWatermark(ts, f"{late // dt.timedelta(microseconds=1)} microseconds").dropDuplicatesWithinWatermark(keys)
