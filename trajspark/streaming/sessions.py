"""Gap splitting over timestamped events, for batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.operators.scan import by_key, lag, running_sum


def sessions(df: DataFrame, key: str, ts: str, hours: float,
             tiebreak: str = "event_id", value: str = "value") -> DataFrame:
    """Sessions of a key, cut where more than `hours` pass without an event;
    numbered from 0."""
    def split(scan, d):
        d = scan.add(d, [key], [ts, tiebreak], __p=lag(ts))
        gap = (F.unix_micros(ts) - F.unix_micros("__p")) \
            > F.lit(int(hours * 3600 * 1_000_000))
        d = d.withColumn("__cut", F.coalesce(gap, F.lit(False)).cast("long"))
        d = scan.add(d, [key], [ts, tiebreak], session=running_sum("__cut"))
        return d.drop("__p", "__cut")

    rows = df.select(key, F.col(ts).cast("timestamp").alias(ts), tiebreak,
                     value)
    rows = by_key(split, [rows], [key])
    return rows.groupBy(key, "session").agg(
        F.count(F.lit(1)).alias("events"), F.min(ts).alias("start"),
        F.max(ts).alias("end"), F.sum(value).alias("total"))


def stream_sessions(stream: DataFrame, key: str, ts: str, hours: int,
                    watermark: str = "1 hour",
                    value: str = "value") -> DataFrame:
    """The same sessions over a stream. The session window keeps one open
    session per key in the state store and emits it once the watermark has
    passed its end. A session window closes at the gap itself, so two events
    exactly `hours` apart fall into two sessions here."""
    w = F.session_window(F.col(ts), f"{hours} hours")
    return (stream.withColumn(ts, F.col(ts).cast("timestamp"))
            .withWatermark(ts, watermark).groupBy(key, w)
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(value).alias("total"))
            .select(key, F.col("session_window.start").alias("start"),
                    "events", "total"))
