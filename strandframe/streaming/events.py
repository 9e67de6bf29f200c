"""Event-time queries that run on a stream as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The event files under ``path`` as a stream, a few at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Watermarks need instants; times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per window; on a stream, with a watermark of ``late``."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``user_id, start, end, n``: events of a user no further apart than ``gap``; the end lies a gap after the last."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rolling_rate(events: DataFrame, alpha: float = 0.2, user: str = "user_id") -> DataFrame:
    """``user, n, rate``: an exponentially weighted rate of values per user in time order, kept as keyed state.

    On a stream the state lives between batches; late rows are folded in as they come.
    """
    import pandas as pd

    def update(key, batches, state):
        n, rate = state.get if state.exists else (0, 0.0)
        for batch in batches:
            for value in batch.sort_values("ts")["value"]:
                rate = value if n == 0 else (1 - alpha) * rate + alpha * value
                n += 1
        state.update((n, rate))
        yield pd.DataFrame({user: [key[0]], "n": [n], "rate": [rate]})

    return events.select(user, "ts", "value").groupBy(user).applyInPandasWithState(update, f"{user} long, n long, rate double", "n long, rate double", "update", "NoTimeout")
