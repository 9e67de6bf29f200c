"""Event-time queries, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import events as E
from .registry import query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM g GROUP BY user_id, s"""
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"))


@query(
    """WITH m AS (SELECT *, max(ts) OVER (ORDER BY event_id % 100, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT event_id, user_id FROM m WHERE ts < seen - INTERVAL '1 hour'"""
)
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a one-hour watermark would drop if they came in a hundred runs. The running maximum is carried over the runs, so no task sees all rows."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("part", F.col("event_id") % 100)
    tops = rows.groupBy("part").agg(F.max("ts").alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("part", F.max("top").over(before).alias("carried"))
    within = Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("ts").over(within), F.col("carried"))
    return rows.join(carried, "part").withColumn("seen", seen).where("ts < seen - interval 1 hour").select("event_id", "user_id")
