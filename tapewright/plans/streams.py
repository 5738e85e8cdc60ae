"""Queries that run the feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import stored
from ..streaming import feeds as S
from ..streaming import state
from . import desks


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a glob, as a stream's plain path has to be a folder and the table may be one file
    raw = S.stream(spark, f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's, type's and day's first-seen event."""
    keyed = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return S.drain(S.distinct_events(keyed, ["user_id", "event_type", "day"], "ts", "60 days").select("user_id", "event_type", "day"), S.place(spark))


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event of each type."""
    out = S.merge_newest(events(spark, sf_dir), S.place(spark), ["user_id", "event_type"], "event_id")
    return out.select("user_id", "event_type", "event_id")


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and tumbling week, from closed windows only."""
    out = S.drain(S.tumbling(events(spark, sf_dir), "ts", "7 days", ["event_type"], "0 seconds"), S.place(spark))
    return out.select(F.to_date("start").alias("week"), "event_type", "n", F.round("total", 4).alias("total"))


def deltas_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's score changes, from state that runs are added to: the first seven, and after a restart the others."""
    at = S.place(spark)
    runs = desks.history(spark, sf_dir)
    number = runs.select("asof").distinct().withColumn("run", F.row_number().over(Window.orderBy("asof")) - 1)  # one row a run
    runs = stored(runs.join(F.broadcast(number), "asof").select("run", "asof", "symbol", "score"))
    with state.rocks(spark):
        for part in (runs.where("run < 7"), runs.where("run >= 7")):
            part.write.mode("append").parquet(f"{at}/in")
            out = S.drain(state.score_deltas(S.stream(spark, f"{at}/in", runs.schema)), f"{at}/out")
    return out.select("symbol", "asof", F.round("d1", 1).alias("d1"), F.round("d5", 1).alias("d5"))


QUERIES = {"st1_dedup_stream": first_events, "st2_merge_stream": newest_events, "st4_window_stream": weekly_counts, "st5_delta_stream": deltas_of_runs}
#: Weeks start on Thursdays, as 1970-01-01 was one; the last one stays open.
ORACLES = {
    "st5_delta_stream": f'WITH {desks.COHORTS}, r AS (SELECT *, max(back) OVER () - back AS run FROM h) SELECT a.symbol, a."asof", round(a.score - b.score, 1) + 0.0 AS d1, round(a.score - c.score, 1) + 0.0 AS d5 FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.run = a.run - 1 LEFT JOIN r c ON c.symbol = a.symbol AND a.run > 0 AND c.run = greatest(0, a.run - 5)',
    "st1_dedup_stream": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "st2_merge_stream": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "st4_window_stream": "WITH z AS (SELECT *, CAST(CAST(ts AS DATE) - CAST((CAST(ts AS DATE) - DATE '1970-01-01') % 7 AS INT) AS DATE) AS week FROM events) SELECT week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM z WHERE week + 7 <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
}
