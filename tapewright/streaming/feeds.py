"""Streams over the feeds: dedup on natural keys, upserts of the newest bar, tumbling windows.

All run with an available-now trigger as well as continuously; sinks are tables in a shared folder, with their own
checkpoints, so that a restarted query goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import shared_folder
from ..sources import exchange
from ..sources.remote import DailyFeed
from .tables import VersionedTable, merge_stream


def stream(spark: SparkSession, path: str, schema=None, files: int = 100) -> DataFrame:
    """A folder (or glob) of Parquet files as a stream."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def distinct_events(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """First event of each key; a key's state is dropped once the watermark has passed it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts and sums of value by window; a window is given once it is closed for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(out: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table at ``at`` and reads that."""
    spark = out.sparkSession
    query = out.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/table")


def merge_newest(bars: DataFrame, at: str, keys: list[str], order: str, rows: int = 1_000_000) -> DataFrame:
    """The newest row of each key of what a stream has now, merged into a versioned table at ``at`` (see ``VersionedTable``)."""
    table = VersionedTable(bars.sparkSession, f"{at}/newest", bars.schema, keys, order, rows=rows)
    return merge_stream(bars, table, f"{at}/checkpoint")


def feed_table(responses: DataFrame, name: str, at: str, rows: int = 1_000_000) -> DataFrame:
    """A feed's table at ``at``, with what a stream of responses (day, body; other columns are left out) adds to it.

    Of rows with one key the first stays, or the last where the feed says so, by the day of the response; so a response
    that comes again adds nothing.
    """
    typed = exchange.parse(responses.select(F.col("day").alias("fetched"), "body"), name)
    feed = exchange.FEEDS[name]
    table = VersionedTable(responses.sparkSession, f"{at}/{name}", typed.schema, list(feed.keys), "fetched", first=not feed.last, rows=rows)
    return merge_stream(typed, table, f"{at}/checkpoint-{name}")


def daily(spark: SparkSession, url: str, since: str, until: str) -> DataFrame:
    """Responses of a feed that has an address a day, as a stream."""
    spark.dataSource.register(DailyFeed)
    return spark.readStream.format("daily_feed").option("url", url).option("since", since).option("until", until).load()
