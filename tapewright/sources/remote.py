"""Python data sources for HTTP feeds: one partition a request, with retries; as a stream, one a day."""

from __future__ import annotations

import datetime
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def retry(fetch: Callable[[], bytes], tries: int = 4, base: float = 1.5, wait: Callable[[float], None] = time.sleep) -> bytes:
    """Calls until it works, waiting longer each time; the last failure is raised."""
    for i in range(tries):
        try:
            return fetch()
        except OSError:
            if i == tries - 1:
                raise
            wait(base**i)
    raise AssertionError("unreachable")


class HttpFeed(DataSource):
    """spark.read.format("http_feed").option("urls", "a\\nb").load(): url, status, body."""

    @classmethod
    def name(cls) -> str:
        return "http_feed"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.tries = int(options.get("tries", "4"))
        self.agent = options.get("agent", "Mozilla/5.0")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body = fetched(partition.value, self.tries, self.agent)
        if body is not None:
            yield partition.value, body


def fetched(url: str, tries: int, agent: str) -> str | None:
    """A response's text; nothing where there is none at that address, as on a holiday."""
    request = urllib.request.Request(url, headers={"User-Agent": agent}) if url.startswith("http") else url

    def fetch() -> bytes | None:
        try:
            with urllib.request.urlopen(request, timeout=30) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            raise

    body = retry(fetch, tries)
    return None if body is None else body.decode("utf-8", "replace")


class Day(InputPartition):
    def __init__(self, day: str, url: str):
        self.day, self.url = day, url


class DailyFeed(DataSource):
    """spark.readStream.format("daily_feed").option("url", "https://.../x_{day:%d%m%Y}.json").option("since", "2024-01-01").load(): day, url, body.

    A day is asked for once: offsets are days, and a restarted query goes on with the day after the last one it committed.
    ``until`` ends the stream at a day (today, if it is not given). Saturdays and Sundays are left out, and days without a response have no row.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_feed"

    def schema(self) -> str:
        return "day date, url string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DailyReader(self.options)


class DailyReader(DataSourceStreamReader):
    def __init__(self, options):
        self.url, self.since = options["url"], options["since"]
        self.until = options.get("until")
        self.tries, self.agent = int(options.get("tries", "4")), options.get("agent", "Mozilla/5.0")

    def initialOffset(self) -> dict:
        return {"through": (datetime.date.fromisoformat(self.since) - datetime.timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"through": self.until or datetime.date.today().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (datetime.date.fromisoformat(x["through"]) for x in (start, end))
        days = [first + datetime.timedelta(k) for k in range(1, (last - first).days + 1)]
        return [Day(d.isoformat(), self.url.format(day=d)) for d in days if d.weekday() < 5]

    def read(self, partition: Day) -> Iterator[tuple]:
        body = fetched(partition.url, self.tries, self.agent)
        if body is not None:
            yield datetime.date.fromisoformat(partition.day), partition.url, body

    def commit(self, end: dict) -> None:
        """What was asked for stands in the query's own log."""
