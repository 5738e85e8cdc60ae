"""Keyed state over the runs of a screen: each symbol's score against earlier runs, as runs arrive."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class Deltas(StatefulProcessor):
    """A symbol's scores of the newest runs, by the run's number. A timer forgets a symbol that no run has had for ``keep`` days."""

    def __init__(self, far: int = 5, keep: int = 400):
        self.far, self.keep = far, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "run int", "score double")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a symbol has a row a run
        new = pd.concat(list(rows)).sort_values("run")
        out = []
        for run, asof, score in zip(new["run"].tolist(), new["asof"], new["score"].tolist(), strict=True):
            known = {k[0]: v[0] for k, v in self.scores.iterator()}
            change = lambda back: None if back not in known or pd.isna(score) else score - known[back]  # noqa: B023, E731
            out.append((key[0], asof.date(), change(run - 1), change(max(0, run - self.far)) if run else None))
            if not pd.isna(score):
                self.scores.updateValue((run,), (float(score),))
            for old in known:
                if old <= run - self.far:
                    self.scores.removeKey((old,))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = int(new["asof"].max().timestamp() * 1000) + self.keep * DAY_MS
        self.timer.update((at,))
        self.handle.registerTimer(at)
        yield pd.DataFrame({"symbol": [o[0] for o in out], "asof": [o[1] for o in out], "d1": pd.array([o[2] for o in out], "Float64"), "d5": pd.array([o[3] for o in out], "Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scores.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State with timers needs this store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def score_deltas(runs: DataFrame, far: int = 5, keep: int = 400) -> DataFrame:
    """symbol, asof, d1, d5 of every run as it arrives: the change since the run before, and since ``far`` runs before (the first, while there are fewer).

    ``runs`` is a stream of run (numbered from 0 without gaps), asof (its day), symbol and score, a row a symbol and run;
    runs come in order, several at a time or not. A change is null where the symbol has no score in either run.
    """
    timed = runs.select("symbol", F.col("run").cast("int").alias("run"), F.col("asof").cast("timestamp").alias("asof"), F.col("score").cast("double").alias("score")).where("symbol is not null")
    keyed = timed.withWatermark("asof", "0 seconds").groupBy("symbol")
    return keyed.transformWithStateInPandas(statefulProcessor=Deltas(far, keep), outputStructType="symbol string, asof date, d1 double, d5 double", outputMode="Append", timeMode="EventTime")
