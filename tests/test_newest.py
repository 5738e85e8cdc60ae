"""The newest bar's features against those of all bars, and rank correlations that are exactly nothing."""

import datetime
import itertools
import math
import re

from pyspark.sql import functions as F

from tapewright.operators import backtest as B
from tapewright.operators import technicals as T
from tapewright.operators.sliding import drawdown


def bars(spark, lengths):
    """Symbols of some bars each; the highest close stands a year and more before the end of the long ones."""
    start, rows = datetime.date(2000, 1, 3), []
    for s, length in lengths.items():
        for i in range(length):
            close = 100 + 30 * math.sin(i * (0.05 + 0.01 * len(s))) + (500.0 if i == length - 253 else 0.0)
            rows.append((s, start + datetime.timedelta(i), close - 1, close + 2, close - 2, close, 1000.0 + 37 * (i % 11)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_newest_features_are_those_of_the_last_bar(spark):
    panel = bars(spark, {"A": 60, "BB": 252, "CCC": 253, "DDDD": 400, "EEEEE": 59})
    asked = ["max_dd_1y", "hi52", "lo52", "ret_12m", "mom_12_1", "vol_60", "ema200_slope", "above_200_days", "structure", "turnover_90", "sma200"]
    close = lambda r: [None if v is None else round(float(v), 9) for v in r]
    got = {r["symbol"]: close(r[1:]) for r in T.newest(panel).select("symbol", *asked).collect()}
    want = {r["symbol"]: close(r[1:]) for r in T.latest(drawdown(T.technicals(panel))).select("symbol", *asked).collect()}
    assert got == want and set(got) == {"A", "BB", "CCC", "DDDD"}


def test_newest_takes_few_window_steps(spark):
    plan = T.newest(bars(spark, {"A": 60}))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) <= 8


def test_no_rank_correlation_is_zero(spark):
    n, found = 7, []
    for p in itertools.permutations(range(n)):
        if 6 * sum((i - v) ** 2 for i, v in enumerate(p)) == n * (n * n - 1):
            found.append(p)
    rows = [(f"c{k:03d}", "x", f"S{i}", float(i), v / 10, n, n - i, i + 1, 1) for k, p in enumerate(found[:40]) for i, v in enumerate(p)]
    ranks = spark.createDataFrame(rows, "cohort string, exit string, symbol string, score double, fwd double, n_elig int, down int, up int, decile int")
    bench = ranks.select("cohort", F.lit(0.0).alias("fwd")).distinct()
    assert {r["ic"] for r in B.portfolios(ranks, bench, 2).select("ic").collect()} == {0.0}


def test_features_on_days_are_those_of_every_bar_then(spark):
    panel = bars(spark, {"A": 60, "BB": 252, "CCC": 253, "DDDD": 400, "EEEEE": 59}).withColumn("bench", F.lit(50.0) + F.dayofyear("date"))
    start = datetime.date(2000, 1, 3)
    days = spark.createDataFrame([(start + datetime.timedelta(k),) for k in (-5, 58, 59, 60, 251, 252, 253, 300, 399, 500)], "cohort date")
    every = drawdown(T.technicals(panel)).withColumns({"bars": F.col("n"), "rs_line_pos_52": T.line_position(), **T.lagged()})
    want = B.as_of(every, days, "cohort").where("n >= 60")
    got = T.on_days(panel, days, "cohort")
    assert set(got.columns) == set(want.columns)
    shown = lambda df: sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select("cohort", "symbol", *sorted(set(want.columns) - {"cohort", "symbol"})).collect())
    key = lambda rows: {r[:2]: r[2:] for r in rows}
    got_, want_ = key(shown(got)), key(shown(want))
    assert set(got_) == set(want_) and len(want_) > 20
    for k, r in want_.items():
        for x, y in zip(got_[k], r, strict=True):
            assert x == y or abs(x - y) <= 1e-8, k
    assert T.on_days(panel, days.where("cohort is null"), "cohort").count() == 0


def sliding_frames(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(a != b for a, b in re.findall(r"specifiedwindowframe\(RowFrame, (-\d+), (-?\w+)", plan))  # a lag's ends are one


def test_features_on_days_slide_no_frames(spark):
    panel = bars(spark, {"A": 60})
    days = spark.createDataFrame([(datetime.date(2000, 2, 1),)], "cohort date")
    assert sliding_frames(T.technicals(panel)) > 0 and sliding_frames(T.on_days(panel, days, "cohort")) == 0


def test_rows_as_of_days_carry_no_calendar(spark):
    panel = bars(spark, {"A": 60})
    days = spark.createDataFrame([(datetime.date(2000, 2, 1),), (datetime.date(2000, 3, 1),)], "cohort date")
    held = B.as_of(panel, days, "cohort")
    assert "subquery" not in held._jdf.queryExecution().optimizedPlan().toString() and held.count() == 2


def test_setups_slide_band_widths_alone(spark):
    assert sliding_frames(T.setups(bars(spark, {"A": 60}))) <= 2
