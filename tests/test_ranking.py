"""Ranks by ranges, sliding structures and as-of spans against plain versions."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tapewright.operators import backtest, desk, ranking, scoring, sliding, technicals

DAY0 = datetime.date(2000, 1, 3)


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [2, 4, 64])
def test_ranks_by_ranges(spark, ranges):
    rng = random.Random(1)
    rows = [(g, round(rng.gauss(0, 1), 2) if rng.random() < 0.6 else 0.0) for g in "ab" for _ in range(900)] + [("c", 1.5)]
    got = ranking.tie_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], ranges).collect()
    for r in got:
        own = [v for g, v in rows if g == r["g"]]
        assert (r["n"], r["rank"], r["total"]) == (own.count(r["v"]), 1 + sum(v < r["v"] for v in own), len(own))
    assert len(got) == len(set(rows))


def test_ranks_of_all_rows_and_of_none(spark):
    d = spark.range(1000).selectExpr("cast(id % 250 as double) as v")
    got = {r["v"]: (r["n"], r["rank"], r["total"]) for r in ranking.tie_ranks(d, "v", []).collect()}
    assert got == {float(i): (4, 4 * i + 1, 1000) for i in range(250)}
    assert ranking.tie_ranks(d.where("v < 0"), "v", []).count() == 0


def test_factors_are_not_ranked_in_one_task(spark):
    n = 3000
    d = spark.range(n).selectExpr("concat('S', id) as symbol", "'x' as sector", "false as lender", "if(id % 2 = 0, 'pe', 'pb') as factor", "cast(hash(id) % 977 as double) as value")
    shown = plan_of(scoring.percentiles(d))
    assert "SinglePartition" not in shown
    flat = d.withColumns({"ret_6m": F.col("value"), "above_sma200": F.lit(True), "turnover_20": F.lit(9.0), "atr_pct": F.lit(0.01), "price": F.lit(1.0), "prev_high": F.lit(2.0), "atr": F.lit(1.0), "vol_x50": F.lit(1.0)})
    assert desk.swing(flat, -1e9).count() >= n // 4


@pytest.mark.parametrize("n", [0, 3, 4, 9, 40])
def test_swing_cuts_are_those_of_a_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(f"S{i:02d}", round(rng.uniform(0.3, 0.6), 1) + 0.05, True, 5.0, 0.01, 10.0, 9.0, 1.0, 2.0) for i in range(n)]
    d = spark.createDataFrame(rows, "symbol string, ret_6m double, above_sma200 boolean, turnover_20 double, atr_pct double, price double, prev_high double, atr double, vol_x50 double")
    ok = sorted((r[1] for r in rows if round(r[1], 9) >= 0.35), reverse=True)
    got = {r["symbol"]: r["tier"] for r in desk.swing(d).collect()}
    if len(ok) < 4:
        assert got == {}
    else:
        cut, top = ok[max(0, int(len(ok) * 0.25) - 1)], ok[max(0, int(len(ok) * 0.125) - 1)]
        assert got == {r[0]: "A" if r[1] >= top else "B" for r in rows if r[1] >= cut and round(r[1], 9) >= 0.35}


def walks(spark, n, symbols="AB"):
    rng, rows = random.Random(5), []
    for s in symbols:
        c = 100.0
        for i in range(n):
            c *= 1 + rng.uniform(-0.04, 0.04)
            if rng.random() < 0.8:
                rows.append((s, DAY0 + datetime.timedelta(i), round(c, 3)))
    return rows, spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)


@pytest.mark.parametrize("k", [1, 2, 5, 64, 252])
def test_drawdown_of_every_window(spark, k):
    rows, d = walks(spark, 400)
    closes = {s: [c for t, _, c in rows if t == s] for s in "AB"}
    places = {(s, day): i for s in "AB" for i, (_, day, _) in enumerate(r for r in rows if r[0] == s)}
    for r in sliding.drawdown(d, k).collect():
        i = places[r["symbol"], r["date"]]
        own, peak, worst = closes[r["symbol"]][max(0, i - k + 1) : i + 1], 0.0, 0.0
        for c in own:
            peak = max(peak, c)
            worst = min(worst, c / peak - 1)
        assert r["max_dd_1y"] == worst
    assert sliding.drawdown(d, k)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_newest_drawdown_needs_sixty_bars(spark):
    _, d = walks(spark, 60)
    assert technicals.max_drawdown(technicals.numbered(d)).count() == 0


def test_spacing_is_linear(spark):
    n = 1_000_000
    events = spark.range(n).selectExpr("'s' as signal", "1 as arm", "'A' as symbol", "cast(id as int) as session_no")
    start = time.perf_counter()
    got = sliding.spaced(events, ["signal", "arm", "symbol"], "session_no", 20)
    assert got.agg(F.count("*"), F.max("session_no")).first() == (n // 20, n - 20) and time.perf_counter() - start < 30


def test_spacing_of_many_groups(spark):
    rng = random.Random(3)
    rows = [(g, t) for g in ("x", "y", "z", None) for t in rng.choices(range(300), k=120)]
    want = []
    for g in ("x", "y", "z", None):
        last = None
        for t in sorted(t for h, t in rows if h == g):
            if last is None or t - last >= 7:
                want.append((g, t))
                last = t
    got = sliding.spaced(spark.createDataFrame(rows, "g string, t int").repartition(5), ["g"], "t", 7).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sorted_rank_takes_no_longer_for_wider_windows(spark):
    d = spark.range(60_000).selectExpr("'A' as symbol", "cast(id as int) as session_no", "rand(1) as x")
    took = []
    for k in (20, 20_000):
        start = time.perf_counter()
        sliding.sorted_rank(d, "x", k, 1, "p").agg(F.sum("p")).collect()
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 1


def test_sorted_rank_at_gaps_and_nulls(spark):
    rng = random.Random(8)
    rows = [(s, i, None if rng.random() < 0.2 else float(rng.randrange(9))) for s in "AB" for i in range(150) if rng.random() < 0.7]
    for r in sliding.sorted_rank(spark.createDataFrame(rows, "symbol string, session_no int, x double").repartition(3), "x", 30, 5, "p").collect():
        own = [v for s, i, v in rows if s == r["symbol"] and r["session_no"] - 30 < i <= r["session_no"] and v is not None]
        if r["x"] is None or len(own) < 5:
            assert r["p"] is None
        else:
            assert r["p"] == (sum(v < r["x"] for v in own) + (own.count(r["x"]) + 1) / 2) / len(own)


def test_as_of_days_without_a_join_of_rows_and_days(spark):
    rows, d = walks(spark, 200, "ABC")
    days = [DAY0 + datetime.timedelta(k) for k in (-9, 0, 1, 50, 51, 120, 199, 230, 400)]
    asks = spark.createDataFrame([(x, i) for i, x in enumerate(days)], "day date, no int")
    got = backtest.as_of(d, asks, "day")
    want = set()
    for s in "ABC":
        for i, x in enumerate(days):
            own = [(t, c) for u, t, c in rows if u == s and t <= x]
            if own:
                want.add((s, x, i, *max(own)))
    assert {(r["symbol"], r["day"], r["no"], r["date"], r["close"]) for r in got.collect()} == want
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert backtest.as_of(d, asks.where("no > 99"), "day").count() == 0


def test_movers_read_the_history_once(spark):
    rng = random.Random(6)
    rows = [(DAY0 + datetime.timedelta(7 * k), f"S{i:03d}", None if rng.random() < 0.1 else float(rng.randrange(40)), rng.random() < 0.6) for k in range(3) for i in range(150) if rng.random() < 0.9]
    h = spark.createDataFrame(rows, "asof date, symbol string, score double, passes boolean").withColumns({"sector": F.lit("x"), "price": F.lit(1.0)})
    of = [{s: (v, p) for d, s, v, p in rows if d == DAY0 + datetime.timedelta(7 * k)} for k in (2, 1)]
    now, before = ([s for s, (v, p) in sorted(x.items(), key=lambda y: (-(y[1][0] or 0), y[0])) if p and v is not None] for x in of)
    both = {s: of[0][s][0] - of[1][s][0] for s in of[0] if s in of[1] and of[0][s][0] is not None and of[1][s][0] is not None}
    new = [s for s, (_, p) in of[0].items() if p and not of[1].get(s, (0, False))[1]]
    want = {
        "new_top": [s for s in now[:20] if s not in before[:20]][:15], "left_top": sorted(s for s in before[:20] if s not in now[:20])[:15], "gainer": sorted(both, key=lambda s: (-both[s], s))[:10], "loser": sorted(both, key=lambda s: (both[s], s))[:10],
        "newly_pass": sorted(new, key=lambda s: (now.index(s) if s in now else 9999, s))[:15], "newly_fail": sorted(s for s, (_, p) in of[1].items() if p and not of[0].get(s, (0, False))[1])[:15],
    }
    got = desk.movers(h, top=20)
    found: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r["kind"], r["place"])):
        found.setdefault(r["kind"], []).append(r["symbol"])
    assert found == {k: v for k, v in want.items() if v}
