"""Edge cases against small expectations worked out by hand or in pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions.columns import average_rank, cagr, growth, labels, mean_of, ratio, rounded
from tapewright.operators import backtest, desk, events, feeds, radar, scoring, sessions, sliding, statements, technicals

DAY0 = dt.date(2020, 1, 1)


def bars(spark, symbols):
    rows = [(s, DAY0 + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, 1000.0 + i) for s, closes in symbols.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def walk(n, seed=0):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))).tolist()


def one(df):
    return df.first().asDict()


def test_scalar_helpers(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, -2.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in d.select(ratio(F.col("a"), F.col("b")), growth(F.col("a"), F.col("b")), cagr(F.col("a"), F.col("b"), 2), mean_of(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (None, None, None, 0.5) and got[1] == (0.5, 0.5, None, -1.5) and got[3] == (None, None, None, 1.0)
    assert got[2] == pytest.approx((1.5, 0.5, 1.5**0.5 - 1, 2.5))
    assert d.select(labels((F.col("a") > 0, "x"), (F.col("b") > 0, "y")).alias("l")).collect()[3]["l"] == ["y"]
    assert rounded(d.limit(1)).columns == ["a", "b"]


def test_average_rank_has_pandas_ties(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, None, 5.0)], "v double").where("v is not null")
    assert sorted(r[0] for r in d.select(average_rank("v", [])).collect()) == [25.0, 62.5, 62.5, 100.0]


@pytest.mark.parametrize("n", [1, 59, 60, 61, 199, 200, 252, 253, 254, 401])
def test_history_guards(spark, n):
    t = technicals.technicals(bars(spark, {"A": walk(n)}))
    rows = technicals.latest(t).collect()
    if n < 60:
        assert not rows
        return
    r = rows[0]
    assert (r["ret_12m"] is not None) == (n > 252) and (r["mom_12_1"] is not None) == (n > 253) and (r["ema200_slope"] is not None) == (n > 220)
    assert (r["above_200_days"] is not None) == (n >= 200) and (r["eff_ratio_60"] is not None) == (n > 61) and r["above_sma200"] in (True, False)
    c = pd.Series(walk(n))
    assert r["ema20"] == pytest.approx(c.ewm(span=20, adjust=False).mean().iloc[-1], rel=1e-12)
    assert r["ema200"] == pytest.approx(c.ewm(span=200, adjust=False).mean().iloc[-1], rel=1e-12)
    h, low, p = c * 1.01, c * 0.99, c.shift(1)
    tr = np.maximum(h - low, np.maximum((h - p).abs(), (low - p).abs()))[1:]
    assert r["atr"] == pytest.approx(tr.ewm(alpha=1 / 14, adjust=False).mean().iloc[-1], rel=1e-12)


def test_constant_prices_divide_by_nothing(spark):
    r = one(technicals.latest(technicals.technicals(bars(spark, {"A": [5.0] * 300}))))
    assert r["sharpe_6m"] == 0 and r["bb_width"] == 0 and r["pos_52"] == pytest.approx(0.05 / 0.1, abs=1e-6) and r["ema_stack"] == 0


def test_features_are_causal(spark):
    b = bars(spark, {"A": walk(320), "B": walk(320, 1)})
    cut = DAY0 + dt.timedelta(days=280)
    whole = technicals.technicals(b).where(F.col("date") == F.lit(cut)).drop("bars").orderBy("symbol").collect()
    part = technicals.technicals(technicals.as_of(b, F.lit(cut))).where(F.col("date") == F.lit(cut)).drop("bars").orderBy("symbol").collect()
    for x, y in zip(whole, part, strict=True):
        for k in x.asDict():
            assert x[k] == (pytest.approx(y[k]) if isinstance(y[k], float) else y[k]), k


def test_duplicates_keep_the_first(spark):
    b = bars(spark, {"A": [3.0, 4.0]})
    twice = b.unionByName(b.withColumn("close", F.col("close") + 1))
    assert sorted(r["close"] for r in technicals.first_of_day(twice).collect()) == [3.0, 4.0]


def test_drawdown(spark):
    d = technicals.numbered(bars(spark, {"A": [1.0, 2.0, 1.0, 3.0] + [3.0] * 60}))
    assert one(technicals.max_drawdown(d))["max_dd_1y"] == -0.5


def test_gap_aware_mean_is_that_of_pandas(spark):
    closes, rng = walk(80), np.random.default_rng(1)
    keep = sorted({0, *rng.choice(80, 50, replace=False).tolist()})
    b = bars(spark, {"A": closes, "B": closes}).where((F.col("symbol") == "A") | F.datediff("date", F.lit(DAY0)).isin([int(k) for k in keep]))
    got = sessions.gap_aware_mean(sessions.number_sessions(b), "close", 2 / 11, 10, "m").where("symbol = 'B'").orderBy("date").collect()
    s = pd.Series([closes[i] if i in keep else np.nan for i in range(80)]).ewm(alpha=2 / 11, adjust=False, min_periods=10).mean()
    for r in got:
        want = s.iloc[(r["date"] - DAY0).days]
        assert (r["m"] is None) == bool(np.isnan(want)) and (r["m"] is None or r["m"] == pytest.approx(want, rel=1e-12))


def test_rolling_rank_is_that_of_pandas(spark):
    closes = [round(c, 0) for c in walk(90)]
    got = sliding.sorted_rank(sessions.number_sessions(bars(spark, {"A": closes})), "close", 30, 10, "p").orderBy("date").collect()
    want = pd.Series(closes).rolling(30, min_periods=10).rank(pct=True)
    assert all((r["p"] is None and np.isnan(w)) or r["p"] == pytest.approx(w) for r, w in zip(got, want, strict=True))


def test_de_overlap(spark):
    e = spark.createDataFrame([("s", 1, "A", i) for i in (1, 5, 20, 22, 41)], "signal string, arm int, symbol string, session_no int")
    assert sorted(r["session_no"] for r in events.de_overlap(e).collect()) == [1, 22]


@pytest.mark.parametrize("n", [30, 32, 37, 95])
def test_deciles_are_those_of_qcut(spark, n):
    rows = [("c", f"s{i:03d}", float(i), 0.0, n) for i in range(n)]
    got = backtest.ranked(spark.createDataFrame(rows, "cohort string, symbol string, score double, fwd double, n_elig int")).orderBy("score").collect()
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 10, labels=False) + 1
    assert [r["decile"] for r in got] == want.tolist()


def test_aliases_take_a_whole_series(spark):
    rows = [("A", "inc_a", "Total Revenue", "2020-12-31", None), ("A", "inc_a", "Operating Revenue", "2020-12-31", 5.0), ("A", "inc_a", "Operating Revenue", "2019-12-31", 4.0), ("A", "inc_a", "EBITDA", "2019-12-31", 1.0), ("A", "inc_a", "Normalized EBITDA", "2020-12-31", 2.0)]
    lines = spark.createDataFrame(rows, "symbol string, stmt string, item string, period_end string, value double").withColumn("period_end", F.to_date("period_end"))
    got = {(r["concept"], str(r["period_end"])): r["value"] for r in statements.resolve(lines).collect()}
    assert got[("rev", "2020-12-31")] == 5.0 and got[("ebitda", "2019-12-31")] == 1.0 and ("ebitda", "2020-12-31") not in got
    assert statements.wide(statements.resolve(lines)).count() == 2


def test_a_leap_day_has_no_year_before(spark):
    assert spark.range(1).select(statements.year_before(F.lit("2024-02-29"))).first()[0] == "2023-02-29"


@pytest.mark.parametrize(("ratio_", "rate"), [(83.0, 83.0), (39.0, 1.0), (40.0, 1.0), (150.0, 1.0), (149.999, 150.0)])
def test_currency_window_is_open(spark, ratio_, rate):
    assert spark.range(1).select(statements.fx(F.lit(2.0), F.lit(ratio_), F.lit(2.0))).first()[0] == rate


def test_lenders(spark):
    rows = [("Financial Services", "Banks - Regional", True), ("Financial Services", "Capital Markets", False), ("Financial Services", "", True), ("Technology", "Banking software", False), (None, None, False), ("Financial Services", "Insurance", True)]
    got = spark.createDataFrame(rows, "s string, i string, want boolean").select(statements.is_lender(F.col("s"), F.col("i")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_gates_with_nothing_known(spark):
    cols = ["bars", "turnover_20", "pat_ttm", "vs_ema200", "atr_pct", "pe", "other_inc_pbt", "dilution_3y", "dilution_hist", "cfo_pat_3y", "p_growth", "p_quality"]
    d = spark.range(1).select(F.lit(False).alias("lender"), *[F.lit(None).cast("double").alias(c) for c in cols])
    assert d.select(scoring.gates("longterm")).first()[0] == ["history", "turnover", "loss-making"]
    assert d.select(scoring.gates("swing_long")).first()[0] == ["history", "turnover", "loss-making", "below 200 EMA", "ATR too low", "growth unconfirmed", "quality unconfirmed"]


def test_a_composite_of_nothing_is_neutral(spark):
    d = spark.range(1).select(*[F.lit(None).cast("double").alias(f"p_{p}") for p in scoring.PILLARS])
    for m in scoring.MODES:
        assert tuple(d.select(*scoring.composite(m)).first()) == (50.0, 0.0)
    assert tuple(d.select(*scoring.composite("longterm", {"quality": 0})).first()) == (None, 0.0)


def test_sector_blend_needs_eight(spark):
    rows = [(f"s{i}", "big" if i < 8 else "small", False, "opm", float(i)) for i in range(15)]
    p = {r["symbol"]: r["p"] for r in scoring.percentiles(spark.createDataFrame(rows, "symbol string, sector string, lender boolean, factor string, value double")).collect()}
    assert p["s0"] == pytest.approx(0.5 * 100 / 15 + 0.5 * 100 / 8) and p["s14"] == 100.0


def test_corporate_actions(spark):
    stays, back, last = [100.0] * 10 + [25.0] * 10, [100.0] * 10 + [25.0, 60.0] + [100.0] * 8, [100.0] * 19 + [25.0]
    got = radar.repair(bars(spark, {"stays": stays, "back": back, "last": last})).orderBy("date").collect()
    first = {r["symbol"]: r["adj"] for r in got if r["date"] == DAY0}
    assert first == {"stays": 25.0, "back": 100.0, "last": 100.0}


def test_interval_year_ago(spark):
    rows = [("A", "2021-03-31", 2.0, 1.0), ("A", "2020-03-31", -1.0, 2.0), ("A", "2020-06-30", 9.0, 9.0), ("B", "2021-03-31", 1.0, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, period_end string, pat double, sales double").withColumn("period_end", F.to_date("period_end"))
    got = {r["symbol"]: r for r in feeds.year_ago(d).collect()}
    assert got["A"]["pat_yoy"] == 3.0 and got["A"]["sales_yoy"] == -0.5 and got["B"]["pat_yoy"] is None


def test_expected_sessions(spark):
    # 10:29 UTC is 15:59 in India; 2024-01-15 was a Monday
    rows = [("2024-01-15 10:29:00", "2024-01-12"), ("2024-01-15 10:31:00", "2024-01-15"), ("2024-01-14 12:00:00", "2024-01-12")]
    d = spark.createDataFrame(rows, "t string, want string")
    assert all(str(r[0]) == r[1] for r in d.select(feeds.expected_session(F.to_timestamp("t")), "want").collect())


def test_json_helpers(spark):
    docs = ['{"data":[{"symbol":"A"},{"x":[{"symbol":"B"}]}]}', '{"symbol":""}', "no json", None]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    assert {tuple(r) for r in feeds.harvest(d, "doc").collect()} == {(0, "A"), (0, "B")} and feeds.harvest(d.where("id > 1"), "doc").count() == 0
    row = {"Net": F.lit(" - "), "sales": F.lit("5")}
    assert spark.range(1).select(feeds.pick(row, ["net", "SALES"]), feeds.pick(row, ["none"])).first()[:] == ("5", None)


def test_movers_and_retention(spark):
    rows = [(dt.date(2024, 1, d), f"s{i}", 10.0, float((i * d) % 7), i % 2 == 0) for d in range(1, 5) for i in range(10)]
    h = spark.createDataFrame(rows, "asof date, symbol string, price double, score double, passes boolean")
    assert desk.retained(h, 2).select("asof").distinct().count() == 3
    assert desk.deltas(h).count() == 10 and desk.movers(h, 3).count() > 0
    assert desk.track_record(h, 2, 3).count() == 3
