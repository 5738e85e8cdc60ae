"""Queries of technical features, as of each symbol's newest bar."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, rounded
from ..operators import technicals as T
from ..sources.panels import bars, bench
from .sql import BARS, BENCH, TECH, ema, pick

#: Query: plain columns, doubles.
FEATURES = {
    "w01_bars": ("bars", "price"),
    "w02_returns": ("", "ret_1w, ret_1m, ret_3m, ret_6m, ret_12m, mom_12_1"),
    "w03_ema": ("", "ema20, ema50, ema200"),
    "w04_stack": ("ema_stack, above_200_days", "vs_ema20, vs_ema50, vs_ema200, ema200_slope, ema50_slope"),
    "w06_volatility": ("", "vol_20, vol_60"),
    "w07_atr": ("", "atr, atr_pct"),
    "w08_sharpe": ("", "sharpe_3m, sharpe_6m"),
    "w11_52w": ("", "hi52, lo52, from_52h, from_52l, pos_52"),
    "w12_ranges": ("", "hi20, lo20, hi60, lo60, dist_hi20, dist_hi60, dist_lo20, tightness_20, tightness_atr"),
    "w13_eff_ratio": ("", "eff_ratio_60"),
    "w15_turnover": ("", "turnover_20, turnover_90, vol_ratio_20_50, vol_ratio_5_50"),
    "w16_updown": ("", "updown_vol_20"),
    "w17_structure": ("hh_count, hl_count, structure", ""),
    "w19_gap_days": ("gap_days_20, up_days_20", ""),
    "w23_swing_inputs": ("above_sma200", "prev_high, vol_x50, mbv2_level, mbv2_volneed"),
}


def split(cols: str) -> list[str]:
    return [c.strip() for c in cols.split(",") if c.strip()]


def feature(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, doubles = FEATURES[name]
    return rounded(T.newest(bars(spark, sf_dir)).select("symbol", *split(plain), *split(doubles)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten symbols of the highest mean percentile of distance to the 200-bar mean, 3-month return and range position."""
    now = T.newest(bars(spark, sf_dir)).select("symbol", "vs_ema200", "ret_3m", "pos_52")
    long = now.unpivot("symbol", ["vs_ema200", "ret_3m", "pos_52"], "factor", "value").where("value is not null")
    score = long.withColumn("p", average_rank("value", ["factor"])).groupBy("symbol").agg(F.avg("p").alias("score"))
    return rounded(score.orderBy(F.desc("score"), "symbol").limit(10))


def over_bench(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(f(b, bench(b)))


def of_bench(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f(bench(bars(spark, sf_dir))))


def of_tech(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f(T.technicals(bars(spark, sf_dir))))


def of_bars(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f(bars(spark, sf_dir)))


def lab_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and means on every bar, to test windows beyond the newest bar."""
    return rounded(T.technicals(bars(spark, sf_dir)).select("symbol", "date", "ret_1w", "ema20", "atr", "vol_20"), 4)


QUERIES = {name: partial(feature, name) for name in FEATURES} | {
    "flagship": flagship,
    "w05_every_bar": lab_bars,
    "w09_rs": partial(over_bench, T.relative_strength),
    "w10_rs_line": partial(over_bench, T.rs_line),
    "w14_bb_pctl": partial(of_tech, T.band_percentile),
    "w18_maxdd": partial(of_tech, T.max_drawdown),
    "w20_levels": partial(of_tech, T.levels),
    "w20_levels_desk": partial(of_tech, partial(T.levels, atrs=3.0)),
    "w21_weekly": partial(of_tech, T.weekly_closes),
    "w22_daily": partial(of_tech, partial(T.daily_tail, digits=4)),
    "w24_early": partial(of_bars, T.setups),
    "w43_index": partial(of_bench, T.index_ladder),
    "w44_regime": partial(of_bench, T.regime),
}


def _levels(atrs: int) -> str:
    two = lambda x, a: f"round({x}, 2) + 0.0 AS {a}"
    stop = f"(hi20 - {atrs} * atr)"
    cols = [
        two("hi20", "long_trigger"), two(stop, "long_stop"), two("least(lo20, ema50)", "long_alt_stop"), two("hi20 + 4 * atr", "long_t1"), two("hi20 + 6 * atr", "long_t2"),
        f"CASE WHEN close > {stop} THEN round((hi20 + 4 * atr - close) / greatest(close - {stop}, 1e-9), 2) END AS long_rr",
        two("lo20", "short_trigger"), two(f"lo20 + {atrs} * atr", "short_stop"), two("greatest(hi20, ema50)", "short_alt_stop"), two("lo20 - 4 * atr", "short_t1"), two("lo20 - 6 * atr", "short_t2"),
        two("least(ema50, ema200)", "buy_lo"), two("greatest(ema50, ema200)", "buy_hi"), two("least(lo52, ema200 * 0.92)", "lt_stop"),
    ]
    return f"WITH {TECH} SELECT symbol, {', '.join(cols)} FROM newest"


_SETUPS = f"""WITH {TECH},
u AS (SELECT *, CASE WHEN n > 21 THEN max(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS hi20y, CASE WHEN n > 51 THEN max(close) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS hi50y,
  CASE WHEN n > 6 THEN close / lag(close, 5) OVER w - 1 END AS r5, CASE WHEN n > 52 THEN lag(close, 1) OVER w / lag(close, 51) OVER w - 1 END AS r50b,
  max(close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS bhi, min(close) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS blo,
  lag(close, 63) OVER w / lag(close, 189) OVER w - 1 >= 0.30 AS up_base, max(close) OVER (w ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS h2y,
  max(close) OVER (w ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS h1y, min(close) OVER (w ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS l1y FROM tech WINDOW w AS (PARTITION BY symbol ORDER BY date)),
z AS (SELECT u.*, bb.bb_width_pctl FROM u LEFT JOIN bb USING (symbol) WHERE n = bars AND bars >= 60),
f AS (SELECT *, coalesce(n > 190 AND bhi / blo - 1 <= 0.25 AND up_base AND vs_ema200 > 0, false) AS base, coalesce(n > 400 AND h2y > h1y * 1.001 AND h1y / l1y - 1 <= 0.40, false) AS dormant FROM z),
g AS (SELECT *, base AND close > bhi AND vol_ratio_5_50 >= 1.3 AS breaks, dormant AND close > h2y AND vol_ratio_5_50 >= 1.3 AS wakes FROM f)
SELECT symbol, nullif(concat_ws(', ', CASE WHEN bb_width_pctl < 0.15 AND close > hi20y THEN 'squeeze release' END, CASE WHEN vol_ratio_5_50 >= 2.0 AND abs(r5) < 0.03 THEN 'volume wake' END,
  CASE WHEN close >= hi50y AND r50b < 0.10 THEN 'first thrust' END, CASE WHEN breaks THEN 'base breakout' END, CASE WHEN wakes THEN 'multiyear breakout' END), '') AS early_setup,
  coalesce(CASE WHEN base AND NOT breaks AND close >= 0.95 * bhi AND close < bhi THEN round(bhi, 2) END, CASE WHEN dormant AND NOT wakes AND close >= 0.95 * h2y AND close < h2y THEN round(h2y, 2) END) AS breakout_watch FROM g"""

_INDEX = f"{BARS}, {BENCH}, b0 AS (SELECT date, bench AS close, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS bars FROM bench), b1 AS (SELECT *, {ema('close', 2 / 201)} AS ema200, {ema('close', 2 / 51)} AS ema50, lag(close, 21) OVER w AS c21, lag(close, 63) OVER w AS c63, lag(close, 126) OVER w AS c126, lag(close, 252) OVER w AS c252, max(close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS top, abs(close - lag(close) OVER w) AS step, lag(close, 60) OVER w AS c60 FROM b0 WINDOW w AS (ORDER BY date))"

ORACLES = {name: pick(TECH, "newest", f"symbol, {plain}", doubles) for name, (plain, doubles) in FEATURES.items()} | {
    "flagship": f"WITH {TECH}, l AS (SELECT symbol, 'a' AS f, vs_ema200 AS v FROM newest UNION ALL SELECT symbol, 'b', ret_3m FROM newest UNION ALL SELECT symbol, 'c', pos_52 FROM newest), p AS (SELECT symbol, (rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0) / count(*) OVER (PARTITION BY f) * 100.0 AS p FROM l WHERE v IS NOT NULL) SELECT symbol, round(avg(p), 6) AS score FROM p GROUP BY symbol ORDER BY avg(p) DESC, symbol LIMIT 10",
    "w05_every_bar": pick(TECH, "tech", "symbol, date", "ret_1w, ema20, atr, vol_20", 4),
    "w09_rs": pick(TECH, "rs", "symbol", "rs_3m, rs_6m, rs_12m"),
    "w10_rs_line": pick(TECH, "rsl", "symbol", "rs_line_pos_52"),
    "w14_bb_pctl": pick(TECH, "bb", "symbol", "bb_width, bb_width_pctl"),
    "w18_maxdd": pick(TECH, "dd", "symbol", "max_dd_1y"),
    "w20_levels": _levels(2),
    "w20_levels_desk": _levels(3),
    "w21_weekly": f"WITH {BARS}, w AS (SELECT symbol, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE) AS week, arg_max(close, date) AS close FROM bars GROUP BY 1, 2) SELECT symbol, week, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) AS r FROM w) WHERE r <= 104",
    "w22_daily": f"WITH {TECH} SELECT symbol, date, round(close, 4) AS close, round(ema20, 4) AS ema20, round(ema50, 4) AS ema50, round(ema200, 4) AS ema200, round(volume, 0) AS volume FROM tech WHERE n > bars - 80 AND bars >= 60",
    "w24_early": _SETUPS,
    "w43_index": f"WITH {_INDEX} SELECT date, round(close, 6) AS level, round(close / c21 - 1, 6) + 0.0 AS ret_1m, round(close / c63 - 1, 6) + 0.0 AS ret_3m, round(close / c126 - 1, 6) + 0.0 AS ret_6m, round(close / c252 - 1, 6) + 0.0 AS ret_12m, CASE WHEN bars > 200 THEN round(close / ema200 - 1, 6) + 0.0 END AS vs_ema200 FROM b1 WHERE n = bars",
    "w44_regime": f"WITH {_INDEX}, e AS (SELECT *, CASE WHEN n > 60 THEN abs(close - c60) / nullif(sum(step) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) END AS er FROM b1), p AS (SELECT round(avg(CASE WHEN er < l THEN 1.0 ELSE 0.0 END), 2) AS pct FROM (SELECT er, arg_max(er, n) OVER () AS l FROM e) WHERE er IS NOT NULL) SELECT date, round(er, 4) AS eff_ratio_60, pct AS eff_ratio_pctl, CASE WHEN pct > 0.25 THEN 'TRENDING' ELSE 'CHOPPY' END AS regime, round(close / ema200 - 1, 4) + 0.0 AS vs_ema200, round(close / ema50 - 1, 4) + 0.0 AS vs_ema50, round(close / c21 - 1, 4) + 0.0 AS ret_1m, round(close / c63 - 1, 4) + 0.0 AS ret_3m, round(close / top - 1, 4) + 0.0 AS dd_from_high_1y FROM e, p WHERE n = bars AND bars >= 120",
}
