"""Queries of session features and the two event labs, over the weekly panel."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import events as E
from ..operators import sessions as G
from ..sources import panels
from . import given
from .sql import WEEKLY, pick

TURNOVER, LEAST, CONTROL = 450.0, 15, 10


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly(spark, sf_dir).withColumn("volume", F.col("qty") * 10000)


def brand_sectors(panel: DataFrame) -> DataFrame:
    """Brands by the first digit of their name: five sectors."""
    return panel.select("symbol").distinct().select("symbol", F.substring("symbol", 7, 1).alias("sector"))


def price_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekly_bars(spark, sf_dir)
    return G.excess(G.price_features(panel, panels.bench(panel), brand_sectors(panel), TURNOVER), "elig", False)


def flow_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.weekly(spark, sf_dir).withColumn("qty", F.col("qty") * 10000)
    return G.excess(G.flow_features(panel, TURNOVER), "elig", True, (5, 10, 20))


SESSION = {
    "w27_changes": "ret1, ret3, ret5, ret10, ret20, ret60, ret120, ret250",
    "w28_gap_mean": "e200, vs200",
    "w29_rolling": "hi20, lo20, hi252, lo252, pos52, v5, v50, vr5, vr1, turn20, bbw, gap, range",
    "w30_roll_rank": "bbw_pctl",
    "w32_rs20": "bench20, rs20, rsline, sec20",
    "w34_fwd": "fwd5, fwd10, fwd20, fwd40",
    "w35_excess": "xs5, xs10, xs20, xs40",
}
#: Turnovers are decimals of up to ten places, whose halves engines round either way; they are given whole.
WHOLE = {"turn20": 11}
FLOW = {"w33_move_inputs": "turn20, ret5, vr5, dpmed, oi5", "w35_excess_flow": "fwd5, fwd10, fwd20, xs5, xs10, xs20"}


def split(cols: str) -> list[str]:
    return [c.strip() for c in cols.split(",")]


def session_feature(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(price_lab(spark, sf_dir).select("symbol", "date", *split(SESSION[name])))


def flow_feature(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = split(FLOW[name])
    return flow_lab(spark, sf_dir).select("symbol", "date", *[F.round(c, WHOLE.get(c, 9)).alias(c) for c in cols])


def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_lab(spark, sf_dir).select("symbol", "date", "down3", "bars_ok", "elig", "bo52", "bo20", "tight", "nr7p", "rs_hi60")


def kept(lab, signals: dict, mask, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = lab(spark, sf_dir)
    return f, E.de_overlap(E.hits(f, signals, mask))


def price_mask():
    return F.col("elig") & F.col("bars_ok")


def signal(lab, signals: dict, mask, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal's events and control events after de-overlap, with their 20-session excess."""
    f, k = kept(lab, {name: signals[name]}, mask(), spark, sf_dir)
    return rounded(E.with_excess(k, f, (20,)))


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hits(price_lab(spark, sf_dir), E.PRICE_SIGNALS, price_mask()).groupBy("signal", "arm").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


def all_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(price_lab, E.PRICE_SIGNALS, price_mask(), spark, sf_dir)[1]


def price_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = kept(price_lab, E.PRICE_SIGNALS, price_mask(), spark, sf_dir)
    middle = weekly_bars(spark, sf_dir).agg(F.floor(F.count_distinct("date") / 2) + 1).scalar()
    return rounded(E.price_verdicts(E.with_excess(k, f, (10, 20, 40)).withColumn("mid", middle), F.col("mid"), LEAST, CONTROL))


def flow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = kept(flow_lab, E.FLOW_SIGNALS, F.col("elig"), spark, sf_dir)
    return rounded(E.flow_verdicts(E.with_excess(k, f, (5, 10, 20)), LEAST, CONTROL))


QUERIES = (
    {name: partial(session_feature, name) for name in SESSION} | {name: partial(flow_feature, name) for name in FLOW}
    | {f"{name}_signal": partial(signal, price_lab, E.PRICE_SIGNALS, price_mask, name) for name in E.PRICE_SIGNALS}
    | {f"{name}_signal": partial(signal, flow_lab, E.FLOW_SIGNALS, lambda: F.col("elig"), name) for name in E.FLOW_SIGNALS}
    | {"w31_flags": session_flags, "ev0_hits": raw_hits, "ev1_dedup": all_kept, "ev4_verdict_price": price_verdicts, "ev5_verdict_flow": flow_verdicts}
)

# --- SQL


def g(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY symbol ORDER BY session_no RANGE BETWEEN {side(a)} AND {side(b)})"


def sh(x: str, k: int) -> str:
    return f"max({x}) {g(-k, -k)}"


def ro(f: str, x: str, k: int, least: int | None = None, skip: int = 0) -> str:
    w = g(-(k + skip - 1), -skip)
    return f"CASE WHEN count({x}) {w} >= {k if least is None else least} THEN {f.format(x)} {w} END"


_ch = lambda x, k: f"{x} / nullif({sh(x, k)}, 0) - 1"
_xs = lambda hs, mask: (", ".join(f"{'CASE WHEN elig THEN ' if mask else ''}{sh('close', -h)} / close - 1{' END' if mask else ''} AS fwd{h}" for h in hs), ", ".join(f"fwd{h} - avg(CASE WHEN elig THEN fwd{h} END) OVER (PARTITION BY session_no) AS xs{h}" for h in hs))
_A = repr(2 / 201)
_FWD, _XS = _xs(G.HORIZONS, False)
PRICE = f"""{WEEKLY},
s0 AS (SELECT *, qty * 10000 AS volume, dense_rank() OVER (ORDER BY date) AS session_no, avg(close) OVER (PARTITION BY date) AS bench, substring(symbol, 7, 1) AS sector FROM weekly),
p AS (SELECT symbol, session_no, close, row_number() OVER (PARTITION BY symbol ORDER BY session_no) AS i FROM s0),
ew AS (SELECT symbol, session_no, i, close AS y FROM p WHERE i = 1 UNION ALL SELECT p.symbol, p.session_no, p.i, (pow(1 - {_A}, p.session_no - ew.session_no) * ew.y + {_A} * p.close) / (pow(1 - {_A}, p.session_no - ew.session_no) + {_A}) FROM ew JOIN p ON p.symbol = ew.symbol AND p.i = ew.i + 1),
s1 AS (SELECT s0.*, CASE WHEN i >= 200 THEN y END AS e200 FROM s0 JOIN ew USING (symbol, session_no)),
s2 AS (SELECT *, {", ".join(f"{_ch('close', k)} AS ret{k}" for k in (1, 3, 5, 10, 20, 60, 120, 250))}, close / e200 - 1 AS vs200, high - low AS range, {sh("close", 1)} AS c1, close * volume / 1e7 AS turn,
  {ro("avg({})", "volume", 5)} AS v5, {ro("avg({})", "volume", 50)} AS v50, {ro("max({})", "high", 20)} AS hi20, {ro("min({})", "low", 20)} AS lo20, {ro("max({})", "high", 252)} AS hi252, {ro("min({})", "low", 252)} AS lo252,
  4 * {ro("stddev_samp({})", "close", 20)} / {ro("avg({})", "close", 20)} AS bbw, count(close) {g(-259, 0)} >= 250 AS bars_ok, close / bench AS rsline, {_ch("bench", 20)} AS bench20 FROM s1),
s3 AS (SELECT *, v5 / v50 AS vr5, volume / v50 AS vr1, {ro("avg({})", "turn", 20)} AS turn20, (close - lo252) / (hi252 - lo252 + 1e-9) AS pos52, range <= ({ro("min({})", "range", 7)}) + 1e-12 AS nr7, coalesce(sum(CASE WHEN ret1 < 0 THEN 1 WHEN ret1 >= 0 THEN 0 END) {g(-2, 0)} = 3, false) AS down3,
  open / c1 - 1 AS gap, ret20 - bench20 AS rs20, coalesce(rsline >= ({ro("max({})", "rsline", 60)}) - 1e-12, false) AS rs_hi60, {sh("hi252", 1)} AS p_hi, {sh("hi20", 1)} AS hi20p, {sh("lo20", 1)} AS lo20p, {sh("high", 1)} AS h1, {sh("low", 1)} AS l1,
  list(bbw) FILTER (WHERE bbw IS NOT NULL) {g(-251, 0)} AS bl FROM s2),
s4 AS (SELECT *, CASE WHEN bbw IS NOT NULL AND len(bl) >= 60 THEN (len(list_filter(bl, lambda v: v < bbw)) + (len(list_filter(bl, lambda v: v = bbw)) + 1) / 2.0) / len(bl) END AS bbw_pctl, coalesce(close > p_hi AND c1 <= {sh("p_hi", 1)}, false) AS bo52, coalesce(close > hi20p, false) AS bo20,
  coalesce({sh("nr7", 1)}, false) AS nr7p, coalesce(turn20 >= {TURNOVER} AND ret250 IS NOT NULL, false) AS elig, quantile_cont(ret20, 0.5) OVER (PARTITION BY session_no, sector) AS sec20 FROM s3),
s5 AS (SELECT *, coalesce({sh("bbw_pctl", 1)} < 0.2, false) AS tight, {_FWD} FROM s4),
lab AS MATERIALIZED (SELECT *, {_XS} FROM s5)"""
_FWDF, _XSF = _xs((5, 10, 20), True)
FLOWS = f"""{WEEKLY},
s0 AS (SELECT symbol, date, close, qty * 10000 AS qty, deliv_per, oi, close * qty * 10000 / 1e7 AS turn, dense_rank() OVER (ORDER BY date) AS session_no FROM weekly),
s1 AS (SELECT *, {ro("avg({})", "turn", 20, 10)} AS turn20, {_ch("close", 5)} AS ret5, ({ro("avg({})", "qty", 5)}) / ({ro("avg({})", "qty", 50, 30, 5)}) AS vr5, {_ch("oi", 5)} AS oi5, CASE WHEN count(deliv_per) {g(-60, -1)} >= 30 THEN quantile_cont(deliv_per, 0.5) {g(-60, -1)} END AS dpmed, count(close) {g(-59, 0)} >= 60 AS full60 FROM s0),
s2 AS (SELECT *, coalesce(turn20 >= {TURNOVER} AND full60, false) AS elig, coalesce(deliv_per >= 1.5 * dpmed AND deliv_per >= 50, false) AS dpspk FROM s1),
s5 AS (SELECT *, {_FWDF} FROM s2),
lab AS MATERIALIZED (SELECT *, {_XSF} FROM s5)"""


def sql_kept(lab: str, signals: dict, mask: str) -> str:
    arms = " UNION ALL ".join(f"SELECT '{name}' AS signal, {arm} AS arm, symbol, session_no FROM lab WHERE {mask} AND ({p})" for name, pair in signals.items() for arm, p in ((1, pair[0]), (0, pair[1])) if p)
    return f"{lab}, ev AS MATERIALIZED ({arms}), kept AS (SELECT signal, arm, symbol, min(session_no) AS session_no FROM ev GROUP BY 1, 2, 3 UNION ALL SELECT k.signal, k.arm, k.symbol, min(e.session_no) FROM kept k JOIN ev e ON e.signal = k.signal AND e.arm = k.arm AND e.symbol = k.symbol AND e.session_no >= k.session_no + 20 GROUP BY k.signal, k.arm, k.symbol, k.session_no)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_KEPT_P, _KEPT_F = sql_kept(PRICE, given.PRICE_SIGNALS, "elig AND bars_ok"), sql_kept(FLOWS, given.FLOW_SIGNALS, "elig")
_one = lambda lab, signals, mask, name: f"WITH RECURSIVE {sql_kept(lab, {name: signals[name]}, mask)} SELECT symbol, session_no, signal, arm, round(xs20, 6) + 0.0 AS xs20 FROM kept JOIN lab USING (symbol, session_no)"
_m = lambda arm, x, more="": f"avg(CASE WHEN arm = {arm}{more} THEN {x} END)"
_VERDICT_P = f"""WITH RECURSIVE {_KEPT_P}, x AS (SELECT * FROM kept JOIN lab USING (symbol, session_no)), mid AS (SELECT max(session_no) // 2 + 1 AS mid FROM lab),
v AS (SELECT signal, count(*) FILTER (WHERE arm = 1) AS n, count(*) FILTER (WHERE arm = 0) AS ctrl_n, {", ".join(f"{_m(1, f'xs{h}')} AS x{h}, avg(CASE WHEN arm = 1 AND xs{h} IS NOT NULL THEN CASE WHEN xs{h} > 0 THEN 1.0 ELSE 0.0 END END) AS w{h}" for h in (10, 20, 40))},
  {_m(1, "xs20", " AND session_no <= mid")} AS h1, {_m(1, "xs20", " AND session_no >= mid")} AS h2, CASE WHEN count(*) FILTER (WHERE arm = 0) > {CONTROL} THEN {_m(0, "xs20")} END AS ctrl20 FROM x, mid GROUP BY signal)
SELECT signal, n, ctrl_n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("x10", "w10", "x20", "w20", "x40", "w40", "h1", "h2", "ctrl20"))}, CASE WHEN n < {LEAST} THEN 'too few events' WHEN x20 <= ctrl20 THEN 'no edge vs control' WHEN x20 <= 0 THEN 'negative'
  WHEN NOT coalesce((h1 > 0) = (h2 > 0) AND h1 * h2 >= 0, false) THEN 'not robust (halves disagree)' WHEN x20 > 0.01 AND w20 > 0.5 THEN 'SURVIVOR' ELSE 'weak positive' END AS verdict FROM v"""
_VERDICT_F = f"""WITH RECURSIVE {_KEPT_F}, x AS (SELECT * FROM kept JOIN lab USING (symbol, session_no)),
d AS (SELECT signal, session_no, row_number() OVER (PARTITION BY signal ORDER BY session_no) AS i, count(*) OVER (PARTITION BY signal) AS m FROM (SELECT DISTINCT signal, session_no FROM kept WHERE arm = 1)),
mid AS (SELECT signal, session_no AS mid FROM d WHERE m > 4 AND i = m // 2 + 1),
v AS (SELECT signal, count(CASE WHEN arm = 1 THEN xs20 END) AS n, count(CASE WHEN arm = 0 THEN xs20 END) AS ctrl_n, {", ".join(f"{_m(1, f'xs{h}')} AS x{h}" for h in (5, 10, 20))}, avg(CASE WHEN arm = 1 AND xs20 IS NOT NULL THEN CASE WHEN xs20 > 0 THEN 1.0 ELSE 0.0 END END) AS win,
  {_m(1, "xs20", " AND session_no <= mid")} AS h1, {_m(1, "xs20", " AND session_no >= mid")} AS h2, CASE WHEN count(CASE WHEN arm = 0 THEN xs20 END) >= {CONTROL} THEN {_m(0, "xs20")} END AS ctrl20 FROM x LEFT JOIN mid USING (signal) GROUP BY signal)
SELECT signal, n, ctrl_n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("x5", "x10", "x20", "win", "h1", "h2", "ctrl20"))}, CASE WHEN n < {LEAST} THEN 'too few' WHEN x20 IS NULL THEN '?' WHEN x20 - ctrl20 < 0.002 THEN 'no edge vs control' WHEN x20 <= 0 THEN 'negative'
  WHEN NOT coalesce(sign(h1) = sign(h2), false) THEN 'not robust (halves disagree)' WHEN x20 >= 0.005 AND (ctrl20 IS NULL OR x20 - ctrl20 >= 0.004) THEN 'SURVIVOR' ELSE 'weak positive' END AS verdict FROM v"""

ORACLES = (
    {name: recursive(pick(PRICE, "lab", "symbol, date", cols)) for name, cols in SESSION.items()} | {name: f"WITH {FLOWS} SELECT symbol, date, {', '.join(f'round(CAST({c} AS DOUBLE), {WHOLE.get(c, 9)}) + 0.0 AS {c}' for c in split(cols))} FROM lab" for name, cols in FLOW.items()}
    | {f"{name}_signal": _one(PRICE, given.PRICE_SIGNALS, "elig AND bars_ok", name) for name in given.PRICE_SIGNALS} | {f"{name}_signal": _one(FLOWS, given.FLOW_SIGNALS, "elig", name) for name in given.FLOW_SIGNALS}
    | {
        "w31_flags": f"WITH RECURSIVE {PRICE} SELECT symbol, date, down3, bars_ok, elig, bo52, bo20, tight, nr7p, rs_hi60 FROM lab",
        "ev0_hits": f"WITH RECURSIVE {_KEPT_P} SELECT signal, arm, count(*) AS n, count(DISTINCT symbol) AS symbols FROM ev GROUP BY 1, 2",
        "ev1_dedup": f"WITH RECURSIVE {_KEPT_P} SELECT signal, arm, symbol, session_no FROM kept", "ev4_verdict_price": _VERDICT_P, "ev5_verdict_flow": _VERDICT_F,
    }
)
