"""The model's fixed values as the oracles' SQL states them: written down apart from the operators, so that a slip in either shows."""

from __future__ import annotations

# Factor, whether higher is better, pillar, ranked in its sector too, counts for lenders, counts for others.
FACTORS = """
('roce', true, 'quality', false, false, true), ('roce_3y_avg', true, 'quality', false, false, true), ('roe', true, 'quality', false, true, true), ('roe_3y_avg', true, 'quality', false, true, true),
('roa', true, 'quality', false, true, false), ('opm', true, 'quality', true, false, true), ('opm_delta', true, 'quality', false, false, true), ('npm', true, 'quality', true, true, false),
('sales_g3', true, 'growth', false, true, true), ('sales_g1', true, 'growth', false, true, true), ('pat_g3', true, 'growth', false, true, true), ('pat_g1', true, 'growth', false, true, true),
('q_rev_yoy', true, 'growth', false, true, true), ('q_pat_yoy', true, 'growth', false, true, true), ('ttm_pat_vs_fy', true, 'growth', false, true, true),
('de', false, 'balance', true, false, true), ('net_debt_ebitda', false, 'balance', false, false, true), ('int_cover', true, 'balance', false, false, true), ('dilution_3y', false, 'balance', false, true, true),
('current_ratio', true, 'balance', true, false, true), ('leverage', false, 'balance', true, true, false),
('cfo_pat_3y', true, 'cash', false, false, true), ('cfo_pat', true, 'cash', false, false, true), ('fcf_yield', true, 'cash', false, false, true), ('fcf_pos_years', true, 'cash', false, false, true),
('other_inc_pbt', false, 'cash', false, false, true), ('rec_days_delta', false, 'cash', false, false, true),
('pe', false, 'valuation', true, true, true), ('pb', false, 'valuation', true, true, true), ('ev_ebitda', false, 'valuation', true, false, true), ('peg', false, 'valuation', false, true, true), ('earnings_yield', true, 'valuation', true, true, true),
('promoter', true, 'ownership', false, true, true), ('institutions', true, 'ownership', false, true, true),
('vs_ema200', true, 'trend', false, true, true), ('vs_ema50', true, 'trend', false, true, true), ('ema_stack', true, 'trend', false, true, true), ('ema200_slope', true, 'trend', false, true, true), ('above_200_days', true, 'trend', false, true, true),
('ret_3m', true, 'momentum', false, true, true), ('ret_6m', true, 'momentum', false, true, true), ('mom_12_1', true, 'momentum', false, true, true), ('sharpe_6m', true, 'momentum', false, true, true),
('rs_3m', true, 'rs', false, true, true), ('rs_6m', true, 'rs', false, true, true), ('rs_12m', true, 'rs', false, true, true), ('rs_line_pos_52', true, 'rs', false, true, true),
('pos_52', true, 'structure', false, true, true), ('structure', true, 'structure', false, true, true), ('dist_hi60', false, 'structure', false, true, true), ('eff_ratio_60', true, 'structure', false, true, true), ('max_dd_1y', true, 'structure', false, true, true),
('turnover_20', true, 'volume', false, true, true), ('updown_vol_20', true, 'volume', false, true, true), ('vol_ratio_20_50', true, 'volume', false, true, true)
"""  # fmt: skip
# How many factors a pillar has, and the ratios that are held between their quantiles.
PILLARS = {"quality": 8, "growth": 7, "balance": 6, "cash": 6, "valuation": 5, "ownership": 2, "trend": 5, "momentum": 4, "rs": 4, "structure": 5, "volume": 3}
WINSORISED = "'pe', 'pb', 'ev_ebitda', 'peg', 'int_cover', 'cfo_pat', 'cfo_pat_3y', 'net_debt_ebitda', 'de', 'updown_vol_20', 'vol_ratio_20_50'"
# A mode's pillars as they count, with their weights, and its gates with their labels, in order.
SCORES = {
    "longterm": {"p_quality": 20, "p_growth": 15, "p_balance": 10, "p_cash": 10, "p_valuation": 15, "p_ownership": 5, "p_trend": 10, "p_momentum": 5, "p_rs": 5, "p_structure": 3, "p_volume": 2},
    "swing_long": {"p_trend": 22, "p_momentum": 26, "p_rs": 24, "p_structure": 18, "p_volume": 10},
    "swing_short": {"100 - p_trend": 22, "100 - p_momentum": 26, "100 - p_rs": 24, "100 - p_structure": 18, "p_volume": 10},
}
GATES = {
    "longterm": [("coalesce(bars, 0) < 200", "history"), ("NOT coalesce(turnover_20, 0) >= 2", "turnover"), ("NOT coalesce(pat_ttm, 0) > 0", "loss-making"), ("pe < 3", "P/E < 3 (one-off gain?)"), ("other_inc_pbt > 0.30", "other income"), ("coalesce(dilution_3y, dilution_hist) > 0.25", "dilution")],
    "swing_long": [
        ("coalesce(bars, 0) < 200", "history"), ("NOT coalesce(turnover_20, 0) >= 25", "turnover"), ("NOT coalesce(pat_ttm, 0) > 0", "loss-making"), ("NOT coalesce(vs_ema200, 0) > 0", "below 200 EMA"), ("NOT coalesce(atr_pct, 0) >= 0.015", "ATR too low"), ("vs_ema200 > 0.30", "over-extended"),
        ("coalesce(dilution_3y, dilution_hist) > 0.10", "dilution"), ("NOT lender AND cfo_pat_3y < 0.5", "cash conversion"), ("NOT coalesce(p_growth >= 40, false)", "growth unconfirmed"), ("NOT coalesce(p_quality >= 40, false)", "quality unconfirmed"),
    ],
    "swing_short": [("coalesce(bars, 0) < 200", "history"), ("NOT coalesce(turnover_20, 0) >= 25", "turnover"), ("NOT coalesce(vs_ema200, 0) < 0", "above 200 EMA"), ("NOT coalesce(atr_pct, 0) >= 0.015", "ATR too low")],
}
# Signals and their controls.
PRICE_SIGNALS = {
    "e01": ("bo52 AND vr1 >= 2", "bo52 AND vr1 < 2"), "e02": ("bo52 AND vr1 >= 2 AND vs200 <= 0.5", "bo52 AND vr1 >= 2"), "e03": ("tight AND bo20 AND vr1 >= 1.5", "NOT tight AND bo20 AND vr1 >= 1.5"), "e04": ("nr7p AND close > h1", "nr7p AND close < l1"),
    "e05": ("down3 AND vs200 > 0", "down3 AND vs200 < 0"), "e06": ("down3 AND vs200 > 0 AND low <= 1.005 * lo20p", "down3 AND vs200 > 0"), "e07": ("gap > 0.04 AND vr1 >= 3", "gap > 0.04 AND vr1 < 1.5"), "e08": ("gap < -0.04 AND vr1 >= 3", None),
    "e09": ("vr5 <= 0.5 AND close <= 1.01 * lo20p AND vs200 > 0", "vr5 <= 0.5 AND close <= 1.01 * lo20p AND vs200 < 0"), "e10": ("bo20 AND rs_hi60 AND vr1 >= 1.2", "bo20 AND NOT rs_hi60 AND vr1 >= 1.2"), "e11": ("vs200 > 0.6 AND ret20 > 0.15", None),
    "e12": ("vr5 >= 2 AND abs(ret5) < 0.02", "abs(ret5) < 0.02"), "e13": ("sec20 > 0.05 AND ret20 < 0 AND vs200 > 0", "sec20 > 0.05 AND ret20 > 0.05"),
}
FLOW_SIGNALS = {
    "d01": ("dpspk AND abs(ret5) < 0.03", "dpspk AND ret5 > 0.05"), "d02": ("vr5 >= 2 AND dpspk AND abs(ret5) < 0.03", "vr5 >= 2 AND abs(ret5) < 0.03 AND NOT dpspk"), "d03": ("ret5 < -0.05 AND deliv_per >= 75", "ret5 < -0.05 AND deliv_per <= 40"),
    "d04": ("ret5 > 0.05 AND deliv_per <= 0.5 * dpmed", "ret5 > 0.05 AND dpspk"), "d05": ("oi5 >= 0.15 AND abs(ret5) < 0.02", "oi5 >= 0.15 AND ret5 > 0.03"), "d06": ("oi5 <= -0.10 AND abs(ret5) < 0.02", None),
    "d07": ("ret5 > 0.04 AND oi5 <= -0.08", "ret5 > 0.04 AND oi5 >= 0.08"), "d08": ("dpspk AND oi5 >= 0.10 AND abs(ret5) < 0.03", "oi5 >= 0.10 AND abs(ret5) < 0.03 AND NOT dpspk"),
}
# Factors of a ranking by technical features alone.
TECHNICAL = ("vs_ema200", "vs_ema50", "ema_stack", "ema200_slope", "above_200_days", "ret_3m", "ret_6m", "mom_12_1", "sharpe_6m", "pos_52", "structure", "dist_hi60", "eff_ratio_60", "turnover_20", "updown_vol_20", "vol_ratio_20_50")


def names() -> list[str]:
    """The factors in order."""
    return [row.split("'")[1] for row in FACTORS.replace("\n", " ").split("), (")]


def composite(mode: str, weights: dict[str, float] | None = None) -> str:
    """Score and coverage of a mode; ``weights`` by pillar for other ones."""
    w = {f"p_{p}": v for p, v in weights.items()} if weights else SCORES[mode]
    total = float(sum(w.values()))
    bare = lambda side: side.removeprefix("100 - ")
    score = " + ".join(f"{v} * coalesce({side}, 50.0)" for side, v in w.items())
    cover = " + ".join(f"CASE WHEN {bare(side)} IS NOT NULL THEN {v}.0 ELSE 0 END" for side, v in w.items())
    return f"({score}) / {total} AS score_{mode}, ({cover}) / {total} AS cov_{mode}"


def gates(mode: str) -> str:
    cases = ", ".join(f"CASE WHEN {failed} THEN '{label}' END" for failed, label in GATES[mode])
    return f"concat_ws(';', {cases}) AS gates_{mode}"


def pillars() -> str:
    """Means and coverage of ranked factors, as aggregates."""
    held = lambda p: f"count(CASE WHEN pillar = '{p}' THEN 1 END) / {PILLARS[p]}.0"
    return ", ".join(f"CASE WHEN {held(p)} >= 0.5 THEN avg(CASE WHEN pillar = '{p}' THEN p END) END AS p_{p}, {held(p)} AS cov_{p}" for p in PILLARS)
