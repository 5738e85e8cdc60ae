"""Backtests by the full model: what they write, rank and leave behind."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tapewright.functions import stored as st
from tapewright.operators import ranking, scoring
from tapewright.operators import statements as S
from tapewright.plans import backtests, desks
from tapewright.sources import panels

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DAY = datetime.date(2000, 1, 1)


def folders(spark):
    at = st.shared_folder(spark).removeprefix("file://")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize("rows_of_a_range", [7, 50, 65_536])
def test_cells_are_ranked_as_in_a_sorted_list(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows_of_a_range)
    rng = random.Random(2)
    rows = [(DAY + datetime.timedelta(d), f"S{i}", rng.choice("abc") if i % 9 else None, rng.gauss(0, 1) if i % 7 else None, float(rng.randrange(3))) for d in range(2) for i in range(200)]
    wide = spark.createDataFrame(rows, "day date, symbol string, g string, x double, y double")
    got = {(r["day"], r["symbol"], r["code"]): (r["lt"], r["le"], r["total"]) for r in ranking.ranked_cells(wide, ["day"], "symbol", ["x", "y"], ("g", ["y"]), 200).collect()}
    want = {}
    for code, (at, inside) in enumerate([(3, False), (4, False), (4, True)]):
        for r in rows:
            if r[at] is not None and (r[2] is not None or not inside):
                own = [o[at] for o in rows if o[0] == r[0] and o[at] is not None and (not inside or o[2] == r[2])]
                want[(r[0], r[1], code)] = (sum(v < r[at] for v in own), sum(v <= r[at] for v in own), len(own))
    assert got == want


@pytest.mark.parametrize("rows_of_a_range", [30, 65_536])
def test_pillars_of_days_are_those_of_the_long_form(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows_of_a_range)
    rng, by = random.Random(3), ["cohort"]
    value = lambda j: None if rng.random() < 0.1 else rng.choice([0.0, 1.0, 2.0]) if j % 4 == 0 else rng.gauss(0, 1)
    rows = [(DAY + datetime.timedelta(d), f"S{i}", None if i % 31 == 0 else "ab"[i % 2] if i % 50 else "rare", None if i % 17 == 0 else i % 3 == 0, *map(value, range(len(scoring.FACTORS)))) for d in range(2) for i in range(120)]
    d = spark.createDataFrame(rows, "cohort date, symbol string, sector string, lender boolean, " + ", ".join(f"{k} double" for k in scoring.FACTORS))
    want = scoring.pillars(scoring.percentiles(scoring.winsorise(scoring.long_form(d, by), by), by), by)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect())
    assert shown(scoring.pillars_of_days(d, by, 120)) == shown(want)


def test_values_travel_twice_to_be_ranked(spark):
    d = spark.createDataFrame([(DAY, f"S{i}", "a", False, *[float(i)] * len(scoring.FACTORS)) for i in range(9)], "cohort date, symbol string, sector string, lender boolean, " + ", ".join(f"{k} double" for k in scoring.FACTORS))
    plan = scoring.pillars_of_days(d, ["cohort"], 9)._jdf.queryExecution().sparkPlan().toString()
    executed = scoring.pillars_of_days(d, ["cohort"], 9)
    executed.collect()
    final = executed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 2 and "factor" not in plan


def test_what_is_stored_within_goes_at_the_end(spark):
    before = folders(spark)
    with st.scratch(spark):
        with st.scratch(spark):
            st.stored(spark.range(3))
            inner = st.stored(spark.range(4), 1)
            last = st.stored(spark.range(5), 2)
        assert inner.count() == 4 and len(folders(spark) - before) == 2
    assert len(folders(spark) - before) == 1 and last.count() == 5


def test_parts_hold_whole_days(spark):
    held = spark.createDataFrame([(DAY + datetime.timedelta(d),) for d, n in enumerate((3, 2, 9, 1)) for _ in range(n)], "cohort date")
    days = [DAY + datetime.timedelta(d) for d in range(4)]
    assert backtests.parts(held, days, 5) == [days[:2], days[2:3], days[3:]]


@data
def test_histories_cut_at_a_day_are_statements_cut_at_it(spark):
    annual, quarterly, companies = (panels.periods(spark, SF, False), panels.periods(spark, SF, True), panels.companies(spark, SF))
    days = spark.createDataFrame([(datetime.date(1996, 1, 2),), (datetime.date(1999, 8, 20),), (datetime.date(2000, 4, 3),)], "cohort date")
    prices = companies.select("symbol").crossJoin(days).withColumn("price", F.lit(100.0))
    known = lambda df, lag: df.join(F.broadcast(days), F.col("period_end") <= F.date_sub("cohort", lag))
    want = S.fundamentals(known(annual, S.ANNUAL_LAG), known(quarterly, S.QUARTER_LAG), companies, prices, ("cohort",))
    got = S.known_on(S.histories(annual, quarterly, companies), prices, "cohort")
    asked = ["cohort", "symbol", "fy_latest", "q_latest", "n_q", "n_fy", "ttm_from_q", *[k for k, f in scoring.FACTORS.items() if f[1] in ("quality", "growth", "balance", "cash", "valuation")]]
    shown = lambda df: sorted(map(repr, (tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(asked).collect())))
    assert shown(got) == shown(want) != []


@data
def test_scores_by_parts_are_those_of_all_days_and_little_is_left(spark, monkeypatch):
    days = {"all": desks.DAYS[:3]}
    shown = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.select("cohort", "symbol", "score_longterm", "score_swing_short").collect())
    whole = shown(backtests.scored(spark, SF, days, ["score_longterm", "score_swing_short"])[0])
    monkeypatch.setattr(backtests, "AT_ONCE", 1)
    before = folders(spark)
    assert shown(backtests.scored(spark, SF, days, ["score_longterm", "score_swing_short"])[0]) == whole != []
    # cohorts of the run, all pairs, the index, its returns, and a table a cohort
    assert len(folders(spark) - before) == 4 + len({r[0] for r in whole})
