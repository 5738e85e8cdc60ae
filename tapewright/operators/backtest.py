"""Cohort backtests: as-of features and returns, ranked portfolios, deciles, rank correlation, summaries."""

from __future__ import annotations

import datetime
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank


def nominal_days(start: Column, end: Column, kind: str) -> Column:
    """The nominal cohort days from start to end: ``MS`` and ``QS`` first days of months and quarters, ``2W-MON`` every other Monday, ``AS-JUL`` the firsts of July."""
    if kind == "2W-MON":
        first = F.date_sub(F.next_day(start, "MON"), F.when(F.weekday(start) == 0, 7).otherwise(0))
        return F.filter(F.sequence(first, F.greatest(end, first), F.expr("INTERVAL 14 DAYS")), lambda d: d <= end)
    unit, step = {"MS": ("month", 1), "QS": ("quarter", 3), "AS-JUL": ("year", 12)}[kind]
    first = F.add_months(F.trunc(start, unit), 6 if kind == "AS-JUL" else 0)
    days = F.sequence(F.add_months(first, -step), F.greatest(end, first), F.expr(f"INTERVAL {step} MONTHS"))
    return F.filter(days, lambda d: (d >= start) & (d <= end))


def cohorts(bars: DataFrame, days: list[str]) -> DataFrame:
    """cohort, exit: for each nominal day the first session at or after it, clamped to the last session, with the next one's.

    One row a nominal day, so it can be broadcast.
    """
    nominal = bars.sparkSession.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
    sessions = bars.select("date").distinct()
    last = bars.agg(F.max("date")).scalar()
    found = sessions.join(F.broadcast(nominal), F.col("date") >= F.col("day")).groupBy("day").agg(F.min("date").alias("date"))
    dates = nominal.join(found, "day", "left").select(F.coalesce(F.col("date"), last).alias("cohort")).distinct()
    return dates.withColumn("exit", F.lead("cohort").over(Window.orderBy("cohort"))).where("exit is not null")


def as_of(panel: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """Each symbol's newest row at or before each of ``days``, dates.

    A row holds from its date until the symbol's next one. How many of the days come before a date is read off an array
    with a place for every date between the first and last of them, as long as the calendar; so a row knows its first and
    last day, and gives itself for each: linear in rows and results, in the order that is there. Days are few and known
    before the rows are read, so both arrays are constants of the plan and travel with no row.
    """
    listed = [x[0] for x in days.select(day).distinct().orderBy(day).collect()]  # one row a day
    if not listed:
        return panel.join(days, F.lit(False))
    low, high = listed[0], listed[-1]
    places = [bisect_left(listed, low + datetime.timedelta(k)) for k in range((high - low).days + 1)]
    constant = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    earlier = lambda c: F.when(c <= F.lit(low), 0).when(c <= F.lit(high), F.get(constant(places, "int"), F.datediff(c, F.lit(low)))).otherwise(len(listed))
    until = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    spans = panel.withColumns({"_first": earlier(F.col("date")), "_last": earlier(until)}).where("_first < _last")
    which = F.explode(F.sequence(F.col("_first"), F.col("_last") - 1))
    held = spans.withColumn("_day", which).withColumn(day, F.get(constant(listed, "date"), F.col("_day"))).drop("_first", "_last", "_day")
    return held if days.columns == [day] else held.join(F.broadcast(days), day)  # one row a day


def forward_returns(closes: DataFrame, pairs: DataFrame) -> DataFrame:
    """symbol, cohort, exit, entry_px, exit_px, fwd from the newest closes at both days."""
    entry = as_of(closes, pairs.select("cohort", "exit"), "cohort").select("symbol", "cohort", "exit", F.col("close").alias("entry_px"))
    leave = as_of(closes, pairs.select("exit").distinct(), "exit").select("symbol", "exit", F.col("close").alias("exit_px"))
    return entry.join(leave, ["symbol", "exit"]).withColumn("fwd", F.when((F.col("entry_px") != 0) & (F.col("exit_px") != 0), F.col("exit_px") / F.col("entry_px") - 1))


def eligible(scored: DataFrame, mode: str, min_cov: float, least: int = 30, more: Column | None = None) -> DataFrame:
    """cohort, exit, symbol, sector, score, fwd, n_elig of rows that pass all gates; cohorts of fewer than ``least`` are left out."""
    ok = (F.size(f"gates_{mode}") == 0) & (F.col(f"cov_{mode}") >= min_cov) & F.col("fwd").isNotNull() & F.col(f"score_{mode}").isNotNull()
    d = scored.where(ok if more is None else ok & more).withColumn("score", F.round(f"score_{mode}", 9))
    return d.withColumn("n_elig", F.count(F.lit(1)).over(Window.partitionBy("cohort"))).where(F.col("n_elig") >= least)


def ranked(elig: DataFrame) -> DataFrame:
    """Adds places from both ends and the decile by score; ties by symbol."""
    up = F.row_number().over(Window.partitionBy("cohort").orderBy("score", F.desc("symbol")))
    d = elig.withColumn("up", up).withColumn("down", F.col("n_elig") - F.col("up") + 1)
    decile = F.greatest(F.lit(1), F.ceil((F.col("up") - 1) * 10 / (F.col("n_elig") - 1) - 1e-9).cast("int"))
    return d.withColumn("decile", decile)


def portfolios(ranks: DataFrame, bench: DataFrame, top: int = 10, sign: int = 1, cost: float = 0.003) -> DataFrame:
    """A row a cohort: mean returns of the best and worst ``top``, of all eligible and of the benchmark, hit rates, rank correlation (to 12 digits, so that none at all is 0, of neither sign), decile spread."""
    s = F.lit(float(sign))
    d = ranks.join(F.broadcast(bench.select("cohort", F.coalesce("fwd", F.lit(0.0)).alias("b"))), "cohort", "left")
    d = d.withColumn("rs", average_rank("score", ["cohort"])).withColumn("rf", average_rank("fwd", ["cohort"], F.round("fwd", 12)))
    best, worst = F.col("down") <= top, F.col("up") <= top
    mean = lambda c, x: F.avg(F.when(c, x))
    out = d.groupBy("cohort", "exit").agg(
        F.max("n_elig").alias("n_elig"), (s * mean(best, F.col("fwd")) - cost).alias("top"), (s * mean(worst, F.col("fwd")) - cost).alias("bottom"), (s * F.avg("fwd")).alias("universe"), (s * F.max("b")).alias("bench"),
        mean(best, (s * F.col("fwd") > 0).cast("double")).alias("hit"), mean(best, (s * F.col("fwd") > s * F.col("b")).cast("double")).alias("beat_bench"), F.round(F.corr("rs", "rf"), 12).alias("ic"),
        mean(F.col("decile") == 10, F.col("fwd")).alias("top_decile"), mean(F.col("decile") == 1, F.col("fwd")).alias("bottom_decile"),
    )
    return out.withColumn("spread", F.coalesce("top_decile", F.lit(0.0)) - F.coalesce("bottom_decile", F.lit(0.0)))


def deciles(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("cohort", "decile").agg(F.avg("fwd").alias("mean_fwd"), F.count("*").alias("n"))


def picks(ranks: DataFrame, bench: DataFrame, top: int = 10) -> DataFrame:
    """The ledger of what was bought: entry, exit and return of each of the best ``top``."""
    b = F.broadcast(bench.select("cohort", F.round("fwd", 4).alias("bench")))
    return ranks.where(F.col("down") <= top).join(b, "cohort", "left").select("cohort", "symbol", "sector", F.round("score", 1).alias("score"), F.round("entry_px", 4).alias("entry"), F.round("exit_px", 4).alias("exit_px"), F.round("fwd", 4).alias("ret"), "bench")


def summary(rows: DataFrame, per_year: float) -> DataFrame:
    """One row: of each portfolio its compounded return, annual rate, mean, median, deepest drawdown and share of winning periods; excess, hits, rank correlation, spread."""
    names = ["top", "bottom", "universe", "bench"]
    path = Window.orderBy("cohort").rowsBetween(Window.unboundedPreceding, 0)  # one row a cohort
    d = rows.withColumns({f"eq_{c}": F.exp(F.sum(F.log1p(c)).over(path)) for c in names})
    d = d.withColumns({f"dd_{c}": F.col(f"eq_{c}") / F.max(f"eq_{c}").over(path) - 1 for c in names})
    chain = lambda c: F.exp(F.sum(F.log1p(c))) - 1
    years = F.count(F.lit(1)) / per_year
    each = [
        e
        for c in names
        for e in (
            chain(c).alias(f"{c}_total"), (F.pow(1 + chain(c), F.try_divide(F.lit(1.0), years)) - 1).alias(f"{c}_cagr"), F.avg(c).alias(f"{c}_avg"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.min(f"dd_{c}").alias(f"{c}_max_dd"), F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_pos"),
        )
    ]
    over = lambda c: F.col("top") - F.col(c)
    share = lambda x: F.avg((x > 0).cast("double"))
    return d.agg(
        F.count("*").alias("cohorts"), F.min("cohort").alias("first"), F.max("exit").alias("last_exit"), *each, F.avg(over("universe")).alias("excess_universe"), share(over("universe")).alias("excess_universe_pos"), F.avg(over("bench")).alias("excess_bench"), share(over("bench")).alias("excess_bench_pos"),
        F.avg("hit").alias("hit_rate"), F.avg("beat_bench").alias("beat_rate"), F.avg("ic").alias("ic_mean"), share(F.col("ic")).alias("ic_pos"), F.avg("spread").alias("spread_avg"), share(F.col("spread")).alias("spread_pos"), F.avg(over("bottom")).alias("top_minus_bottom"),
    )
