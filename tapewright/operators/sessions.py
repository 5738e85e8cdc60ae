"""Features on the global session calendar: a session on which a symbol has no bar still counts as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, yes
from .sliding import sorted_rank

def by_session():
    """A symbol's sessions in order."""
    return Window.partitionBy("symbol").orderBy("session_no")


def number_sessions(panel: DataFrame) -> DataFrame:
    """Adds session_no, the date's place in the union of all dates. The calendar is one row a date, so it joins by broadcast."""
    days = panel.select("date").distinct()
    calendar = days.withColumn("session_no", F.row_number().over(Window.orderBy("date")))
    return panel.join(F.broadcast(calendar), "date")


def onto_cash(cash: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Another market's columns on the cash market's calendar: rows of symbol and date that either has, of the cash market's days and symbols alone.

    Of rows that repeat a symbol and date the mean counts. A day on which a symbol has no bar still has the other
    market's values, so that changes over sessions find them. Days and symbols are far fewer than rows.
    """
    one = other.groupBy("symbol", "date").agg(*[F.avg(c).alias(c) for c in columns])
    held = one.join(cash.select("date").distinct(), "date", "left_semi").join(cash.select("symbol").distinct(), "symbol", "left_semi")
    return cash.join(held, ["symbol", "date"], "full")


def frame(a: int, b: int):
    return by_session().rangeBetween(a, b)


def shift(x: Column | str, k: int) -> Column:
    """The value k sessions back (ahead, if negative); null where the symbol has no bar there."""
    return F.max(x).over(frame(-k, -k))


def change(x: str, k: int) -> Column:
    return ratio(F.col(x), shift(x, k)) - 1


def rolling(f, x: Column | str, k: int, least: int | None = None, skip: int = 0) -> Column:
    """f over the last k sessions (``skip`` of the newest left out), null where fewer than ``least`` (all, by default) have a value."""
    w = frame(-(k + skip - 1), -skip)
    return F.when(F.count(x).over(w) >= (k if least is None else least), f(x).over(w))


def gap_aware_mean(panel: DataFrame, x: str, alpha: float, least: int, name: str) -> DataFrame:
    """Adds an exponential mean whose weights fade over sessions without a bar, too: y' = (d y + a x) / (d + a), d = (1-a)^gap.

    Each step is y' = p y + q, with p and q known from the gap and the value, so y is a running sum of q over the running
    product of p, times that product: two windows of one order. All terms are positive. Null before ``least`` values.
    """
    run = Window.partitionBy("symbol").orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(F.when(F.col(x).isNotNull(), F.col("session_no")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    has, d = F.col(x).isNotNull(), F.pow(F.lit(1 - alpha), F.col("session_no") - F.col("_before"))
    out = panel.withColumn("_before", before)
    out = out.withColumn("_q", F.when(has & F.col("_before").isNull(), F.col(x)).when(has, alpha * F.col(x) / (d + alpha)))
    out = out.withColumn("_s", F.sum(F.when(has & F.col("_before").isNotNull(), F.log(d / (d + alpha))).otherwise(0.0)).over(run))
    mean = F.exp("_s") * F.sum(F.col("_q") * F.exp(-F.col("_s"))).over(run)
    return out.withColumn(name, F.when(has & (F.count(x).over(run) >= least), mean)).drop("_before", "_q", "_s")


# How pseudo-symbols of indices begin, and which of them is the benchmark, the best first.
INDICES, BENCHMARKS = ("NIFTY", "BANKNIFTY", "^"), ("NIFTY500", "NIFTY50")


def is_index(symbol: Column) -> Column:
    """Whether a symbol stands for an index."""
    return reduce(lambda a, b: a | b, (symbol.startswith(p) for p in INDICES))


def benchmark(prices: DataFrame, choice: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """date, bench: the closes of the first of ``choice`` that has any, on every session of the stocks; a session without one has the last before it.

    One row a session, so a single window orders them.
    """
    rank = F.array_position(F.array(*map(F.lit, choice)), F.col("symbol"))
    indices = prices.where(F.col("symbol").isin(*choice)).withColumn("r", rank)
    best = indices.agg(F.min("r").alias("r"))
    chosen = indices.join(F.broadcast(best), "r").groupBy("date").agg(F.first("close").alias("close"))
    days = prices.where(~is_index(F.col("symbol"))).select("date").distinct()
    filled = F.last("close", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(chosen, "date", "left").select("date", filled.alias("bench"))


HORIZONS = (5, 10, 20, 40)


def excess(df: DataFrame, elig: str, mask: bool, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """fwd<h>: return over the next h sessions; xs<h>: what it exceeds the same session's mean over eligible symbols by.

    With ``mask`` only eligible symbols have either.
    """
    df = df.withColumns({f"fwd{h}": F.when(F.col(elig) | F.lit(not mask), ratio(shift("close", -h), F.col("close")) - 1) for h in horizons})
    same_day = Window.partitionBy("session_no")
    return df.withColumns({f"xs{h}": F.col(f"fwd{h}") - F.avg(F.when(F.col(elig), F.col(f"fwd{h}"))).over(same_day) for h in horizons})


def price_features(panel: DataFrame, bench: DataFrame, sectors: DataFrame, min_turnover: float) -> DataFrame:
    """Features of the price and volume lab. ``panel``: symbol, date, OHLC, volume; ``sectors``: symbol, sector."""
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    d = number_sessions(panel).withColumns({"ma20": rolling(F.avg, "close", 20), "sd20": rolling(F.stddev_samp, "close", 20)})
    d = sorted_rank(d.withColumn("bbw", 4 * F.col("sd20") / F.col("ma20")), "bbw", 252, 60, "bbw_pctl")
    d = gap_aware_mean(d, "close", 2 / 201, 200, "e200")
    d = d.join(F.broadcast(bench), "date", "left").join(sectors, "symbol", "left")
    d = d.withColumns({
        **{f"ret{k}": change("close", k) for k in (1, 3, 5, 10, 20, 60, 120, 250)}, "vs200": c / F.col("e200") - 1, "range": h - low, "c1": shift("close", 1), "turn": c * v / 1e7,
        "v5": rolling(F.avg, "volume", 5), "v50": rolling(F.avg, "volume", 50), "hi20": rolling(F.max, "high", 20), "lo20": rolling(F.min, "low", 20), "hi252": rolling(F.max, "high", 252), "lo252": rolling(F.min, "low", 252),
        "bars_ok": F.count("close").over(frame(-259, 0)) >= 250, "rsline": c / F.col("bench"), "bench20": ratio(F.col("bench"), shift("bench", 20)) - 1,
    })
    d = d.withColumns({
        "vr5": F.col("v5") / F.col("v50"), "vr1": v / F.col("v50"), "turn20": rolling(F.avg, "turn", 20), "pos52": (c - F.col("lo252")) / (F.col("hi252") - F.col("lo252") + 1e-9),
        "nr7": F.col("range") <= rolling(F.min, "range", 7) + 1e-12, "down3": yes(F.sum((F.col("ret1") < 0).cast("int")).over(frame(-2, 0)) == 3), "gap": F.col("open") / F.col("c1") - 1,
        "rs20": F.col("ret20") - F.col("bench20"), "rs_hi60": yes(F.col("rsline") >= rolling(F.max, "rsline", 60) - 1e-12),
        "p_hi": shift("hi252", 1), "hi20p": shift("hi20", 1), "lo20p": shift("lo20", 1), "h1": shift("high", 1), "l1": shift("low", 1),
    })
    d = d.withColumns({
        "bo52": yes((c > F.col("p_hi")) & (F.col("c1") <= shift("p_hi", 1))), "bo20": yes(c > F.col("hi20p")), "nr7p": yes(shift("nr7", 1)),
        "elig": yes((F.col("turn20") >= min_turnover) & F.col("ret250").isNotNull()), "sec20": F.percentile("ret20", F.lit(0.5)).over(Window.partitionBy("session_no", "sector")),
    })
    return d.withColumn("tight", yes(shift("bbw_pctl", 1) < 0.2))


def flow_features(panel: DataFrame, min_turnover: float) -> DataFrame:
    """Features of the delivery and open-interest lab. ``panel``: symbol, date, close, qty, deliv_per, oi; of duplicates the mean counts."""
    one = panel.groupBy("symbol", "date").agg(*[F.avg(x).alias(x) for x in ("close", "qty", "deliv_per", "oi")])
    d = number_sessions(one).withColumn("turn", F.col("close") * F.col("qty") / 1e7)
    d = d.withColumns({
        "turn20": rolling(F.avg, "turn", 20, 10), "ret5": change("close", 5), "vr5": rolling(F.avg, "qty", 5) / rolling(F.avg, "qty", 50, 30, 5), "oi5": change("oi", 5),
        "dpmed": F.when(F.count("deliv_per").over(frame(-60, -1)) >= 30, F.percentile("deliv_per", F.lit(0.5)).over(frame(-60, -1))), "full60": F.count("close").over(frame(-59, 0)) >= 60,
    })
    return d.withColumns({"elig": yes((F.col("turn20") >= min_turnover) & F.col("full60")), "dpspk": yes((F.col("deliv_per") >= 1.5 * F.col("dpmed")) & (F.col("deliv_per") >= 50))})
