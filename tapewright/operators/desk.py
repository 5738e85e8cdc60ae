"""The desk's cross-sections: sectors, breadth, swing tiers, move quality, movers and the track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import yes
from .ranking import at_place, tie_ranks


#: Fixed value: the place of symbols that pass and have no score.
SCORED = 9999


def median(c) -> F.Column:
    return F.percentile(c, F.lit(0.5))


def sectors(features: DataFrame) -> DataFrame:
    """Per sector: members, medians, share above the 200-bar mean."""
    cols = ["ret_1m", "ret_3m", "ret_6m", "vs_ema200", "pe", "sales_g3", "roce"]
    return features.groupBy("sector").agg(F.count("*").alias("n"), *[F.round(median(F.col(c)), 4).alias(c) for c in cols], F.round(F.avg((F.col("vs_ema200") > 0).cast("double")), 2).alias("pct_above_200"))


def breadth(features: DataFrame, least: int = 200) -> DataFrame:
    """One row over symbols of ``least`` bars: shares above their means, new highs and lows, stacks."""
    d = features.where(F.col("bars") >= least)
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    share = lambda c: F.round(F.count_if(c) / n, 3)
    return d.agg(
        F.count("*").alias("n"), *[share(F.col(f"vs_ema{k}") > 0).alias(f"above_{k}") for k in (200, 50, 20)], F.count_if(F.col("from_52h") > -0.01).alias("new_52w_high"), F.count_if(F.col("from_52l") < 0.01).alias("new_52w_low"),
        F.round(median(F.col("ret_1m")), 4).alias("median_ret_1m"), share(F.col("ema_stack") == 1).alias("bull_stack"), share(F.col("ema_stack") == -1).alias("bear_stack"),
    )


def swing(features: DataFrame, min_ret: float = 0.35, min_turnover: float = 2.0) -> DataFrame:
    """symbol, tier, hot, state of the strongest quarter by 6-month return among liquid symbols in an uptrend; none if fewer than four qualify.

    Cuts are the returns at fixed places of the ranking, and ties with a cut are in. Returns are ranked by ranges.
    """
    d = features.where(yes((F.col("ret_6m") >= min_ret) & F.col("above_sma200") & (F.col("turnover_20") >= min_turnover))).withColumn("ret_6m", F.round("ret_6m", 9))
    at = lambda share: F.greatest(F.lit(0), F.floor(F.col("total") * share) - 1)
    ranks = tie_ranks(d, "ret_6m", [])
    cuts = ranks.agg(F.struct(F.max("total").alias("n"), at_place(ranks, "ret_6m", at(0.25)).alias("in"), at_place(ranks, "ret_6m", at(0.125)).alias("top")).alias("x")).scalar()
    d = d.withColumn("_cut", cuts).where((F.col("_cut.n") >= 4) & (F.col("ret_6m") >= F.col("_cut.in")))
    hot = yes(F.col("atr_pct") > 0.055)
    fires = yes(~hot & (F.col("price") >= F.col("prev_high") + 0.5 * F.col("atr")) & (F.col("vol_x50") >= 1.5))
    return d.select("symbol", F.when(F.col("ret_6m") >= F.col("_cut.top"), "A").otherwise("B").alias("tier"), hot.alias("hot"), F.when(fires, "TRIGGER").otherwise("WATCH").alias("state"))


def move_quality(flow: DataFrame) -> DataFrame:
    """symbol and the kind of its newest move, from ``sessions.flow_features`` at the last session."""
    last = flow.agg(F.max("session_no").alias("last"))
    d = flow.join(F.broadcast(last), F.col("session_no") == F.col("last")).where("deliv_per is not null")
    dp, med, r5, oi = (F.col(x) for x in ("deliv_per", "dpmed", "ret5", "oi5"))
    spike = yes((dp >= 1.5 * med) & (dp >= 50))
    rally = yes(r5 > 0.04)
    st = (
        F.when(yes(spike & (oi >= 0.10) & (F.abs(r5) < 0.05)), "accumulating").when(rally & yes(dp <= 0.5 * med), "hollow").when(rally & yes(oi <= -0.08), "covering").when(rally & (yes(oi > 0.02) | spike | yes((med != 0) & (dp >= 1.2 * med))), "backed")
    )
    return d.select("symbol", st.alias("st"), F.round(dp, 1).alias("dp"), F.round(med, 1).alias("dp_med"), F.round(oi, 3).alias("oi5"), F.round(r5, 3).alias("ret5"), F.round("vr5", 2).alias("vr5"))


def trifecta(quality: DataFrame, feed_day: Column, asof: Column, days: int = 7) -> DataFrame:
    """symbol: those that accumulate, from ``move_quality``, if the feed's day is within ``days`` of the run's; else none."""
    return quality.where((F.col("st") == "accumulating") & (F.abs(F.datediff(feed_day, asof)) <= days)).select("symbol")


def snapshots(history: DataFrame) -> DataFrame:
    """Adds ``back``: 0 for the newest run, 1 for the one before, and so on. ``history``: asof, symbol, sector, price, score, passes."""
    runs = history.select("asof").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("asof"))) - 1)  # one row a run
    return history.join(F.broadcast(runs), "asof")


def retained(history: DataFrame, runs: int = 90) -> DataFrame:
    """The newest run and the ``runs`` before it."""
    return snapshots(history).where(F.col("back") <= runs).drop("back")


def deltas(history: DataFrame) -> DataFrame:
    """symbol, d1, d5: the score's change since the last run and since five runs ago (the oldest, if there are fewer)."""
    h = snapshots(history)
    oldest = h.where("back > 0").agg(F.least(F.lit(5), F.max("back")).alias("far"))
    now = h.where("back = 0").select("symbol", "score")
    one = h.where("back = 1").select("symbol", F.col("score").alias("s1"))
    five = h.join(F.broadcast(oldest), F.col("back") == F.col("far")).select("symbol", F.col("score").alias("s5"))
    return now.join(one, "symbol", "left").join(five, "symbol", "left").select("symbol", F.round(F.col("score") - F.col("s1"), 1).alias("d1"), F.round(F.col("score") - F.col("s5"), 1).alias("d5"))


def movers(history: DataFrame, top: int = 50, moved: int = 10, shown: int = 15) -> DataFrame:
    """kind, place, symbol, d: who entered or left the best ``top``, gained or lost most, newly passes or fails, since the last run.

    One reading of the history: a row a symbol, which names the lists that it might stand in, and the places there.
    """
    h = snapshots(history).where("back < 2")
    one = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    both = h.groupBy("symbol").agg(*[one(c, k).alias(f"{c}{k}") for c in ("score", "passes") for k in (0, 1)])
    pass0, pass1 = yes(F.col("passes0")), yes(F.col("passes1"))
    change = F.round(F.col("score0") - F.col("score1"), 9)
    inside = lambda c, kind, *order: F.when(c, F.struct(F.lit(kind).alias("kind"), *[o.cast("double").alias(f"o{i}") for i, o in enumerate(order)]))
    # a symbol stands in each list that it might be in, by the order of that list; each task passes on no more than a list holds
    lists = [
        inside(pass0 & F.col("score0").isNotNull(), "now", -F.col("score0")), inside(pass1, "before", -F.col("score1")), inside(change.isNotNull(), "gainer", -change), inside(change.isNotNull(), "loser", change),
        inside(pass0 & ~pass1 & F.col("score0").isNotNull(), "passes", -F.col("score0")), inside(pass0 & ~pass1 & F.col("score0").isNull(), "unscored", F.lit(0)), inside(pass1 & ~pass0, "newly_fail", F.lit(0)),
    ]
    each = both.select("symbol", change.alias("d"), F.explode(F.array_compact(F.array(*lists))).alias("x")).select("symbol", "d", "x.*")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("o0").asc_nulls_last(), "symbol"))
    ranked = each.withColumn("r", place).where(F.col("r") <= SCORED)
    kinds = ("now", "before", "gainer", "loser", "passes", "unscored", "newly_fail")
    r = ranked.groupBy("symbol").agg(F.max("d").alias("d"), F.max(F.when(F.col("kind") == "passes", F.col("o0"))).alias("o0"), *[F.max(F.when(F.col("kind") == k, F.col("r"))).alias(k) for k in kinds])
    up_to = lambda k, most: yes(F.col(k) <= most)
    # a passing symbol without a score stands where the last scored place would be
    late = F.when(F.col("unscored").isNotNull(), F.lit(SCORED)).otherwise(F.coalesce("now", F.lit(SCORED + 1)))
    shown_in = [
        inside(up_to("now", top) & ~up_to("before", top), "new_top", F.col("now")), inside(up_to("before", top) & ~up_to("now", top), "left_top", F.lit(0)),
        inside(up_to("gainer", moved), "gainer", F.col("gainer")), inside(up_to("loser", moved), "loser", F.col("loser")),
        inside(up_to("passes", shown) | up_to("unscored", shown), "newly_pass", late), inside(up_to("newly_fail", shown), "newly_fail", F.lit(0)),
    ]
    out = r.select("symbol", "d", F.when(late > SCORED, F.col("o0")).alias("then"), F.explode(F.array_compact(F.array(*shown_in))).alias("x")).select("symbol", "d", "then", "x.*")
    moves, late_pass = F.col("kind").isin("gainer", "loser"), F.when(F.col("kind") == "newly_pass", F.col("then"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("o0", late_pass, "symbol"))).where(F.col("place") <= F.when(moves, moved).otherwise(shown))
    return out.select("kind", "place", "symbol", F.when(moves, F.round("d", 1)).alias("d"))


def track_record(history: DataFrame, top: int = 10, least: int = 20, sign: int = 1) -> DataFrame:
    """A row a past run: its best ``top`` and all that passed, marked to the newest prices. Runs with fewer than ``least`` are left out."""
    h = snapshots(history)
    now = h.where("back = 0").select("symbol", F.col("price").alias("p1"), F.col("asof").alias("today"))
    past = h.where("back > 0 and passes and score is not null and price is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("asof"))).where(F.col("n") >= least)
    d = past.withColumn("r", F.row_number().over(Window.partitionBy("asof").orderBy(F.desc("score"), "symbol"))).join(now, "symbol", "left")
    ret = F.when((F.col("price") != 0) & (F.col("p1") != 0), sign * (F.col("p1") / F.col("price") - 1))
    d = d.withColumn("ret", ret)
    best = lambda x: F.avg(F.when(F.col("r") <= top, x))
    return d.groupBy("asof").agg(F.datediff(F.max("today"), "asof").alias("days"), F.round(best(F.col("ret")), 4).alias("top"), F.round(F.avg("ret"), 4).alias("universe"), F.round(best((F.col("ret") > 0).cast("double")), 2).alias("hit")).where("top is not null and universe is not null")
