"""The precursor radar: repaired prices, volume regime, distance from highs, and a rule score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, labels, yes
from .sessions import by_session, frame, number_sessions, shift


def repair(panel: DataFrame) -> DataFrame:
    """Panel with session_no, ``event`` (ratio of an unadjusted split or bonus, else null) and ``adj`` (close scaled by all later events).

    A fall to 0.72 or less from one session to the next is an event unless the price is back to 1.35 times that within
    five sessions; it needs a later bar to tell.
    """
    d = panel if "session_no" in panel.columns else number_sessions(panel)
    r = F.col("close") / shift("close", 1)
    after = F.max("close").over(frame(1, 5))
    d = d.withColumn("event", F.when((r <= 0.72) & (after / F.col("close") < 1.35), r))
    later = by_session().rowsBetween(1, Window.unboundedFollowing)
    return d.withColumn("adj", F.col("close") * F.coalesce(F.product(F.coalesce("event", F.lit(1.0))).over(later), F.lit(1.0)))


def measures(panel: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A row a symbol at the last global session. ``panel``: symbol, date, close, volume; ``prior``: symbol, ath, asof of an earlier bundle.

    Conditional aggregates over session numbers, as a symbol need not have a bar at the last session.
    """
    d = repair(panel).withColumn("turn", F.col("close") * F.col("volume"))
    d = d.withColumn("last", panel.agg(F.count_distinct("date")).scalar())
    s = F.col("session_no")
    recent = lambda x, k: F.when(s > F.col("last") - k, F.col(x))
    mean = lambda k, least: F.when(F.count(recent("turn", k)) >= least, F.avg(recent("turn", k)))
    ago = lambda k: F.max_by("adj", F.when(s <= F.col("last") - k + 1, s))
    out = d.groupBy("symbol").agg(
        F.max_by("adj", "session_no").alias("price"), (mean(20, 10) / 1e5).alias("turn20"), (mean(63, 40) / mean(252, 150)).alias("volreg"), F.max("adj").alias("ath"), F.count("close").alias("bars"), F.max("last").alias("last"),
        *[ago(k).alias(f"p{k}") for k in (63, 126, 252)], F.collect_list(F.when(F.col("event").isNotNull(), F.struct("date", "event"))).alias("events"),
    )
    if prior is not None:
        scaled = F.aggregate(F.filter("events", lambda e: F.coalesce(e["date"] > F.col("asof"), F.lit(True))), F.col("old"), lambda acc, e: acc * e["event"])
        out = out.join(prior.select("symbol", F.col("ath").alias("old"), "asof"), "symbol", "left").withColumn("ath", F.greatest("ath", scaled)).withColumn("bars", F.lit(300).cast("long")).drop("old", "asof")
    over = lambda k: F.when(F.col("last") > k, F.col("price") / F.col(f"p{k}") - 1)
    return out.select("symbol", "price", "turn20", "volreg", "ath", "bars", over(63).alias("ret3"), over(126).alias("ret6"), over(252).alias("ret12"), (F.col("price") / F.col("ath") - 1).alias("dd_ath"))


def promoter_change(holdings: DataFrame) -> DataFrame:
    """symbol, prom_chg: the newest promoter share less that two filings before; three filings and both shares are needed. ``holdings``: symbol, date, promoter_pct."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    d = holdings.where("date is not null").withColumn("k", k).where("k in (1, 3)")
    at = lambda i: F.max(F.when(F.col("k") == i, F.col("promoter_pct")))
    return d.groupBy("symbol").agg((at(1) - at(3)).alias("prom_chg")).where("prom_chg is not null")


def heat(measured: DataFrame, sectors: DataFrame, least: int = 5) -> DataFrame:
    """sector, heat: hot, mid or cold by the rank of its median 3-month return; none if fewer than ``least`` sectors have one."""
    med = measured.join(sectors, "symbol").where("sector is not null and ret3 is not null").groupBy("sector").agg(F.round(F.percentile("ret3", F.lit(0.5)), 9).alias("m"))
    p = average_rank("m", [])
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return med.withColumn("p", p).withColumn("n", n).where(F.col("n") >= least).select("sector", F.when(F.col("p") >= 67, "hot").when(F.col("p") <= 33, "cold").otherwise("mid").alias("heat"))


def rated(measured: DataFrame, shares: DataFrame, sectors: DataFrame, promoters: DataFrame, watched: DataFrame, min_mcap: float = 50.0, least: int = 2) -> DataFrame:
    """All symbols of a score of ``least`` at least, with what made it, flags and tags."""
    c = F.col
    h = heat(measured, sectors)
    d = measured.join(shares, "symbol").join(sectors, "symbol", "left").join(F.broadcast(h), "sector", "left").join(promoters, "symbol", "left").join(watched.select("symbol", F.lit(True).alias("watched")).distinct(), "symbol", "left")
    d = d.withColumn("mcap", c("price") * c("shares") / 1e7).where((c("mcap") >= min_mcap) & (c("turn20") >= 5) & (c("bars") >= 100))
    # fixed values: limits, labels and points
    rules = [
        (c("dd_ath") <= -0.6, "fallen angel", 1), (c("volreg") >= 1.5, "volume waking", 1), (c("mcap") < 500, "small", 1), (c("ret6") >= 0.3, "6m momentum", 1), (c("prom_chg") >= 1.0, "promoter adding", 1),
        (c("prom_chg") <= -1.0, "promoter SELLING", -1), (c("heat") == "hot", "hot sector", 1), (c("heat") == "cold", "COLD sector", -1),
    ]
    score = sum((F.when(yes(cond), v).otherwise(0) for cond, _, v in rules), F.lit(0))
    d = d.withColumn("score", score).where(c("score") >= least)
    return d.select(
        "symbol", "score", F.array_join(labels(*[(cond, text) for cond, text, _ in rules]), ", ").alias("why"), F.array_join(labels((c("watched"), "SURVEILLANCE"), (c("turn20") < 50, "thin")), ", ").alias("flags"),
        F.array_join(labels((c("dd_ath") <= -0.5, "deep"), ((c("turn20") < 100) & (c("ret12").isNull() | (c("ret12") < 0.4)), "quiet"), (c("ret12") >= 0.6, "late")), ", ").alias("tags"),
        "heat", "sector", F.round("mcap", 0).alias("mcap_cr"), F.round("price", 1).alias("price"), F.round("ret6", 3).alias("ret6"), F.round("dd_ath", 2).alias("dd_ath"), F.round("volreg", 4).alias("volreg"),
    )


def radar(measured: DataFrame, shares: DataFrame, sectors: DataFrame, promoters: DataFrame, watched: DataFrame, min_mcap: float = 50.0, least: int = 2, most: int = 400) -> DataFrame:
    """The ``most`` best of the rated symbols, best first, as the original lists them."""
    out = rated(measured, shares, sectors, promoters, watched, min_mcap, least)
    return out.orderBy(F.desc("score"), F.desc(F.coalesce("volreg", F.lit(0.0))), "symbol").limit(most)


def context(measured: DataFrame, shares: DataFrame, min_mcap: float = 50.0) -> DataFrame:
    """One row: universe size and how far from their highs eligible symbols stand."""
    d = measured.join(shares, "symbol").withColumn("mcap", F.col("price") * F.col("shares") / 1e7)
    ok = (F.col("mcap") >= min_mcap) & (F.col("turn20") >= 5) & (F.col("bars") >= 100)
    one = d.agg(F.count_if(F.col("mcap") >= min_mcap).alias("n_universe"), F.percentile(F.when(ok, F.col("dd_ath")), F.lit(0.5)).alias("dd"))
    return one.select("n_universe", F.round("dd", 3).alias("mkt_dd"), F.when(F.col("dd") <= -0.35, "CRUSHED").when(F.col("dd") <= -0.22, "MODERATE").otherwise("NEAR HIGHS").alias("context"))
