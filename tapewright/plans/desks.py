"""Queries of backtests, the desk's cross-sections, the radar and the feeds."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.stored import shared_folder, stored
from ..operators import backtest as B
from ..operators import desk as D
from ..operators import feeds as N
from ..operators import radar as R
from ..operators import scoring as X
from ..operators import technicals as T
from ..sources import panels
from ..sources.sinks import radar_bundle
from . import given, labs, scores
from .scores import FEATS
from .sql import BARS, TECH, WEEKLY

DAYS = [f"{y}-{m:02d}-01" for y in range(1998, 2002) for m in (1, 4, 7, 10)]
TECH_FACTORS = ["vs_ema200", "vs_ema50", "ema_stack", "ema200_slope", "above_200_days", "ret_3m", "ret_6m", "mom_12_1", "sharpe_6m", "pos_52", "structure", "dist_hi60", "eff_ratio_60", "turnover_20", "updown_vol_20", "vol_ratio_20_50"]
RULES = {"swing_long": {"turnover_min": 2, "min_bars": 200, "above_ema200": True}}
LEAST = 20


def cohort_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores and forward returns of every cohort, and the benchmark's returns. Features are causal, so they are computed once for all bars and read off as of each day."""
    bars = stored(panels.bars(spark, sf_dir))
    pairs = stored(B.cohorts(bars, DAYS))
    names = panels.companies(spark, sf_dir).select("symbol", "sector", "lender")
    none = {c: F.lit(None).cast("double") for c in ("pat_ttm", "pe", "other_inc_pbt", "dilution_3y", "dilution_hist", "cfo_pat_3y")}
    now = T.on_days(bars, pairs, "cohort").select("cohort", "symbol", *TECH_FACTORS, "bars", "atr_pct", F.col("close").alias("price")).join(names, "symbol").withColumns(none)
    now = stored(now)
    scored = X.score(now, ["cohort"], rules=RULES, factors={k: X.FACTORS[k] for k in TECH_FACTORS})
    closes = bars.select("symbol", "date", "close")
    index = panels.bench(bars).select(F.lit("INDEX").alias("symbol"), "date", F.col("bench").alias("close"))
    return stored(scored.join(B.forward_returns(closes, pairs), ["symbol", "cohort"])), B.forward_returns(index, pairs)


def ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored, bench = cohort_table(spark, sf_dir)
    return B.ranked(B.eligible(scored, "swing_long", 0.6, LEAST)), bench


def j05(spark, sf_dir):
    return B.cohorts(panels.bars(spark, sf_dir), DAYS)


def j04(spark, sf_dir):
    bars = stored(panels.bars(spark, sf_dir))
    return rounded(B.forward_returns(bars.select("symbol", "date", "close"), B.cohorts(bars, DAYS)))


def cohort_rows(spark, sf_dir):
    return rounded(B.portfolios(*ranks(spark, sf_dir)))


def cohort_ic(spark, sf_dir):
    return rounded(B.portfolios(*ranks(spark, sf_dir)).select("cohort", "ic", "top_decile", "bottom_decile", "spread"))


def decile_table(spark, sf_dir):
    return rounded(B.deciles(ranks(spark, sf_dir)[0]))


def ledger(spark, sf_dir):
    return B.picks(*ranks(spark, sf_dir))


def summary(spark, sf_dir):
    return rounded(B.summary(B.portfolios(*ranks(spark, sf_dir)), 4))


def history(spark, sf_dir) -> DataFrame:
    """Past runs: the cohorts' scores, prices and passes."""
    scored, _ = cohort_table(spark, sf_dir)
    return scored.select(F.col("cohort").alias("asof"), "symbol", "price", F.round("score_swing_long", 9).alias("score"), (F.size("gates_swing_long") == 0).alias("passes"))


def desk(f, spark, sf_dir):
    return rounded(f(scores.features(spark, sf_dir)))


def breadth_now(spark, sf_dir):
    return D.breadth(scores.features(spark, sf_dir))


def swing_tiers(spark, sf_dir):
    """By the fixed floor of returns, and by none."""
    now = stored(T.newest(panels.bars(spark, sf_dir)))
    return D.swing(now).withColumn("floor", F.lit(0.35)).unionByName(D.swing(now, min_ret=0.0).withColumn("floor", F.lit(0.0)))


def moves(spark, sf_dir):
    return D.move_quality(labs.flow_lab(spark, sf_dir))


def gathering(spark, sf_dir):
    """Accumulating symbols while the feed is fresh, and of a run nine days later, which has none."""
    q, last = stored(moves(spark, sf_dir)), panels.weekly(spark, sf_dir).agg(F.max("date").alias("day")).scalar()
    return D.trifecta(q, last, F.date_add(last, 7)).withColumn("days", F.lit(7)).unionByName(D.trifecta(q, last, F.date_add(last, 9)).withColumn("days", F.lit(9)))


def past(f, spark, sf_dir):
    return f(history(spark, sf_dir))


def radar_inputs(spark, sf_dir):
    panel = panels.weekly(spark, sf_dir).withColumn("volume", F.col("qty") * 100)
    names = panel.select("symbol").distinct().withColumn("b", F.substring("symbol", 7, 2).cast("int"))
    shares = names.select("symbol", (F.col("b") * 50000.0).alias("shares"))
    sector = names.select("symbol", F.substring("symbol", 7, 1).alias("sector"))
    held = names.select("symbol", F.explode(F.sequence(F.lit(1), F.when(F.col("b") % 4 == 0, 2).otherwise(4))).alias("q"), "b").select("symbol", F.add_months(F.lit("2001-01-01").cast("date"), 3 * F.col("q")).alias("date"), (40.0 + F.col("b") * F.col("q") % 7).alias("promoter_pct"))
    watched = names.where("b % 7 = 0").select("symbol")
    return panel, shares, sector, held, watched


def radar_list(spark, sf_dir):
    panel, shares, sector, held, watched = radar_inputs(spark, sf_dir)
    return R.radar(R.measures(panel), shares, sector, R.promoter_change(held), watched, min_mcap=1.0, least=1)


def radar_measures(spark, sf_dir):
    return rounded(R.measures(radar_inputs(spark, sf_dir)[0]))


def radar_prior(spark, sf_dir):
    """With highs of an earlier bundle: a little above each symbol's first close."""
    panel = radar_inputs(spark, sf_dir)[0]
    prior = panel.groupBy("symbol").agg((F.min_by("close", "date") * 1.2).alias("ath"), F.min("date").alias("asof"))
    return rounded(R.measures(panel, prior).select("symbol", "ath", "dd_ath", "bars"))


def bundle(spark, sf_dir):
    """What a later radar run starts from, written and read back, a row a symbol."""
    panel, shares, sector, held, watched = radar_inputs(spark, sf_dir)
    asof = panel.agg(F.max("date")).scalar()
    t = radar_bundle(spark, f"{shared_folder(spark)}/radar-{uuid.uuid4().hex}", R.measures(panel), asof, {"shares": shares, "sector": sector, "held": held, "watched": watched})
    n = t["held"].groupBy("symbol").agg(F.count("*").alias("n_held"), F.max("date").alias("newest"))
    listed = t["watched"].withColumn("watched", F.lit(True))
    return rounded(t["ath"].join(t["shares"], "symbol").join(t["sector"], "symbol").join(n, "symbol").join(listed, "symbol", "left").withColumn("watched", F.coalesce("watched", F.lit(False))), 5)


def promoters(spark, sf_dir):
    return rounded(R.promoter_change(radar_inputs(spark, sf_dir)[3]))


def sector_heat(spark, sf_dir):
    panel, _, sector, _, _ = radar_inputs(spark, sf_dir)
    return R.heat(R.measures(panel), sector)


def radar_counts(spark, sf_dir):
    """Symbols by score, of all rated ones, listed or not."""
    panel, shares, sector, held, watched = radar_inputs(spark, sf_dir)
    return R.rated(R.measures(panel), shares, sector, R.promoter_change(held), watched, min_mcap=1.0, least=1).groupBy("score").agg(F.count("*").alias("n"))


def filed_coverage(spark, sf_dir):
    """How many symbols have filings, and what share of filings has a profit."""
    f = N.upsert(filings(spark, sf_dir), ["symbol", "period_end"], F.desc("source"))
    return f.agg(F.count_distinct("symbol").alias("symbols"), F.round(F.avg(F.col("pat").isNotNull().cast("double")), 6).alias("covered"), F.max("period_end").alias("freshest"))


def nominal(spark, sf_dir):
    """Nominal cohort days of all kinds between the first and last session."""
    ends = panels.bars(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    one = lambda kind: ends.select(F.lit(kind).alias("kind"), F.explode(B.nominal_days(F.col("a"), F.col("b"), kind)).alias("day"))
    return one("MS").unionByName(one("QS")).unionByName(one("2W-MON")).unionByName(one("AS-JUL"))


def audit(spark, sf_dir):
    from ..sources.sinks import audit_table

    return rounded(audit_table(scores.scored(spark, sf_dir), ["roe", "de", "pe"], ["ret_6m", "pos_52"], ["quality", "trend"], ["longterm", "swing_long"]))


def market_context(spark, sf_dir):
    """The market's state, how many symbols are rated, and of how many with each score."""
    panel, shares, sector, held, watched = radar_inputs(spark, sf_dir)
    measured = stored(R.measures(panel))
    listed = R.rated(measured, shares, sector, R.promoter_change(held), watched, min_mcap=1.0, least=1)
    counts = listed.agg(F.count("*").alias("n_listed"), *[F.count_if(F.col("score") == k).alias(f"n_{k}") for k in (2, 3, 4, 5)])
    return R.context(measured, shares, 1.0).join(F.broadcast(counts))


def repaired(spark, sf_dir):
    return rounded(R.repair(panels.bars(spark, sf_dir).select("symbol", "date", "close")).select("symbol", "date", "event", "adj"))


def filings(spark, sf_dir):
    """Quarterly results twice: an archive to 1999, fresh ones from 1999 on with a little more profit."""
    q = panels.periods(spark, sf_dir, True).select("symbol", "key", "period_end", F.col("rev").alias("sales"), F.col("ni").alias("pat"))
    old = q.where(F.year("period_end") <= 1999).withColumn("source", F.lit("archive"))
    return old.unionByName(q.where(F.year("period_end") >= 1999).withColumns({"source": F.lit("fresh"), "pat": F.col("pat") * 1.01}))


def merged(spark, sf_dir):
    return rounded(N.upsert(filings(spark, sf_dir), ["symbol", "period_end"], F.desc("source")).drop("key"), 7)


def yoy(spark, sf_dir):
    return rounded(N.year_ago(N.upsert(filings(spark, sf_dir), ["symbol", "period_end"], F.desc("source"))), 5)


def checked(spark, sf_dir):
    filed = N.upsert(filings(spark, sf_dir), ["symbol", "period_end"], F.desc("source"))
    vendor = filed.select("symbol", "period_end", (F.col("pat") * F.when(F.col("key") % 6 == 0, 0.1).otherwise(1.0)).alias("vendor_pat"))
    return rounded(N.cross_check(filed.select("symbol", "period_end", "pat"), vendor), 4)


def futures(spark, sf_dir):
    lines = panels.ticks(spark, sf_dir, "l_linestatus").join(panels.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")), "l_partkey")
    return rounded(N.futures(lines.select("symbol", F.col("day").alias("date"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("oi"), F.col("l_quantity").alias("vol"), F.col("px").alias("close"), F.col("ord").alias("expiry"))))


def market_caps(spark, sf_dir):
    price = panels.bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    c = panels.companies(spark, sf_dir).select("symbol", "shares").join(price, "symbol")
    return c.select("symbol", F.round(F.col("price") * F.col("shares") / 1e7, 1).alias("mcap_cr")).where(F.col("mcap_cr") >= 300)


def fresh(spark, sf_dir):
    return N.freshness(panels.bars(spark, sf_dir), F.lit("2001-10-25").cast("date"))


def expected(spark, sf_dir):
    return panels.table(spark, sf_dir, "events").select("event_id", N.expected_session(F.col("ts").cast("timestamp")).alias("session"))


def feed(spark, sf_dir) -> DataFrame:
    """Events as JSON documents, some wrapped, some with blanks."""
    e = panels.table(spark, sf_dir, "events")
    doc = F.format_string('{"data":[{"symbol":"U%d","note":"-"},{"x":{"symbol":"%s"}}],"symbol":""}', "user_id", "event_type")
    return e.select("event_id", "user_id", "event_type", "ts", "value", "props", doc.alias("doc"))


def picked(spark, sf_dir):
    d = feed(spark, sf_dir)
    rows = N.unwrap(F.col("doc"))
    cols = {"Symbol": F.try_variant_get(rows, "$[0].symbol", "string"), "note": F.try_variant_get(rows, "$[0].note", "string"), "kind": F.col("event_type")}
    return d.select("event_id", N.pick(cols, ["SYMBOL", "name"]).alias("symbol"), N.pick(cols, ["note", "KIND"]).alias("note"))


def props(spark, sf_dir):
    return feed(spark, sf_dir).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


def keys(spark, sf_dir):
    return N.key_inventory(feed(spark, sf_dir), "props")


def appended(spark, sf_dir):
    e = feed(spark, sf_dir).select("user_id", "event_type", F.to_date("ts").alias("day"))
    archive = e.where("day < DATE '2024-01-15'").dropDuplicates()
    return N.append_new(archive, e.where("day >= DATE '2024-01-10'"), ["user_id", "event_type", "day"])


def sharded(spark, sf_dir):
    return panels.companies(spark, sf_dir).select("symbol", N.shard(F.col("symbol")).alias("shard"))


def weekdays(spark, sf_dir):
    last = panels.bars(spark, sf_dir).agg(F.max("date").alias("d"))
    return last.select(F.explode(N.trading_days(F.col("d"), 60)).alias("day"))


QUERIES = {
    "j05_asof_fwd": j05, "j04_asof_back": j04, "a07_cohorts": cohort_rows, "a08_deciles": decile_table, "a09_ic": cohort_ic, "a11_summary": summary, "a21_picks": ledger,
    "a03_sectors": partial(desk, D.sectors), "a04_breadth": breadth_now, "x11_swing": swing_tiers, "x14_move_quality": moves, "x14_trifecta": gathering, "x16_movers": partial(past, D.movers), "x17_deltas": partial(past, D.deltas), "a17_track": partial(past, D.track_record), "snk5_retention": partial(past, partial(D.retained, runs=3)),
    "w38_ca_adjust": repaired, "w40_radar_inputs": radar_measures, "w41_ath": radar_prior, "w42_promoters": promoters, "snk10_bundle": bundle, "a14_heat": sector_heat, "a15_context": market_context, "x12_radar": radar_list,
    "a16_counts": radar_counts, "a20_coverage": filed_coverage, "b03_days": nominal, "snk4_audit": audit,
    "o05_upsert": merged, "j07_interval_yoy": yoy, "j11_cross_check": checked, "a01_futures": futures, "a22_mcap": market_caps, "p19_freshness": fresh, "p18_expected": expected, "src_pick": picked, "src_props": props, "src_keys": keys, "snk11_append": appended, "src_shards": sharded, "src_days": weekdays,
}

# --- SQL

#: A keyword there.
ASOF_ = '"asof"'

_TIE = lambda v, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by}) * 100.0"


def cohort_days(days: list[str]) -> str:
    return f"days(day) AS (VALUES {', '.join(f'(DATE {chr(39)}{d}{chr(39)})' for d in days)}), c0 AS (SELECT DISTINCT coalesce((SELECT min(date) FROM bars WHERE date >= day), (SELECT max(date) FROM bars)) AS cohort FROM days), coh AS (SELECT * FROM (SELECT cohort, lead(cohort) OVER (ORDER BY cohort) AS exit FROM c0) WHERE exit IS NOT NULL)"


_COH = cohort_days(DAYS)
_FWD = "(SELECT a.symbol, a.cohort, a.exit, entry_px, exit_px, exit_px / entry_px - 1 AS fwd FROM (SELECT symbol, cohort, exit, arg_max(close, date) AS entry_px FROM {0} JOIN coh ON date <= cohort GROUP BY 1, 2, 3) a JOIN (SELECT symbol, cohort, arg_max(close, date) AS exit_px FROM {0} JOIN coh ON date <= exit GROUP BY 1, 2) b USING (symbol, cohort))"
COHORTS = f"""{TECH}, {_COH},
names AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
now AS MATERIALIZED (SELECT cohort, t.* EXCLUDE (price, bars), close AS price, n AS bars, sector FROM tech t JOIN coh ON date <= cohort JOIN names USING (symbol) WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY t.symbol, cohort ORDER BY date DESC) = 1),
facts(factor, higher, pillar, in_sector, lender_ok, other_ok) AS (VALUES {given.FACTORS}),
l0 AS ({" UNION ALL ".join(f"SELECT cohort, symbol, '{k}' AS factor, CAST({k} AS DOUBLE) AS value FROM now" for k in given.TECHNICAL)}),
cuts AS (SELECT cohort, factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM l0 WHERE factor IN ('updown_vol_20', 'vol_ratio_20_50') GROUP BY 1, 2),
l2 AS (SELECT cohort, symbol, factor, pillar, higher, round(CASE WHEN lo IS NOT NULL THEN least(greatest(value, lo), hi) ELSE value END, 9) AS value FROM l0 LEFT JOIN cuts USING (cohort, factor) JOIN facts USING (factor) WHERE value IS NOT NULL),
l3 AS (SELECT cohort, symbol, pillar, CASE WHEN higher THEN p ELSE 100 - p END AS p FROM (SELECT *, {_TIE("value", "cohort, factor")} AS p FROM l2)),
pil AS (SELECT cohort, symbol, {given.pillars()} FROM l3 GROUP BY 1, 2),
bench1 AS (SELECT 'INDEX' AS symbol, date, bench AS close FROM bench),
fwd AS {_FWD.format("bars")}, bfwd AS (SELECT cohort, fwd AS b FROM {_FWD.format("bench1")}),
sc AS MATERIALIZED (SELECT now.cohort, exit, symbol, sector, price, entry_px, exit_px, fwd, {given.composite("swing_long")}, concat_ws(';', CASE WHEN bars < 200 THEN 'history' END, CASE WHEN NOT coalesce(turnover_20, 0) >= 2 THEN 'turnover' END, CASE WHEN NOT coalesce(vs_ema200, 0) > 0 THEN 'below' END) AS g FROM now JOIN pil USING (cohort, symbol) JOIN fwd USING (cohort, symbol)),
el AS (SELECT *, round(score_swing_long, 9) AS score, count(*) OVER (PARTITION BY cohort) AS n_elig FROM sc WHERE g = '' AND cov_swing_long >= 0.6 AND fwd IS NOT NULL AND score_swing_long IS NOT NULL),
rk AS (SELECT *, n_elig - up + 1 AS down, greatest(1, CAST(ceil((up - 1) * 10 / (n_elig - 1) - 1e-9) AS INT)) AS decile FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY score, symbol DESC) AS up FROM el WHERE n_elig >= {LEAST})),
rr AS (SELECT rk.*, coalesce(b, 0) AS b, {_TIE("score", "cohort")} AS rs, {_TIE("round(fwd, 12)", "cohort")} AS rf FROM rk LEFT JOIN bfwd USING (cohort)),
pf AS (SELECT cohort, exit, max(n_elig) AS n_elig, avg(CASE WHEN down <= 10 THEN fwd END) - 0.003 AS top, avg(CASE WHEN up <= 10 THEN fwd END) - 0.003 AS bottom, avg(fwd) AS universe, max(b) AS bench, avg(CASE WHEN down <= 10 THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END END) AS hit, avg(CASE WHEN down <= 10 THEN CASE WHEN fwd > b THEN 1.0 ELSE 0.0 END END) AS beat_bench, corr(rs, rf) AS ic, avg(CASE WHEN decile = 10 THEN fwd END) AS top_decile, avg(CASE WHEN decile = 1 THEN fwd END) AS bottom_decile FROM rr GROUP BY 1, 2),
pfs AS (SELECT *, coalesce(top_decile, 0) - coalesce(bottom_decile, 0) AS spread FROM pf),
hist AS (SELECT cohort AS {ASOF_}, symbol, price, round(score_swing_long, 9) AS score, g = '' AS passes FROM sc),
h AS (SELECT *, dense_rank() OVER (ORDER BY {ASOF_} DESC) - 1 AS back FROM hist)"""
_r = lambda cols, n=6: ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c in cols.split())
_PF = ["top", "bottom", "universe", "bench"]
_SUM = f"""WITH {COHORTS}, e AS (SELECT *, {", ".join(f"exp(sum(ln(1 + {c})) OVER w) AS eq_{c}" for c in _PF)} FROM pfs WINDOW w AS (ORDER BY cohort ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, {", ".join(f"eq_{c} / max(eq_{c}) OVER w - 1 AS dd_{c}" for c in _PF)} FROM e WINDOW w AS (ORDER BY cohort ROWS UNBOUNDED PRECEDING)),
g AS (SELECT count(*) AS cohorts, min(cohort) AS first, max(exit) AS last_exit, {", ".join(f"exp(sum(ln(1 + {c}))) - 1 AS {c}_total, pow(exp(sum(ln(1 + {c}))), 1 / (count(*) / 4.0)) - 1 AS {c}_cagr, avg({c}) AS {c}_avg, quantile_cont({c}, 0.5) AS {c}_median, min(dd_{c}) AS {c}_max_dd, avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) AS {c}_pos" for c in _PF)},
  {", ".join(f"avg({x}) AS {a}, avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) AS {b}" for x, a, b in (("top - universe", "excess_universe", "excess_universe_pos"), ("top - bench", "excess_bench", "excess_bench_pos"), ("ic", "ic_mean", "ic_pos"), ("spread", "spread_avg", "spread_pos")))}, avg(hit) AS hit_rate, avg(beat_bench) AS beat_rate, avg(top - bottom) AS top_minus_bottom FROM f)
SELECT cohorts, first, last_exit, {_r(" ".join(f"{c}_{k}" for c in _PF for k in ("total", "cagr", "avg", "median", "max_dd", "pos")) + " excess_universe excess_universe_pos excess_bench excess_bench_pos hit_rate beat_rate ic_mean ic_pos spread_avg spread_pos top_minus_bottom")} FROM g"""
_best = "row_number() OVER (ORDER BY score DESC, symbol)"
_MOVERS = f"""WITH {COHORTS}, now0 AS (SELECT * FROM h WHERE back = 0), prev AS (SELECT * FROM h WHERE back = 1), rn AS (SELECT *, {_best} AS r FROM now0 WHERE passes AND score IS NOT NULL), rp AS (SELECT *, {_best} AS r FROM prev WHERE passes),
both0 AS (SELECT symbol, round(n.score - p.score, 9) AS d FROM now0 n JOIN prev p USING (symbol)),
z AS (SELECT 'new_top' AS kind, row_number() OVER (ORDER BY r) AS place, symbol, CAST(NULL AS DOUBLE) AS d, 15 AS m FROM rn WHERE r <= 50 AND symbol NOT IN (SELECT symbol FROM rp WHERE r <= 50)
UNION ALL SELECT 'left_top', row_number() OVER (ORDER BY symbol), symbol, NULL, 15 FROM rp WHERE r <= 50 AND symbol NOT IN (SELECT symbol FROM rn WHERE r <= 50)
UNION ALL SELECT 'gainer', row_number() OVER (ORDER BY d DESC, symbol), symbol, d, 10 FROM both0 WHERE d IS NOT NULL UNION ALL SELECT 'loser', row_number() OVER (ORDER BY d, symbol), symbol, d, 10 FROM both0 WHERE d IS NOT NULL
UNION ALL SELECT 'newly_pass', row_number() OVER (ORDER BY coalesce(r, 9999), n.symbol), n.symbol, NULL, 15 FROM now0 n LEFT JOIN rn ON rn.symbol = n.symbol WHERE n.passes AND n.symbol NOT IN (SELECT symbol FROM prev WHERE passes)
UNION ALL SELECT 'newly_fail', row_number() OVER (ORDER BY symbol), symbol, NULL, 15 FROM prev WHERE passes AND symbol NOT IN (SELECT symbol FROM now0 WHERE passes))
SELECT kind, place, symbol, round(d, 1) + 0.0 AS d FROM z WHERE place <= m"""
_med = lambda c, n=4: f"round(quantile_cont({c}, 0.5), {n}) + 0.0"
_LABS = labs.FLOWS
_g = lambda a, b: f"CASE WHEN {b} <> 0 THEN ({a} - {b}) / abs({b}) END"


def _events(src: str) -> str:
    """Repair of corporate actions over a panel with session_no."""
    return f"ra AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY session_no RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS r, max(close) OVER (PARTITION BY symbol ORDER BY session_no RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS aft FROM {src}), rb AS (SELECT *, CASE WHEN r <= 0.72 AND aft / close < 1.35 THEN r END AS event FROM ra), rep AS (SELECT *, close * coalesce(product(coalesce(event, 1.0)) OVER (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS adj FROM rb)"


_RADAR = f"""{WEEKLY}, s0 AS (SELECT symbol, date, close, close * qty * 100 AS turn, dense_rank() OVER (ORDER BY date) AS session_no FROM weekly), {_events("s0")}, la AS (SELECT max(session_no) AS last FROM rep),
m0 AS (SELECT symbol, arg_max(adj, session_no) AS price, CASE WHEN count(CASE WHEN session_no > last - 20 THEN turn END) >= 10 THEN avg(CASE WHEN session_no > last - 20 THEN turn END) END / 1e5 AS turn20,
  CASE WHEN count(CASE WHEN session_no > last - 63 THEN turn END) >= 40 THEN avg(CASE WHEN session_no > last - 63 THEN turn END) END / CASE WHEN count(CASE WHEN session_no > last - 252 THEN turn END) >= 150 THEN avg(CASE WHEN session_no > last - 252 THEN turn END) END AS volreg,
  max(adj) AS ath, count(close) AS bars, {", ".join(f"CASE WHEN max(last) > {k} THEN arg_max(adj, session_no) / arg_max(CASE WHEN session_no <= last - {k} + 1 THEN adj END, CASE WHEN session_no <= last - {k} + 1 THEN session_no END) - 1 END AS {n}" for n, k in (("ret3", 63), ("ret6", 126), ("ret12", 252)))} FROM rep, la GROUP BY symbol),
meas AS MATERIALIZED (SELECT *, price / ath - 1 AS dd_ath FROM m0),
nm AS (SELECT DISTINCT symbol, CAST(substring(symbol, 7, 2) AS INT) AS b, substring(symbol, 7, 1) AS sector FROM weekly),
held AS (SELECT symbol, q, 40.0 + b * q % 7 AS pct, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY q DESC) AS k FROM nm, range(1, 5) t(q) WHERE q <= CASE WHEN b % 4 = 0 THEN 2 ELSE 4 END),
prom AS (SELECT symbol, max(CASE WHEN k = 1 THEN pct END) - max(CASE WHEN k = 3 THEN pct END) AS prom_chg FROM held WHERE n >= 3 GROUP BY symbol),
hm AS (SELECT sector, round(quantile_cont(ret3, 0.5), 9) AS m FROM meas JOIN nm USING (symbol) WHERE ret3 IS NOT NULL GROUP BY sector),
heat AS (SELECT sector, CASE WHEN p >= 67 THEN 'hot' WHEN p <= 33 THEN 'cold' ELSE 'mid' END AS heat FROM (SELECT sector, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () * 100.0 AS p, count(*) OVER () AS n FROM hm) WHERE n >= 5),
cand AS (SELECT meas.*, nm.sector, heat, prom_chg, b, price * b * 50000.0 / 1e7 AS mcap FROM meas JOIN nm USING (symbol) LEFT JOIN heat USING (sector) LEFT JOIN prom USING (symbol))"""
_RULES = [("dd_ath <= -0.6", "fallen angel", 1), ("volreg >= 1.5", "volume waking", 1), ("mcap < 500", "small", 1), ("ret6 >= 0.3", "6m momentum", 1), ("prom_chg >= 1.0", "promoter adding", 1), ("prom_chg <= -1.0", "promoter SELLING", -1), ("heat = 'hot'", "hot sector", 1), ("heat = 'cold'", "COLD sector", -1)]
_FILED = f"""{scores.STATEMENTS}, fl AS (SELECT symbol, key, period_end, rev AS sales, ni AS pat, 'archive' AS source FROM quarterly WHERE year(period_end) <= 1999 UNION ALL SELECT symbol, key, period_end, rev, ni * 1.01, 'fresh' FROM quarterly WHERE year(period_end) >= 1999),
filed AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY source DESC) = 1)"""

ORACLES = {
    "j05_asof_fwd": f"WITH {BARS}, {_COH} SELECT cohort, exit FROM coh",
    "j04_asof_back": f"WITH {BARS}, {_COH} SELECT symbol, exit, cohort, {_r('entry_px exit_px fwd')} FROM {_FWD.format('bars')}",
    "a07_cohorts": f"WITH {COHORTS} SELECT cohort, exit, n_elig, {_r('top bottom universe bench hit beat_bench ic top_decile bottom_decile spread')} FROM pfs",
    "a08_deciles": f"WITH {COHORTS} SELECT cohort, decile, round(avg(fwd), 6) + 0.0 AS mean_fwd, count(*) AS n FROM rk GROUP BY 1, 2",
    "a09_ic": f"WITH {COHORTS} SELECT cohort, {_r('ic top_decile bottom_decile spread')} FROM pfs",
    "a11_summary": _SUM,
    "a21_picks": f"WITH {COHORTS} SELECT cohort, symbol, sector, round(score, 1) AS score, round(entry_px, 4) AS entry, round(exit_px, 4) AS exit_px, round(fwd, 4) + 0.0 AS ret, round(b, 4) + 0.0 AS bench FROM rk LEFT JOIN bfwd USING (cohort) WHERE down <= 10",
    "a03_sectors": f"WITH {FEATS} SELECT sector, count(*) AS n, {', '.join(f'{_med(c)} AS {c}' for c in ('ret_1m', 'ret_3m', 'ret_6m', 'vs_ema200', 'pe', 'sales_g3', 'roce'))}, round(avg(CASE WHEN vs_ema200 > 0 THEN 1.0 WHEN vs_ema200 <= 0 THEN 0.0 END), 2) AS pct_above_200 FROM feats GROUP BY sector",
    "a04_breadth": f"WITH {FEATS}, d AS (SELECT * FROM feats WHERE bars >= 200) SELECT count(*) AS n, {', '.join(f'round(count(*) FILTER (WHERE vs_ema{k} > 0) / greatest(1, count(*)), 3) AS above_{k}' for k in (200, 50, 20))}, count(*) FILTER (WHERE from_52h > -0.01) AS new_52w_high, count(*) FILTER (WHERE from_52l < 0.01) AS new_52w_low, {_med('ret_1m')} AS median_ret_1m, round(count(*) FILTER (WHERE ema_stack = 1) / greatest(1, count(*)), 3) AS bull_stack, round(count(*) FILTER (WHERE ema_stack = -1) / greatest(1, count(*)), 3) AS bear_stack FROM d",
    "x11_swing": f"WITH {TECH}, e AS (SELECT f.floor, n.*, round(ret_6m, 9) AS r6 FROM newest n, (VALUES (CAST(0.35 AS DOUBLE)), (0.0)) f(floor) WHERE ret_6m >= f.floor AND above_sma200 AND turnover_20 >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY floor ORDER BY r6 DESC, symbol) - 1 AS place, count(*) OVER (PARTITION BY floor) AS m FROM e), c AS (SELECT floor, max(CASE WHEN place = greatest(0, CAST(floor(m * 0.25) AS INT) - 1) THEN r6 END) AS cut, max(CASE WHEN place = greatest(0, CAST(floor(m * 0.125) AS INT) - 1) THEN r6 END) AS cut_top FROM p GROUP BY floor) SELECT floor, symbol, CASE WHEN r6 >= cut_top THEN 'A' ELSE 'B' END AS tier, coalesce(atr_pct > 0.055, false) AS hot, CASE WHEN coalesce(NOT coalesce(atr_pct > 0.055, false) AND price >= prev_high + 0.5 * atr AND vol_x50 >= 1.5, false) THEN 'TRIGGER' ELSE 'WATCH' END AS state FROM p JOIN c USING (floor) WHERE m >= 4 AND r6 >= cut",
    "x14_move_quality": f"WITH {_LABS}, m AS (SELECT *, coalesce(deliv_per >= 1.5 * dpmed AND deliv_per >= 50, false) AS spike, coalesce(ret5 > 0.04, false) AS rally FROM lab WHERE session_no = (SELECT max(session_no) FROM lab) AND deliv_per IS NOT NULL) SELECT symbol, CASE WHEN coalesce(spike AND oi5 >= 0.10 AND abs(ret5) < 0.05, false) THEN 'accumulating' WHEN rally AND coalesce(deliv_per <= 0.5 * dpmed, false) THEN 'hollow' WHEN rally AND coalesce(oi5 <= -0.08, false) THEN 'covering' WHEN rally AND (coalesce(oi5 > 0.02, false) OR spike OR coalesce(dpmed <> 0 AND deliv_per >= 1.2 * dpmed, false)) THEN 'backed' END AS st, round(deliv_per, 1) AS dp, round(dpmed, 1) AS dp_med, round(oi5, 3) + 0.0 AS oi5, round(ret5, 3) + 0.0 AS ret5, round(vr5, 2) AS vr5 FROM m",
    "x14_trifecta": f"WITH {_LABS}, m AS (SELECT *, coalesce(deliv_per >= 1.5 * dpmed AND deliv_per >= 50, false) AS spike, coalesce(ret5 > 0.04, false) AS rally FROM lab WHERE session_no = (SELECT max(session_no) FROM lab) AND deliv_per IS NOT NULL) SELECT symbol, 7 AS days FROM m WHERE coalesce(spike AND oi5 >= 0.10 AND abs(ret5) < 0.05, false)",
    "x16_movers": _MOVERS,
    "x17_deltas": f"WITH {COHORTS}, far AS (SELECT least(5, max(back)) AS far FROM h) SELECT n.symbol, round(n.score - a.score, 1) + 0.0 AS d1, round(n.score - b.score, 1) + 0.0 AS d5 FROM (SELECT * FROM h WHERE back = 0) n LEFT JOIN (SELECT * FROM h WHERE back = 1) a USING (symbol) LEFT JOIN (SELECT h.* FROM h, far WHERE back = far) b ON b.symbol = n.symbol",
    "a17_track": f"WITH {COHORTS}, n0 AS (SELECT symbol, price AS p1, {ASOF_} AS today FROM h WHERE back = 0), p AS (SELECT *, row_number() OVER (PARTITION BY {ASOF_} ORDER BY score DESC, symbol) AS r FROM (SELECT *, count(*) OVER (PARTITION BY {ASOF_}) AS m FROM h WHERE back > 0 AND passes AND score IS NOT NULL) WHERE m >= 20), q AS (SELECT p.*, today, p1 / p.price - 1 AS ret FROM p LEFT JOIN n0 USING (symbol)) SELECT {ASOF_}, CAST(max(today) - {ASOF_} AS INT) AS days, round(avg(CASE WHEN r <= 10 THEN ret END), 4) + 0.0 AS top, round(avg(ret), 4) + 0.0 AS universe, round(avg(CASE WHEN r <= 10 THEN CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END END), 2) AS hit FROM q GROUP BY {ASOF_}",
    "snk5_retention": f"WITH {COHORTS} SELECT {ASOF_}, symbol, price, score, passes FROM h WHERE back <= 3",
    "w38_ca_adjust": f"WITH {BARS}, s0 AS (SELECT symbol, date, close, dense_rank() OVER (ORDER BY date) AS session_no FROM bars), {_events('s0')} SELECT symbol, date, {_r('event adj')} FROM rep",
    "w40_radar_inputs": f"WITH {_RADAR} SELECT symbol, bars, {_r('price turn20 volreg ath ret3 ret6 ret12 dd_ath')} FROM meas",
    "w41_ath": f"WITH {_RADAR}, pr AS (SELECT symbol, arg_min(close, date) * 1.2 AS old, min(date) AS {ASOF_} FROM weekly GROUP BY symbol), ev AS (SELECT r.symbol, product(r.event) AS f FROM rep r JOIN pr USING (symbol) WHERE event IS NOT NULL AND r.date > {ASOF_} GROUP BY 1), z AS (SELECT m.symbol, price, greatest(ath, old * coalesce(f, 1)) AS ath FROM meas m JOIN pr USING (symbol) LEFT JOIN ev USING (symbol)) SELECT symbol, round(ath, 6) AS ath, round(price / ath - 1, 6) + 0.0 AS dd_ath, CAST(300 AS BIGINT) AS bars FROM z",
    "w42_promoters": f"WITH {_RADAR} SELECT symbol, CAST(prom_chg AS DOUBLE) AS prom_chg FROM prom",
    "snk10_bundle": f"WITH {_RADAR}, l AS (SELECT max(date) AS {ASOF_} FROM weekly) SELECT m.symbol, round(ath, 5) AS ath, {ASOF_}, CAST(CAST(substr(m.symbol, 7, 2) AS INT) * 50000 AS DOUBLE) AS shares, substr(m.symbol, 7, 1) AS sector, CASE WHEN CAST(substr(m.symbol, 7, 2) AS INT) % 4 = 0 THEN 2 ELSE 4 END AS n_held, CASE WHEN CAST(substr(m.symbol, 7, 2) AS INT) % 4 = 0 THEN DATE '2001-07-01' ELSE DATE '2002-01-01' END AS newest, CAST(substr(m.symbol, 7, 2) AS INT) % 7 = 0 AS watched FROM meas m, l WHERE ath IS NOT NULL",
    "a14_heat": f"WITH {_RADAR} SELECT sector, heat FROM heat",
    "a15_context": f"WITH {_RADAR}, sc AS (SELECT {' + '.join(f'CASE WHEN {c} THEN {v} ELSE 0 END' for c, _, v in _RULES)} AS score FROM cand WHERE mcap >= 1 AND turn20 >= 5 AND bars >= 100), ls AS (SELECT count(*) FILTER (WHERE score >= 1) AS n_listed, {', '.join(f'count(*) FILTER (WHERE score = {k}) AS n_{k}' for k in (2, 3, 4, 5))} FROM sc), d AS (SELECT count(*) FILTER (WHERE mcap >= 1) AS n_universe, quantile_cont(CASE WHEN mcap >= 1 AND turn20 >= 5 AND bars >= 100 THEN dd_ath END, 0.5) AS dd FROM cand) SELECT n_universe, n_listed, n_2, n_3, n_4, n_5, round(dd, 3) + 0.0 AS mkt_dd, CASE WHEN dd <= -0.35 THEN 'CRUSHED' WHEN dd <= -0.22 THEN 'MODERATE' ELSE 'NEAR HIGHS' END AS context FROM d, ls",
    "x12_radar": f"WITH {_RADAR}, s AS (SELECT *, {' + '.join(f'CASE WHEN {c} THEN {v} ELSE 0 END' for c, _, v in _RULES)} AS score FROM cand WHERE mcap >= 1 AND turn20 >= 5 AND bars >= 100) SELECT symbol, score, concat_ws(', ', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{t}{chr(39)} END' for c, t, _ in _RULES)}) AS why, concat_ws(', ', CASE WHEN b % 7 = 0 THEN 'SURVEILLANCE' END, CASE WHEN turn20 < 50 THEN 'thin' END) AS flags, concat_ws(', ', CASE WHEN dd_ath <= -0.5 THEN 'deep' END, CASE WHEN turn20 < 100 AND (ret12 IS NULL OR ret12 < 0.4) THEN 'quiet' END, CASE WHEN ret12 >= 0.6 THEN 'late' END) AS tags, heat, sector, round(mcap, 0) AS mcap_cr, round(price, 1) AS price, round(ret6, 3) + 0.0 AS ret6, round(dd_ath, 2) + 0.0 AS dd_ath, round(volreg, 4) AS volreg FROM s WHERE score >= 1 ORDER BY score DESC, coalesce(round(volreg, 4), 0) DESC, symbol LIMIT 400",
    "a16_counts": f"WITH {_RADAR}, s AS (SELECT {' + '.join(f'CASE WHEN {c} THEN {v} ELSE 0 END' for c, _, v in _RULES)} AS score FROM cand WHERE mcap >= 1 AND turn20 >= 5 AND bars >= 100) SELECT score, count(*) AS n FROM s WHERE score >= 1 GROUP BY score",
    "a20_coverage": f"WITH {_FILED} SELECT count(DISTINCT symbol) AS symbols, round(avg(CASE WHEN pat IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS covered, max(period_end) AS freshest FROM filed",
    "b03_days": "WITH e AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem), d AS (SELECT CAST(a + CAST(i AS INT) AS DATE) AS day, a FROM e, range(0, 4000) t(i) WHERE a + CAST(i AS INT) <= b) SELECT 'MS' AS kind, day FROM d WHERE day(day) = 1 UNION ALL SELECT 'QS', day FROM d WHERE day(day) = 1 AND month(day) IN (1, 4, 7, 10) UNION ALL SELECT 'AS-JUL', day FROM d WHERE day(day) = 1 AND month(day) = 7 UNION ALL SELECT '2W-MON', day FROM d WHERE isodow(day) = 1 AND (day - (SELECT min(day) FROM d WHERE isodow(day) = 1)) % 14 = 0",
    "snk4_audit": f"WITH {scores.SCORED} SELECT symbol, {', '.join(f'round({c}, 6) + 0.0 AS f_{c}' for c in ('roe', 'de', 'pe'))}, {', '.join(f'round({c}, 6) + 0.0 AS t_{c}' for c in ('ret_6m', 'pos_52'))}, round(p_quality, 6) AS pillar_quality, round(p_trend, 6) AS pillar_trend, {', '.join(f'round(score_{m}, 6) AS score_{m}, round(cov_{m}, 6) AS cov_{m}, replace(gates_{m}, {chr(39)};{chr(39)}, {chr(39)}; {chr(39)}) AS gates_{m}' for m in ('longterm', 'swing_long'))} FROM scored",
    "o05_upsert": f"WITH {_FILED} SELECT symbol, period_end, round(sales, 7) AS sales, round(pat, 7) + 0.0 AS pat, source FROM filed",
    "j07_interval_yoy": f"WITH {_FILED}, l AS (SELECT symbol, arg_max(struct_pack(p := period_end, pat := pat, sales := sales), period_end) AS l FROM filed GROUP BY 1), j AS (SELECT l.symbol, any_value(l.l.p) AS period_end, any_value(l.l.pat) AS pat, any_value(l.l.sales) AS sales, arg_max(f.pat, f.period_end) AS pat0, arg_max(f.sales, f.period_end) AS sales0 FROM l LEFT JOIN filed f ON f.symbol = l.symbol AND f.period_end BETWEEN l.l.p - 376 AND l.l.p - 354 GROUP BY 1) SELECT symbol, period_end, round(pat, 5) + 0.0 AS pat, round({_g('pat', 'pat0')}, 5) + 0.0 AS pat_yoy, round({_g('sales', 'sales0')}, 5) + 0.0 AS sales_yoy FROM j",
    "j11_cross_check": f"WITH {_FILED}, z AS (SELECT symbol, period_end, pat, pat * CASE WHEN key % 6 = 0 THEN 0.1 ELSE 1.0 END AS vendor_pat FROM filed) SELECT symbol, period_end, {_r('pat vendor_pat', 4)}, round(pat / vendor_pat, 4) AS ratio FROM z WHERE abs(pat) > 5 AND abs(vendor_pat) > 5 AND (pat / vendor_pat > 5 OR pat / vendor_pat < 0.2)",
    "a01_futures": f"WITH {WEEKLY} SELECT p_brand AS symbol, day AS date, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS oi, sum(l_quantity) AS vol, round(arg_min(px, ord), 6) AS close FROM ticks JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "a22_mcap": f"WITH {BARS}, z AS (SELECT b.symbol, arg_max(close, date) AS price FROM bars b GROUP BY 1), s AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS symbol, 1e6 + 100 * abs(s_acctbal) AS shares FROM supplier) SELECT symbol, round(price * shares / 1e7, 1) AS mcap_cr FROM z JOIN s USING (symbol) WHERE round(price * shares / 1e7, 1) >= 300",
    "p19_freshness": f"WITH {BARS}, z AS (SELECT symbol, max(date) AS d FROM bars GROUP BY 1), y AS (SELECT max(d) AS prices_through, avg(CASE WHEN d >= DATE '2001-10-25' THEN 1.0 ELSE 0.0 END) AS covered, count(*) AS n_symbols FROM z) SELECT *, covered >= 0.6 AS fresh FROM y",
    "p18_expected": "WITH z AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS l FROM events), y AS (SELECT event_id, CAST(l AS DATE) - CASE WHEN hour(l) < 16 THEN 1 ELSE 0 END AS d FROM z) SELECT event_id, CAST(d - CAST(greatest(0, isodow(d) - 5) AS INT) AS DATE) AS session FROM y",
    "src_pick": "SELECT event_id, 'U' || user_id AS symbol, event_type AS note FROM events",
    "src_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "src_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "snk11_append": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "src_shards": "SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS symbol, CAST(('0x' || right(md5('S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')), 8)) AS BIGINT) % 8 AS shard FROM supplier",
    "src_days": "WITH z AS (SELECT CAST(max(l_shipdate) AS DATE) AS d FROM lineitem), y AS (SELECT d - CAST(i AS INT) AS day FROM z, range(0, 200) t(i)) SELECT CAST(day AS DATE) AS day FROM y WHERE isodow(day) <= 5 ORDER BY day DESC LIMIT 60",
}
