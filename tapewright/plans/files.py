"""Queries that write derived tables as files and read them back, and of the rules that readers apply."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.stored import cached, shared_folder, stored
from ..operators import scoring, sessions, statements
from ..sources import panels, readers, sinks
from . import given, scores
from .sql import BARS


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars through gzipped CSV shards."""
    at = place(spark, "bars")
    sinks.csv(panels.bars(spark, sf_dir).select("symbol", "date", "open", "high", "low", "close", "volume"), at)
    return rounded(readers.price_csv(spark, at).select("symbol", "date", "close", "volume"), 4)


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose names and values come with blanks."""
    at = place(spark, "headers")
    sinks.csv(panels.companies(spark, sf_dir).select(F.concat(F.lit(" "), "symbol", F.lit(" ")).alias(" symbol "), F.col("sector").alias("Sector ")), at, False)
    return readers.header_csv(spark, at).select(F.col("SYMBOL").alias("symbol"), F.col("SECTOR").alias("sector"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies as JSON documents, a broken line after every fifth, read as JSON lines."""
    at = place(spark, "lines")
    c = panels.companies(spark, sf_dir)
    good = sinks.document(c.select("symbol", "sector", "promoter"), "value")
    good.unionByName(c.where("key % 5 = 0").select(F.concat(F.lit('{"symbol": "'), "symbol").alias("value"))).write.text(at)
    return rounded(readers.json_lines(spark, at, "symbol string, sector string, promoter double"))


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of an even sum of digits lack the last session, which a second source has at a higher price."""
    bars = panels.bars(spark, sf_dir).select("symbol", "date", "close")
    last = bars.agg(F.max("date")).scalar()
    lacks = F.substring("symbol", 2, 5).cast("int") % 2 == 0
    return rounded(readers.patch(bars.where(~(lacks & (F.col("date") == last))), bars.where(F.col("date") == last).withColumn("close", F.col("close") * 1.01), last))


def topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.bars(spark, sf_dir).select("symbol", "date", "close")
    return rounded(readers.top_up(bars.where("date < DATE '1998-07-01'"), bars.where("date >= DATE '1998-01-01'").withColumn("close", F.col("close") * 1.02)))


def outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key").cast("int")
    records = panels.companies(spark, sf_dir).select("symbol", F.date_add(F.lit("2000-01-01").cast("date"), key % 60).alias("fetched"), (key % 9 == 0).alias("empty"))
    return readers.stale(records, F.lit("2000-02-15").cast("date"))


def with_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with index rows among them: the highest close, which lacks each fifth day of a month, and one that no stock has."""
    bars = panels.bars(spark, sf_dir).select("symbol", "date", "close")
    top = bars.where(F.dayofmonth("date") % 5 != 0).groupBy("date").agg(F.max("close").alias("close"))
    return bars.unionByName(top.select(F.lit("NIFTY50").alias("symbol"), "date", "close")).unionByName(top.select(F.lit("^VIX").alias("symbol"), "date", F.lit(1.0).alias("close")))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indices(spark, sf_dir).where(~sessions.is_index(F.col("symbol"))).groupBy("symbol").agg(F.count("*").alias("n"))


def index_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sessions.benchmark(with_indices(spark, sf_dir)))


SECTORS = [("Financial Services", "Banks - Regional"), ("Financial Services", "Capital Markets"), ("Technology", "Credit Services"), ("Financial Services", ""), ("Financial", "Insurance - Life"), (None, None)]


def lenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(a).alias("sector"), F.lit(b).alias("industry")) for a, b in SECTORS])
    d = panels.companies(spark, sf_dir).select("symbol", F.get(named, (F.col("key") % 6).cast("int")).alias("s"))
    return d.select("symbol", statements.is_lender(F.col("s.sector"), F.col("s.industry")).alias("lender"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue under two names: every company has the lesser one, each second company the better one, too."""
    a = panels.periods(spark, sf_dir, False).select("symbol", F.lit("inc_a").alias("stmt"), "period_end", "key", "rev")
    lines = a.select("symbol", "stmt", F.lit("Operating Revenue").alias("item"), "period_end", (F.col("rev") * 2).alias("value")).unionByName(a.where("key % 2 = 0").select("symbol", "stmt", F.lit("Total Revenue").alias("item"), "period_end", F.col("rev").alias("value")))
    return rounded(statements.wide(statements.resolve(lines), ["rev"]), 4)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars held against a session that most symbols have, and against the last one, which most get from the exchange at a price of one."""
    bars = panels.bars(spark, sf_dir).select("symbol", "date", "close")
    last = bars.agg(F.max("date")).scalar()
    extra = lambda: bars.select("symbol").distinct().select("symbol", last.alias("date"), F.lit(1.0).alias("close"))
    held = [(name, readers.fresh_bars(lambda: bars, extra, day)) for name, day in (("fresh", F.lit("1997-01-01").cast("date")), ("patched", F.date_add(last, 0)))]
    one, two = (df.groupBy("symbol").agg(F.max("date").alias("through"), F.count("*").alias("n")).withColumn("kind", F.lit(name)) for name, df in held)
    return one.unionByName(two)


def cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-term scores under two weights, each asked for twice: built once and read once. Ranks depend on no weights, so both are built from the same pillars."""
    at = place(spark, "scores")
    weights = {"default": scoring.MODES["longterm"]["weights"], "even": {"quality": 1, "trend": 1}}

    @cache
    def ranked() -> DataFrame:
        """Written when the first table that is not there yet asks for it."""
        return stored(scoring.pillared(scores.features(spark, sf_dir)).select("symbol", *[f"p_{p}" for p in scoring.PILLARS]))

    def table(name: str) -> DataFrame:
        w = weights[name]
        return cached(spark, at, {"day": scores.ASOF, "weights": w}, lambda: ranked().select("symbol", scoring.composite("longterm", w)[0].alias("score_longterm"), F.lit(name).alias("weights")))

    first = [table(n) for n in weights]
    return rounded(table("default").unionByName(table("even")).intersectAll(first[0].unionByName(first[1])))


QUERIES = {
    "st3_fresh_gate": gate, "snk8_cached_scores": cached_scores,
    "src2_csv": csv_bars, "src3_headers": header_rows, "src7_documents": documents, "src12_patch": patched, "snk1_top_up": topped_up, "t3_stale": outdated,
    "p14_stocks": stocks, "p15_benchmark": index_line, "p16_lenders": lenders, "s13_aliases": resolved,
}

_SYM = "'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')"
_NAMED = f"c AS (SELECT {_SYM} AS symbol, r_name AS sector, s_suppkey AS key, CASE WHEN s_suppkey % 9 <> 4 THEN (s_suppkey % 70) / 100.0 END AS promoter FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"

_EVEN = given.composite("longterm", {"quality": 1, "trend": 1})

ORACLES = {
    "st3_fresh_gate": f"WITH {BARS}, l AS (SELECT max(date) AS last FROM bars), b AS (SELECT symbol, max(date) AS d, count(*) AS n FROM bars GROUP BY 1) SELECT 'fresh' AS kind, symbol, d AS through, n FROM b UNION ALL SELECT 'patched', symbol, last, CASE WHEN d < last THEN n + 1 ELSE n END FROM b, l",
    "snk8_cached_scores": f"WITH {scores.SCORED}, e AS (SELECT symbol, {_EVEN} FROM feats LEFT JOIN pil USING (symbol)) SELECT symbol, 'default' AS weights, round(score_longterm, 6) AS score_longterm FROM scored UNION ALL SELECT symbol, 'even', round(score_longterm, 6) FROM e",
    "src2_csv": f"WITH {BARS} SELECT symbol, date, round(close, 4) AS close, round(volume, 4) AS volume FROM bars",
    "src3_headers": f"WITH {_NAMED} SELECT symbol, sector FROM c",
    "src7_documents": f"WITH {_NAMED} SELECT symbol, sector, CAST(promoter AS DOUBLE) AS promoter FROM c",
    "src12_patch": f"WITH {BARS} SELECT symbol, date, round(CASE WHEN CAST(substr(symbol, 2) AS INT) % 2 = 0 AND date = (SELECT max(date) FROM bars) THEN close * 1.01 ELSE close END, 6) AS close FROM bars WHERE NOT (CAST(substr(symbol, 2) AS INT) % 2 = 0 AND date = (SELECT max(date) FROM bars)) OR symbol IN (SELECT symbol FROM bars WHERE date < (SELECT max(date) FROM bars))",
    "snk1_top_up": f"WITH {BARS} SELECT symbol, date, round(CASE WHEN date >= DATE '1998-01-01' THEN close * 1.02 ELSE close END, 6) AS close FROM bars",
    "t3_stale": f"SELECT * FROM (SELECT {_SYM} AS symbol, CAST(DATE '2000-01-01' + CAST(s_suppkey % 60 AS INT) AS DATE) AS fetched, s_suppkey % 9 = 0 AS empty FROM supplier) WHERE empty OR DATE '2000-02-15' - fetched > 30 ORDER BY fetched, symbol LIMIT 80",
    "p14_stocks": f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol",
    "p15_benchmark": f"WITH {BARS}, m AS (SELECT date, max(close) AS c FROM bars WHERE day(date) % 5 <> 0 GROUP BY date) SELECT date, round(last_value(c IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS bench FROM (SELECT DISTINCT date FROM bars) LEFT JOIN m USING (date)",
    "p16_lenders": f"SELECT {_SYM} AS symbol, s_suppkey % 6 IN (0, 3, 4) AS lender FROM supplier",
    "s13_aliases": "SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS symbol, make_date(year(l_shipdate), 12, 31) AS period_end, round(sum(l_extendedprice) * CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END, 4) AS rev FROM lineitem GROUP BY l_suppkey, 2",
}
