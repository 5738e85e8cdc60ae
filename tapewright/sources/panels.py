"""Equity panels derived from order lines: bars, weekly sessions, delivery, open interest, companies and statements.

Each is a deterministic view over the driver's tables, so that queries and their SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key: Column) -> Column:
    """The key in five digits, or as many as it has: cut to five, those from 100,000 on would be several companies' symbol."""
    digits = key.cast("string")
    return F.concat(F.lit("S"), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), "0"))


def ticks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Order lines as trades, with a tie-break ``ord`` unique within a symbol's session."""
    lines = table(spark, sf_dir, "lineitem")
    ord_ = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")
    return lines.select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("day"), (2500 + F.col("l_extendedprice") / 100).alias("px"), "l_quantity", ord_.alias("ord"), *more)


def ohlc() -> list[Column]:
    return [F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ord").alias("close")]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: one row a supplier and ship day.

    Lines are dealt out by supplier once; both this aggregation and the windows by symbol above it use that partitioning.
    """
    by = symbol(F.col("l_suppkey"))  # lines travel without it
    one = ticks(spark, sf_dir).repartition(by).groupBy(by.alias("symbol"), "l_suppkey", F.col("day").alias("date")).agg(*ohlc(), F.sum("l_quantity").alias("q"))
    return one.select("symbol", "date", "open", "high", "low", "close", (F.col("q") * 10000 * (F.col("l_suppkey") % 10) / 10).alias("volume"))


def bench(panel: DataFrame) -> DataFrame:
    """date, bench: the index level is the mean close of all symbols. One row a session, so its size is bounded by the calendar."""
    return panel.groupBy("date").agg(F.avg("close").alias("bench"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), date (week), OHLC, qty, deliv_per, oi: a dense panel of sessions."""
    lines = ticks(spark, sf_dir, "l_returnflag", "l_linestatus").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")), "l_partkey")
    q = F.col("l_quantity")
    return lines.groupBy("symbol", F.trunc("day", "week").alias("date")).agg(*ohlc(), F.sum(q).alias("qty"), (100 * F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)) / F.sum(q)).alias("deliv_per"), F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(0.0)).alias("oi"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, industry, lender, shares and the facts that vendors give beside statements."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    bal, key = F.abs("s_acctbal"), F.col("s_suppkey")
    some = lambda m, r, x: F.when(key % m != r, x)
    return joined.select(
        symbol(key).alias("symbol"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), (F.col("r_name") == "EUROPE").alias("lender"), key.alias("key"),
        (1e6 + 100 * bal).alias("shares"), (bal * 1000).alias("debt_base"), some(9, 4, (key % 70) / 100).alias("promoter"), some(8, 6, (key % 37) / 100).alias("institutions"),
        some(6, 2, 5.0 + key % 90).alias("trailing_pe"), some(5, 1, (key % 40) / 10.0).alias("dividend_rate"), some(4, 3, 100.0 + key % 60).alias("current_price"), some(7, 5, (key % 9) / 10.0).alias("dividend_yield"),
        some(3, 2, 90.0 + key % 80).alias("target_price"), (key % 30).cast("double").alias("analysts"), (0.5 + (key % 11) / 10.0).alias("beta"), F.when(key % 10 == 7, 80.0).otherwise(1.0).alias("book_fx"),
        some(5, 2, 4.0 + key % 60).alias("forward_pe"), some(6, 1, F.element_at(F.array(F.lit("buy"), F.lit("hold"), F.lit("sell")), (key % 3 + 1).cast("int"))).alias("recommended"),
        F.when(key % 2 == 0, (key % 50) / 100).alias("promoter_held"), F.when(key % 3 == 0, (key % 45) / 100).alias("institutions_held"),
    )


def share_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, shares: the count at two days, for two companies of three."""
    c = companies(spark, sf_dir).where("key % 3 <> 1")
    one = lambda day, share: c.select("symbol", F.lit(day).cast("date").alias("day"), (F.col("shares") * share).alias("shares"))
    return one("1995-06-30", 1 - 0.04 * (F.col("key") % 8)).unionByName(one("2000-06-30", F.lit(1.0)))


#: What line items of a period are made of: sums over order lines.
SUMS = {
    "price": "l_extendedprice",
    "taxed": "l_extendedprice * l_tax",
    "off": "l_extendedprice * l_discount",
    "net": "l_extendedprice * (0.12 - 2 * l_discount)",
    "before_interest": "l_extendedprice * (0.15 - 2 * l_discount)",
    "before_wear": "l_extendedprice * (0.20 - 2 * l_discount)",
    "before_tax": "l_extendedprice * (0.14 - 2 * l_discount)",
    "flow": "l_extendedprice * (0.10 - l_discount)",
    "own": "l_extendedprice * (1.2 - l_tax)",
    "due": "l_extendedprice * (0.3 + l_tax)",
}
MADE = {
    "rev": "{price}", "ni": "{net}", "ebit": "{before_interest}", "ebitda": "{before_wear}", "intr": "{taxed} * 0.1", "pbt": "{before_tax}", "oth": "{taxed} * 0.3", "dep": "{price} * 0.03", "cfo": "{flow}",
    "capex": "-0.04 * {price}", "divp": "-0.02 * {price}", "recv": "{taxed}", "inv": "{off}", "ta": "3 * {price}", "eq": "{own}", "cash": "{off} * 0.5", "cur_a": "{price} * 0.6", "cur_l": "{due}",
}
#: Line items of a period and the sums they are.
ITEMS = {k: e.format(**{n: f"sum({x})" for n, x in SUMS.items()}) for k, e in MADE.items()}


def quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, key, period_end and ``SUMS``: one row a supplier and quarter. Years are put together from these, so order lines are read once for both."""
    by, end = symbol(F.col("l_suppkey")), F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    return ticks(spark, sf_dir, "l_extendedprice", "l_discount", "l_tax").repartition(by).groupBy(by.alias("symbol"), F.col("l_suppkey").alias("key"), end.alias("period_end")).agg(*[F.expr(f"sum({x})").alias(n) for n, x in SUMS.items()])


def periods(spark: SparkSession, sf_dir: str, quarterly: bool, quarters: DataFrame | None = None) -> DataFrame:
    """symbol, key, period_end and the line items, wide: one row a supplier and year (or quarter); some items are missing for some suppliers. ``quarters``: ``quarter_sums``, where they are at hand."""
    out = quarter_sums(spark, sf_dir) if quarters is None else quarters
    if not quarterly:
        year = F.make_date(F.year("period_end"), F.lit(12), F.lit(31))
        out = out.groupBy("symbol", "key", year.alias("period_end")).agg(*[F.sum(n).alias(n) for n in SUMS])
    out = out.select("symbol", "key", "period_end", *[F.expr(e.format(**{n: n for n in SUMS})).alias(k) for k, e in MADE.items()])
    out = out.withColumn("ebitda", F.when(F.col("key") % 11 != 5, F.col("ebitda")))
    if quarterly:
        return out.where((F.col("key") % 13 != 2) | (F.col("period_end") != F.lit("1999-06-30").cast("date")))
    c = companies(spark, sf_dir).select("symbol", "shares", "debt_base")
    age, key, rev = F.year("period_end") - 1995, F.col("key"), F.col("rev")
    return out.join(c, "symbol").withColumns({
        "debt": F.when(key % 7 != 3, F.col("debt_base") * (1 + 0.1 * (key % 6) * age)), "shares_a": F.col("shares") * (1 + 0.01 * (key % 5) * age),
        "gppe": F.col("ta") * (0.4 + 0.01 * (key % 8) * age), "nii": rev * (0.3 + 0.01 * (key % 4) * age), "prov": F.col("recv") * 0.5, "fcf": F.when(key % 2 == 1, F.col("cfo") + 0.9 * F.col("capex")),
    }).withColumn("eps", F.when(key % 10 != 9, F.col("ni") / F.col("shares_a"))).drop("shares", "debt_base")
