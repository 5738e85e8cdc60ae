"""Queries of the exchange's and the vendor's feeds, from responses that are derived from the driver's tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number, rounded
from ..functions.dates import day_of, written
from ..functions.stored import shared_folder
from ..operators import feeds as N
from ..operators import sessions as G
from ..sources import archives, exchange, panels, readers, sinks
from ..streaming import feeds as S
from .sql import BARS, TICKS, WEEKLY

LONG = " of a kind that is told at such length that the key of the feed does not take all of it"
#: The day at which the stream of responses is stopped and started again.
STOP = "2024-01-16"


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panels.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("day", F.to_date("ts")).withColumn("symbol", F.concat(F.lit("U"), "user_id"))


def rolled(e: DataFrame) -> DataFrame:
    """Feeds show a row on its day and on the next one."""
    return e.withColumn("fetched", F.explode(F.array("day", F.date_add("day", 1))))


_DAY = "upper(date_format(day, 'dd-MMM-yyyy'))"
#: A feed's rows as SQL over the events.
ROWS = {
    "announcements": {"symbol": "symbol", "an_dt": "date_format(ts, 'dd-MMM-yyyy HH:mm:ss')", "desc": f"event_type || '{LONG}'", "attchmntText": "event_type"},
    "insider": {"symbol": "symbol", "intimDt": f"{_DAY} || ' 10:30'", "acqName": "' P' || event_id", "secAcq": "format_number(event_id * 1000, 0)", "secVal": "'-'", "tdpTransactionType": "event_type"},
    "deals": {"symbol": "symbol", "date": _DAY, "clientName": "'C' || event_id", "buySell": "'BUY'", "qty": "event_id + 1", "watp": "value"},
    "events": {"symbol": "symbol", "date": _DAY, "purpose": f"event_type || '{LONG}'", "bm_desc": "' '"},
}


def responses(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, body: a response a day, as the feed words it."""
    rows = rolled(events(spark, sf_dir)).select("fetched", F.struct(*[F.expr(v).alias(k) for k, v in ROWS[name].items()]).alias("row"), (F.col("event_id") % 3).alias("list"))
    day = F.col("fetched").alias("day")
    if name == "deals":
        of = lambda k: F.collect_list(F.when(F.col("list") == k, F.col("row")))
        return rows.groupBy(day).agg(F.to_json(F.struct(of(0).alias("BULK_DEALS_DATA"), of(1).alias("BLOCK_DEALS_DATA"), of(2).alias("SHORT_DEALS_DATA"))).alias("body"))
    listed = F.to_json(F.collect_list("row"))
    wrapped = {"announcements": F.concat(F.lit('{"rows":'), listed, F.lit("}")), "insider": F.concat(F.lit('{"data":'), listed, F.lit("}")), "events": listed}[name]
    return rows.groupBy(day).agg(wrapped.alias("body"))


def in_two_runs(name: str, drops: DataFrame, spark: SparkSession) -> DataFrame:
    """The feed's table after a stream over the responses up to STOP, and one that goes on after it, which meets some of them again."""
    at = place(spark, name)
    for part in (drops.where(F.col("day") <= STOP), drops.where(F.col("day") >= F.date_sub(F.lit(STOP).cast("date"), 3))):
        part.write.mode("append").parquet(f"{at}/in")
        out = S.feed_table(S.stream(spark, f"{at}/in", drops.schema), name, at)
    return out


def daily_feed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_two_runs(name, responses(name, spark, sf_dir), spark)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response a symbol and day: the quarters' shares, the newest of which is told differently every day."""
    e = events(spark, sf_dir).select("symbol", "user_id", "day").distinct()
    row = lambda q, pct: F.struct(F.lit(q).alias("date"), pct.cast("string").alias("pr_and_prgrp"), (100 - pct).cast("string").alias("public_val"), F.lit("-").alias("submissionDate"))
    rows = F.array(row("31-MAR-2024", F.dayofmonth("day") + 20.5), row("31-DEC-2023", F.col("user_id") % 50 + 0.25))
    drops = e.select("day", F.to_json(F.struct("symbol", F.struct(rows.alias("data")).alias("data"))).alias("body"))
    return in_two_runs("shareholding", drops, spark)


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response a symbol and quarter, with a bar that is no number."""
    b = panels.bars(spark, sf_dir).withColumn("fetched", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)))
    row = F.struct("symbol", F.col("date").cast("string").alias("date"), F.lit("NaN").alias("open"), "high", "low", "close", "volume")
    drops = b.groupBy("symbol", F.col("fetched").alias("day")).agg(F.concat(F.lit('{"bars":'), F.to_json(F.collect_list(row)), F.lit("}")).alias("body"))
    return rounded(exchange.parse(drops.select("body"), "bars").select("symbol", "day", "open", "close", "volume"), 4)


def vendor_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a company, with annual revenue and profit."""
    a = panels.periods(spark, sf_dir, False).select("symbol", F.col("period_end").cast("string").alias("d"), "rev", "ni")
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("d", F.col(c))))
    c = a.groupBy("symbol").agg(F.to_json(F.struct(F.first("symbol").alias("symbol"), F.lit("2001-12-31").alias("fetched"), F.create_map(F.lit("Total Revenue"), entries("rev"), F.lit("Net Income"), entries("ni")).alias("inc_a"))).alias("body"))
    return rounded(exchange.statements(c), 5)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveillance lists: symbols at several depths, beside texts that only look like them."""
    e = events(spark, sf_dir)
    doc = F.format_string('{"asm":{"longterm":{"data":[{"symbol":"%s","note":"say \\"symbol\\": \\"fake\\" once"}]}},"gsm":[[{"deep":{"symbol":" %s "}}]],"symbol":""}', "symbol", "event_type")
    return exchange.surveillance(e.select(doc.alias("body")).distinct())


def harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's document with symbols in objects, arrays and escaped texts, one in forty broken."""
    e = panels.table(spark, sf_dir, "events")
    doc = F.format_string('{"data":[{"symbol":"U%d","note":"-"},{"x":{"symbol":"%s","said":"the \\"symbol\\": \\"none\\""}}],"symbol":"","n":{"symbol":%d}}', "user_id", "event_type", F.col("event_id") % 4)
    return N.harvest(e.select("event_id", F.when(F.col("event_id") % 40 == 3, F.left(doc, F.char_length(doc) - 1)).otherwise(doc).alias("doc")), "doc")


def packed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a zip archive a year, with a CSV a month."""
    import pyarrow as pa

    b = panels.bars(spark, sf_dir).select(F.year("date").alias("y"), F.date_format("date", "MM").alias("m"), "symbol", F.col("date").cast("string").alias("date"), F.round("close", 4).alias("close"))
    lines = b.groupBy("y", "m").agg(F.concat(F.lit("TckrSymb , TradDt,ClsPric\n"), F.array_join(F.collect_list(F.concat_ws(",", "symbol", "date", F.col("close").cast("string"))), "\n")).alias("text"))

    def run(table):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, text in zip(table["m"].to_pylist(), table["text"].to_pylist(), strict=True):
                z.writestr(f"bars_{m}.csv", text, zipfile.ZIP_STORED if m == "06" else None)
        return pa.table({"path": [f"{table['y'][0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    return lines.groupBy("y").applyInArrow(run, "path string, content binary")


def from_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.zipped_csv(packed_years(spark, sf_dir), ["TckrSymb", "TradDt", "ClsPric", "none"])
    return rows.select("file", "member", F.col("TckrSymb").alias("symbol"), day_of(F.col("TradDt")).alias("date"), F.col("ClsPric").try_cast("double").alias("close"), "none")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content: gzip-less bundles of a hundred companies each."""
    a = panels.periods(spark, sf_dir, False).select("symbol", "key", F.col("period_end").cast("string").alias("d"), "rev")
    c = a.groupBy("symbol", "key").agg(F.map_from_entries(F.collect_list(F.struct("d", "rev"))).alias("v"))
    company = F.struct(F.create_map(F.lit("say"), F.lit('a "quoted" } brace')).alias("info"), F.create_map(F.lit("Total Revenue"), F.col("v")).alias("inc_a"))
    share = F.struct("symbol", F.concat(F.lit("Company "), "key").alias("name"), (F.col("key") * 1e7).alias("mcap"))
    doc = F.struct(F.lit("2001-12-31").alias("built"), F.lit(1000.0).alias("mcap_floor_cr"), F.collect_list(share).alias("universe"), F.map_from_entries(F.collect_list(F.struct("symbol", company))).alias("fundamentals"))
    return c.groupBy(F.floor(F.col("key") / 100)).agg(F.to_json(doc).cast("binary").alias("content")).select("content")


def from_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.bundle_records(bundles(spark, sf_dir))
    lines, names = archives.bundle_lines(records), archives.bundle_universe(records)
    return rounded(lines.join(names.select("symbol", "name", "mcap"), "symbol"), 2)


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as ten feeds would write them, and what is no day."""
    o = panels.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    d = F.col("d")
    forms = [d.cast("string"), written(d, "d-MMM-yyyy"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "d/M/yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyyMMdd"), F.concat(F.lower(F.date_format(d, "dd-MMM-yyyy")), F.lit(" 15:30:00")), F.concat(d.cast("string"), F.lit("T09:15:00")), F.lit("31-02-2024"), F.lit("soon")]
    text = F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int"))
    return o.select("o_orderkey", day_of(text).alias("day"))


def cash_and_interest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Closes without some bars, and open interest without others, on days and of symbols that the cash market has not, and twice."""
    p = panels.weekly(spark, sf_dir).select("symbol", "date", "close", "oi")
    b = F.substring("symbol", 7, 2).cast("int")
    cash = p.where((F.dayofmonth("date") % 7 != 3) & (b % 10 != 5)).select("symbol", "date", "close").where(F.month("date") != 2)
    oi = p.where(F.dayofmonth("date") % 5 != 2).select("symbol", "date", "oi")
    return cash, oi.unionByName(oi.where(b % 3 == 0).withColumn("oi", F.col("oi") + 10))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.number_sessions(G.onto_cash(*cash_and_interest(spark, sf_dir), ["oi"]))
    return rounded(d.select("symbol", "date", "close", "oi", G.change("oi", 5).alias("oi5")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange file of which only one series counts, with prices that are no numbers."""
    c = panels.companies(spark, sf_dir)
    k = F.col("key").cast("int")
    frame = c.select(F.lit("2001-01-02").cast("date").alias("file_date"), F.concat("symbol", F.lit(" ")).alias("SYMBOL"), F.get(F.array(F.lit(" EQ"), F.lit("BE"), F.lit("GS ")), k % 3).alias("SERIES"), F.when(k % 5 == 0, F.lit(" - ")).otherwise(k.cast("string")).alias("CLOSE_PRICE"), k.cast("string").alias("TTL_TRD_QNTY"), F.lit("x").alias("DELIV_QTY"), F.concat(F.lit(" "), (k % 100).cast("string")).alias("DELIV_PER"))
    return readers.bhavcopy(frame, ("EQ", "BE"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key").cast("int")
    frame = panels.companies(spark, sf_dir).select("symbol", F.get(F.array(F.lit("STF"), F.lit("IDF "), F.lit("STO"), F.lit("IDO")), k % 4).alias("FinInstrmTp"))
    return readers.derivatives(frame).select("symbol", F.trim("FinInstrmTp").alias("kind"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes some of which are no numbers or endless: these are null, and rows that then lack one are dropped."""
    b = panels.bars(spark, sf_dir)
    d = F.dayofmonth("date")
    odd = F.when(d == 1, F.lit(float("nan"))).when(d == 2, F.lit(float("inf"))).when(d == 3, F.lit(float("-inf"))).otherwise(F.col("close"))
    return rounded(b.select("symbol", "date", number(odd).alias("close")).dropna(subset=["close"]))


def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.newest(panels.bars(spark, sf_dir).select("symbol", "date"), 30, "date")


def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document a company and file, one in seven of them broken."""
    at = place(spark, "folder")
    c = panels.companies(spark, sf_dir)
    doc = sinks.document(c.select("symbol", "sector", "key"), "value").withColumn("k", F.get_json_object("value", "$.key").cast("long"))
    sinks.json_folder(doc.select(F.when(F.col("k") % 7 == 2, F.lit('{"symbol": "broken')).otherwise(F.col("value")).alias("value")), at)
    return readers.json_folder(spark, at, "symbol string, sector string, key long").drop("file_symbol")


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a source that is missing, one with too few rows and one that is whole."""
    whole = panels.companies(spark, sf_dir).select("symbol", "sector")
    return readers.first_that_works([lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet"), lambda: whole.limit(3), lambda: whole], 10)


def through(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = place(spark, "marker")
    sinks.csv(sinks.marker(panels.bars(spark, sf_dir)), at)
    return spark.read.schema("prices_through date").option("header", True).csv(at)


QUERIES = {f"src11_{n}": partial(daily_feed, n) for n in ROWS} | {
    "src11_shareholding": holdings, "src11_surveillance": lists, "src9_bars": vendor_bars, "src9_statements": vendor_statements, "src_harvest": harvested, "src8_members": from_zip, "src1_bundle": from_bundles,
    "fn_dates": dates, "j09_open_interest": open_interest, "p01_series": series, "p02_contracts": contracts, "p05_numbers": numbers, "t04_sessions": last_sessions, "src6_folder": folder, "src13_fallback": fallback, "snk9_marker": through,
}

# --- SQL

_E = "e AS (SELECT *, 'U' || user_id AS symbol, CAST(ts AS DATE) AS day FROM events)"
_SYM = "'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')"
_KEY = " of a kind that is told at such length that the key of the feed does not take all of it"
_SECTOR = f"c AS (SELECT {_SYM} AS symbol, r_name AS sector, s_suppkey AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"

ORACLES = {
    "src11_announcements": f"WITH {_E} SELECT DISTINCT day AS fetched, symbol, strftime(ts, '%d-%b-%Y %H:%M:%S') AS \"at\", left(event_type || '{_KEY}', 60) AS subject, event_type AS details, CAST(NULL AS VARCHAR) AS file FROM e",
    "src11_insider": f"WITH {_E} SELECT day AS fetched, symbol, upper(strftime(day, '%d-%b-%Y')) || ' 10:30' AS at, day, 'P' || event_id AS person, CAST(event_id * 1000 AS DOUBLE) AS shares, CAST(NULL AS DOUBLE) AS value, event_type AS kind, CAST(NULL AS VARCHAR) AS category FROM e",
    "src11_deals": f"WITH {_E} SELECT day AS fetched, CASE event_id % 3 WHEN 0 THEN 'bulk' WHEN 1 THEN 'block' ELSE 'short' END AS tag, symbol, day, 'C' || event_id AS client, 'BUY' AS side, CAST(event_id + 1 AS DOUBLE) AS qty, value AS price FROM e",
    "src11_events": f"WITH {_E} SELECT DISTINCT day AS fetched, symbol, day, left(event_type || '{_KEY}', 40) AS purpose, CAST(NULL AS VARCHAR) AS details FROM e",
    "src11_shareholding": f"WITH {_E}, z AS (SELECT symbol, any_value(user_id) AS u, max(day) AS fetched FROM e GROUP BY 1) SELECT fetched, symbol, DATE '2024-03-31' AS day, CAST(day(fetched) + 20.5 AS DOUBLE) AS promoter_pct, CAST(79.5 - day(fetched) AS DOUBLE) AS public_pct, CAST(NULL AS VARCHAR) AS submitted FROM z UNION ALL SELECT fetched, symbol, DATE '2023-12-31', CAST(u % 50 + 0.25 AS DOUBLE), CAST(99.75 - u % 50 AS DOUBLE), NULL FROM z",
    "src11_surveillance": f"WITH {_E} SELECT symbol FROM e UNION SELECT event_type FROM e",
    "src9_bars": f"WITH {BARS} SELECT symbol, date AS day, CAST(NULL AS DOUBLE) AS open, round(close, 4) AS close, round(volume, 4) AS volume FROM bars",
    "src9_statements": f"WITH {TICKS}, a AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS symbol, make_date(year(day), 12, 31) AS period_end, sum(l_extendedprice) AS rev, sum(l_extendedprice * (0.12 - 2 * l_discount)) AS ni FROM ticks GROUP BY l_suppkey, year(day)) SELECT symbol, DATE '2001-12-31' AS fetched, 'inc_a' AS stmt, 'Total Revenue' AS item, period_end, round(rev, 5) AS value FROM a UNION ALL SELECT symbol, DATE '2001-12-31', 'inc_a', 'Net Income', period_end, round(ni, 5) FROM a",
    "src_harvest": "WITH z AS (SELECT * FROM events WHERE event_id % 40 <> 3) SELECT event_id, 'U' || user_id AS symbol FROM z UNION ALL SELECT event_id, event_type FROM z UNION ALL SELECT event_id, CAST(event_id % 4 AS VARCHAR) FROM z WHERE event_id % 4 > 0",
    "src8_members": f"WITH {BARS} SELECT year(date) || '.zip' AS file, 'bars_' || strftime(date, '%m') || '.csv' AS member, symbol, date, round(close, 4) AS close, CAST(NULL AS VARCHAR) AS none FROM bars",
    "src1_bundle": f"WITH {TICKS} SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS symbol, 'inc_a' AS stmt, 'Total Revenue' AS item, make_date(year(day), 12, 31) AS period_end, round(sum(l_extendedprice), 2) AS value, 'Company ' || l_suppkey AS name, l_suppkey * 1e7 AS mcap FROM ticks GROUP BY l_suppkey, year(day)",
    "fn_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 9 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "j09_open_interest": f"WITH {WEEKLY}, p AS (SELECT symbol, date, close, oi, CAST(substr(symbol, 7, 2) AS INT) AS b FROM weekly), c AS (SELECT symbol, date, close FROM p WHERE day(date) % 7 <> 3 AND b % 10 <> 5 AND month(date) <> 2), o AS (SELECT symbol, date, avg(oi) AS oi FROM (SELECT symbol, date, oi FROM p WHERE day(date) % 5 <> 2 UNION ALL SELECT symbol, date, oi + 10 FROM p WHERE day(date) % 5 <> 2 AND b % 3 = 0) GROUP BY 1, 2), k AS (SELECT * FROM o WHERE date IN (SELECT date FROM c) AND symbol IN (SELECT symbol FROM c)), j AS (SELECT symbol, date, close, oi FROM c FULL JOIN k USING (symbol, date)), n AS (SELECT j.*, no FROM j JOIN (SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM c)) USING (date)) SELECT a.symbol, a.date, round(a.close, 6) AS close, round(a.oi, 6) AS oi, round(CASE WHEN b.oi <> 0 THEN a.oi / b.oi - 1 END, 6) + 0.0 AS oi5 FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.no = a.no - 5",
    "p01_series": f"SELECT DATE '2001-01-02' AS file_date, {_SYM} AS symbol, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS close, CAST(s_suppkey AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS deliv_qty, CAST(s_suppkey % 100 AS DOUBLE) AS deliv_per FROM supplier WHERE s_suppkey % 3 < 2",
    "p02_contracts": f"SELECT {_SYM} AS symbol, CASE s_suppkey % 4 WHEN 0 THEN 'STF' ELSE 'IDF' END AS kind FROM supplier WHERE s_suppkey % 4 < 2",
    "p05_numbers": f"WITH {BARS} SELECT symbol, date, round(close, 6) AS close FROM bars WHERE day(date) > 3",
    "t04_sessions": f"WITH {BARS} SELECT date, symbol FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 30)",
    "src6_folder": f"WITH {_SECTOR} SELECT * FROM c WHERE key % 7 <> 2",
    "src13_fallback": f"WITH {_SECTOR} SELECT symbol, sector FROM c",
    "snk9_marker": f"WITH {BARS} SELECT max(date) AS prices_through FROM bars",
}
