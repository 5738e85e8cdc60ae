"""Readers of the feeds' file formats. Schemas are given, so no pass infers them; unreadable parts become null rows that are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stored import stored
from ..operators.feeds import freshness

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
BUNDLE_SHARE = "struct<symbol:string,name:string,mcap:double,price:double,shares:double>"
BUNDLE_COMPANY = (
    "struct<info:map<string,string>, inc_a:map<string,map<string,double>>, inc_q:map<string,map<string,double>>, bs_a:map<string,map<string,double>>, bs_q:map<string,map<string,double>>, cf_a:map<string,map<string,double>>, cf_q:map<string,map<string,double>>, shares_hist:map<string,double>>"
)
BUNDLE = f"built string, mcap_floor_cr double, universe array<{BUNDLE_SHARE}>, fundamentals map<string, {BUNDLE_COMPANY}>"
STATEMENTS = ("inc_a", "inc_q", "bs_a", "bs_q", "cf_a", "cf_q")


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """A small (gzipped) JSON bundle in one row, with universe and fundamentals; ``archives.bundle_records`` cuts a large one into its records."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def universe(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.explode("universe").alias("u")).select("u.*")


def statement_lines(bundles: DataFrame) -> DataFrame:
    """symbol, stmt, item, period_end, value: all statements of a bundle, long."""
    company = bundles.select(F.explode("fundamentals").alias("symbol", "c"))
    each = F.array(*[F.struct(F.lit(s).alias("stmt"), F.col(f"c.{s}").alias("items")) for s in STATEMENTS])
    items = company.select("symbol", F.explode(each).alias("s")).select("symbol", "s.stmt", F.explode("s.items").alias("item", "values"))
    return items.select("symbol", "stmt", "item", F.explode("values").alias("d", "value")).select("symbol", "stmt", "item", F.try_to_date("d").alias("period_end"), "value")


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV, plain or gzipped, one file or a folder of shards."""
    return spark.read.schema(BARS).option("header", True).option("mode", "PERMISSIVE").csv(path)


def header_csv(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """CSV of text columns whose names and values come with stray blanks: names are trimmed and put in one case."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.toDF(*[c.strip().upper() if upper else c.strip().lower() for c in raw.columns])


def dated_files(frames: DataFrame, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Adds ``file_date``, read off each row's file name."""
    return frames.withColumn("file_date", F.try_to_date(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)))


def newest(frames: DataFrame, n: int, column: str = "file_date") -> DataFrame:
    """Rows of the n newest dates. The dates are one row each, so they join by broadcast."""
    dates = frames.select(column).distinct().withColumn("_k", F.row_number().over(Window.orderBy(F.desc(column)))).where(F.col("_k") <= n).select(column)
    return frames.join(F.broadcast(dates), column, "left_semi")


def bhavcopy(frames: DataFrame, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """date, symbol, close, qty, deliv_qty, deliv_per from exchange files read by ``header_csv``; what is no number is null."""
    num = lambda c: F.expr(f"try_cast(trim(`{c}`) AS double)")
    kept = frames.where(F.trim("SERIES").isin(*series))
    return kept.select("file_date", F.trim("SYMBOL").alias("symbol"), num("CLOSE_PRICE").alias("close"), num("TTL_TRD_QNTY").alias("qty"), num("DELIV_QTY").alias("deliv_qty"), num("DELIV_PER").alias("deliv_per"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that don't parse."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    read = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return read.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one a symbol; unreadable files are left out, and the symbol is the file's name."""
    read = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(path)
    return read.withColumn("file_symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json", 1))


def derivatives(contracts: DataFrame, kinds: tuple[str, ...] = ("STF", "IDF")) -> DataFrame:
    """Stock and index futures of a contracts file."""
    return contracts.where(F.trim("FinInstrmTp").isin(*kinds))


def first_that_works(readers: list, least: int = 500) -> DataFrame:
    """The first of several sources (functions without arguments) that reads and has ``least`` rows. A source is fetched once: what it gives is written before it is counted."""
    from pyspark.errors import PySparkException

    problems = []
    for read in readers:
        try:
            df = stored(read())
            if df.limit(least).count() >= least:
                return df
            problems.append("too few rows")
        except (PySparkException, OSError) as e:
            problems.append(str(e)[:100])
    raise ValueError("no source has enough rows: " + "; ".join(problems))


def patch(bars: DataFrame, extra: DataFrame, expected: Column) -> DataFrame:
    """Bars with the exchange's rows for symbols that lack the expected session; of rows for one symbol and day the patch wins."""
    have = bars.where(F.col("date") == expected).select("symbol").distinct()
    fill = extra.where(F.col("date") == expected).join(have, "symbol", "left_anti").join(bars.select("symbol").distinct(), "symbol", "left_semi")
    return bars.unionByName(fill, allowMissingColumns=True)


def fresh_bars(fetch: Callable[[], DataFrame], extra: Callable[[], DataFrame], expected: Column) -> DataFrame:
    """Bars that most symbols have the expected session in: fetched once more (and written, so that no fetch is done twice) where they are not fresh, and filled from the exchange's rows where they still are not."""
    for _ in range(2):
        bars = stored(fetch())
        if freshness(bars, expected).where("fresh").count():
            return bars
    return patch(bars, extra(), expected)


def top_up(old: DataFrame, tail: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """History with a newer tail: of rows with one key the tail's stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(tail.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def stale(records: DataFrame, now: Column, days: int = 30, most: int = 80) -> DataFrame:
    """The records to fetch again: empty ones and those older than ``days``, the oldest first, ``most`` of them. ``records``: symbol, fetched, empty."""
    old = F.coalesce(F.datediff(now, "fetched") > days, F.lit(True)) | F.coalesce("empty", F.lit(False))
    return records.where(old).orderBy(F.col("fetched").asc_nulls_first(), "symbol").limit(most)
