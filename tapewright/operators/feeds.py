"""Filed results, append-only feeds and JSON: merges, dedup on natural keys, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import growth
from ..functions.stored import stored


def upsert(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the first by ``order``: a fresh row beats the archive's, a later ingest an earlier one."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def append_new(archive: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Archive and those fresh rows whose key it does not have yet; of fresh rows with one key one stays."""
    new = fresh.dropDuplicates(keys).join(archive.select(*keys).distinct(), keys, "left_anti")
    return archive.unionByName(new, allowMissingColumns=True)


def year_ago(filed: DataFrame) -> DataFrame:
    """symbol, period_end, pat, pat_yoy, sales_yoy: each symbol's newest filing against the newest one 354 to 376 days before it.

    The join is on symbol with a date range, so a symbol's few filings meet only each other.
    """
    newest = filed.groupBy("symbol").agg(F.max_by(F.struct("period_end", "pat", "sales"), "period_end").alias("l")).select("symbol", "l.*")
    then = filed.select("symbol", F.col("period_end").alias("then"), F.col("pat").alias("pat0"), F.col("sales").alias("sales0"))
    cond = (newest["symbol"] == then["symbol"]) & F.col("then").between(F.date_sub("period_end", 376), F.date_sub("period_end", 354))
    joined = newest.join(then, cond, "left").groupBy(newest["symbol"], "period_end", "pat", "sales").agg(F.max_by(F.struct("pat0", "sales0"), "then").alias("a"))
    return joined.select("symbol", "period_end", "pat", growth(F.col("pat"), F.col("a.pat0")).alias("pat_yoy"), growth(F.col("sales"), F.col("a.sales0")).alias("sales_yoy"))


def cross_check(filed: DataFrame, vendor: DataFrame, least: float = 5.0) -> DataFrame:
    """Filed profit against the vendor's for the same quarter: rows where both exceed ``least`` and the ratio is above 5 or below 0.2."""
    d = filed.join(vendor, ["symbol", "period_end"])
    return d.withColumn("ratio", F.col("pat") / F.col("vendor_pat")).where((F.abs("pat") > least) & (F.abs("vendor_pat") > least) & ((F.col("ratio") > 5) | (F.col("ratio") < 0.2)))


def unwrap(payload: Column) -> Column:
    """The rows of a JSON document as a variant: under resCmpData, data, rows or results, or the document itself."""
    v = F.try_parse_json(payload)
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("resCmpData", "data", "rows", "results")], v)


def pick(row: dict[str, Column], names: list[str]) -> Column:
    """The first of the named fields that has a value, blanks and dashes being none; names match in any case."""
    known = {k.lower(): c for k, c in row.items()}
    found = [known[n.lower()] for n in names if n.lower() in known]
    return F.coalesce(*[F.nullif(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("-")) for c in found]) if found else F.lit(None).cast("string")


def walk(docs: DataFrame, payload: str) -> DataFrame:
    """Every member of every object and element of every array of JSON documents: the other columns of ``docs``, depth, key (null in arrays), value (variant).

    One level after another, each written before the next is read off it, so a level is computed once and its size, not
    the depth of the tree, bounds a plan. Text inside strings is no part of the tree. Documents that are null or no JSON
    have no members.
    """
    keys = [c for c in docs.columns if c != payload]
    level = docs.select(*keys, F.lit(0).alias("depth"), F.try_parse_json(payload).alias("_v")).where("_v is not null")
    spark, out = docs.sparkSession, []
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        found = stored(inner.select(*keys, (F.col("depth") + 1).alias("depth"), "key", "value"))
        out.append(found)
        nested = found.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<"))
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level = nested.select(*keys, "depth", F.col("value").alias("_v"))


def harvest(docs: DataFrame, payload: str) -> DataFrame:
    """Every non-empty symbol anywhere in JSON documents, with the other columns of ``docs``; texts and numbers count."""
    keys = [c for c in docs.columns if c != payload]
    found = walk(docs, payload).where((F.col("key") == "symbol") & ~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<"))
    return found.select(*keys, F.try_variant_get("value", "$", "string").alias("symbol")).where("symbol not in ('', '0', 'false')")


def key_inventory(payload: DataFrame, column: str) -> DataFrame:
    """Distinct keys of JSON objects, with how often each occurs."""
    keys = payload.select(F.explode(F.json_object_keys(column)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def freshness(bars: DataFrame, expected: Column) -> DataFrame:
    """prices_through, covered, n_symbols: the newest date, and the share of symbols that have the expected session."""
    newest = bars.groupBy("symbol").agg(F.max("date").alias("d"))
    return newest.agg(F.max("d").alias("prices_through"), F.avg((F.col("d") >= expected).cast("double")).alias("covered"), F.count("*").alias("n_symbols")).withColumn("fresh", F.col("covered") >= 0.6)


def expected_session(now: Column) -> Column:
    """The last session that should be on file at an instant (UTC): the day before 16:00 in India, rolled back to a weekday."""
    local = F.from_utc_timestamp(now, "Asia/Kolkata")
    day = F.to_date(F.when(F.hour(local) < 16, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local)))
    return F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))


def futures(contracts: DataFrame) -> DataFrame:
    """symbol, date, oi, vol, close: open interest and volume over all expiries, the close of the nearest one."""
    return contracts.groupBy("symbol", "date").agg(F.sum("oi").alias("oi"), F.sum("vol").alias("vol"), F.min_by("close", "expiry").alias("close"))


def trading_days(last: Column, n: int) -> Column:
    """The n newest weekdays up to a day, newest first."""
    days = F.sequence(F.date_sub(last, 2 * n + 7), last)
    return F.slice(F.reverse(F.filter(days, lambda d: F.weekday(d) < 5)), 1, n)


def shard(symbol: Column, n: int = 8) -> Column:
    """Shard number by the last hex digits of md5."""
    return (F.conv(F.right(F.md5(symbol.cast("binary")), F.lit(8)), 16, 10).cast("long") % n).cast("int")
