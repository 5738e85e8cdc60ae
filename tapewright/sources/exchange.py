"""The exchange's and the vendor's feeds as typed tables: what a response holds, and which row is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_of
from ..operators.feeds import walk


@dataclass(frozen=True)
class Feed:
    """``places``: where a response has its rows, the first that is there ("$" is the response itself), or all of them with a tag each.
    ``fields``: column -> (names in a row, the first with a value counts; kind). ``keys``: what makes a row new. ``last``: whether a later row replaces it."""

    places: tuple[str, ...]
    fields: dict[str, tuple[tuple[str, ...], str]]
    keys: tuple[str, ...]
    tags: tuple[str, ...] = ()
    last: bool = False


# Field names of the feeds, and the keys by which rows are told apart.
FEEDS = {
    "announcements": Feed(("$", "$.rows", "$.data"), {"symbol": (("symbol",), "text"), "at": (("an_dt", "sort_date"), "text"), "subject": (("desc", "subject"), "head60"), "details": (("attchmntText",), "text"), "file": (("attchmntFile",), "text")}, ("symbol", "at", "subject")),
    "insider": Feed(("$.data", "$"), {"symbol": (("symbol",), "text"), "at": (("date", "intimDt"), "text"), "day": (("date", "intimDt"), "day"), "person": (("acqName",), "text"), "shares": (("secAcq",), "number"), "value": (("secVal",), "number"), "kind": (("tdpTransactionType",), "text"), "category": (("personCategory",), "text")}, ("symbol", "at", "person", "shares")),
    "deals": Feed(("$.BULK_DEALS_DATA", "$.BLOCK_DEALS_DATA", "$.SHORT_DEALS_DATA"), {"symbol": (("symbol",), "text"), "day": (("date",), "day"), "client": (("clientName",), "text"), "side": (("buySell",), "text"), "qty": (("qty",), "number"), "price": (("watp",), "number")}, ("symbol", "day", "client", "qty", "tag"), ("bulk", "block", "short")),
    "events": Feed(("$", "$.data"), {"symbol": (("symbol",), "text"), "day": (("date",), "day"), "purpose": (("purpose",), "head40"), "details": (("bm_desc",), "text")}, ("symbol", "day", "purpose")),
    "shareholding": Feed(("$.data.data", "$.data"), {"day": (("date",), "day"), "promoter_pct": (("pr_and_prgrp",), "number"), "public_pct": (("public_val",), "number"), "submitted": (("submissionDate",), "text")}, ("symbol", "day"), last=True),
    "bars": Feed(("$.bars", "$"), {"symbol": (("symbol",), "text"), "day": (("date",), "day"), "open": (("open",), "number"), "high": (("high",), "number"), "low": (("low",), "number"), "close": (("close",), "number"), "volume": (("volume",), "number")}, ("symbol", "day"), last=True),
}
STATEMENTS = ("inc_a", "inc_q", "bs_a", "bs_q", "cf_a", "cf_q")


def value(row: Column, names: tuple[str, ...], kind: str) -> Column:
    """The first of a row's fields that has a value; blanks and dashes are none."""
    texts = [F.trim(F.try_variant_get(row, f"$.{n}", "string")) for n in names]
    found = F.coalesce(*[F.when((t != "") & (t != "-"), t) for t in texts])
    if kind == "number":
        number = F.regexp_replace(found, ",", "").try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if kind == "day":
        return day_of(found)
    return F.substring(F.coalesce(found, F.lit("")), 1, int(kind[4:])) if kind.startswith("head") else found


def parse(responses: DataFrame, name: str) -> DataFrame:
    """A feed's rows, typed, from responses (body, the JSON text; other columns stay). Rows without a symbol and bodies that are no JSON have none.

    ``tag`` says which of several lists a row is of. Of a feed that is asked for by symbol the symbol is the response's.
    """
    feed = FEEDS[name]
    body = F.try_parse_json("body")
    lists = [F.try_variant_get("_doc", p, "array<variant>") for p in feed.places]
    docs = responses.withColumn("_doc", body)
    if feed.tags:
        tagged = F.array(*[F.struct(F.lit(t).alias("tag"), rows.alias("rows")) for t, rows in zip(feed.tags, lists, strict=True)])
        each = docs.withColumn("_t", F.explode(tagged)).select("*", F.col("_t.tag").alias("tag"), F.explode("_t.rows").alias("_row"))
    else:
        each = docs.withColumn("_row", F.explode(F.coalesce(*lists)))
    fields = {c: value(F.col("_row"), names, kind) for c, (names, kind) in feed.fields.items()}
    if "symbol" not in fields:
        fields = {"symbol": F.try_variant_get("_doc", "$.symbol", "string")} | fields
    more = [c for c in responses.columns if c != "body"]
    return each.select(*more, *(["tag"] if feed.tags else []), *[v.alias(c) for c, v in fields.items()]).where("symbol is not null")


def statements(responses: DataFrame) -> DataFrame:
    """symbol, fetched, stmt, item, period_end, value from company records of the vendor (body: one a response)."""
    items = ", ".join(f"{s}: map<string,map<string,double>>" for s in STATEMENTS)
    c = responses.select(F.from_json("body", f"struct<symbol: string, fetched: string, {items}>").alias("c")).select("c.*").where("symbol is not null")
    each = F.array(*[F.struct(F.lit(s).alias("stmt"), F.col(s).alias("items")) for s in STATEMENTS])
    lines = c.select("symbol", day_of(F.col("fetched")).alias("fetched"), F.explode(each).alias("s")).select("symbol", "fetched", "s.stmt", F.explode("s.items").alias("item", "at"))
    return lines.select("symbol", "fetched", "stmt", "item", F.explode("at").alias("d", "value")).select("symbol", "fetched", "stmt", "item", day_of(F.col("d")).alias("period_end"), "value").where("value is not null")


def surveillance(responses: DataFrame) -> DataFrame:
    """symbol: all that any of the responses names as one, at whatever depth."""
    found = walk(responses.select("body"), "body").where("key = 'symbol'")
    return found.select(F.trim(F.try_variant_get("value", "$", "string")).alias("symbol")).where("symbol <> '' and not startswith(symbol, '{') and not startswith(symbol, '[')").distinct()


def schema(spark: SparkSession, name: str, more: str = "") -> T.StructType:
    """The columns of a feed's table, ``more`` columns of its responses before them."""
    empty = spark.createDataFrame([], T._parse_datatype_string(f"{more}{', ' if more else ''}body string"))
    return parse(empty, name).schema
