"""Dates as feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways in which feeds write a day, the first that fits counts; days come before months where either fits.
FORMATS = ("yyyy-MM-dd", "d-MMM-yyyy", "d MMM yyyy", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "M/d/yyyy", "M-d-yyyy", "yyyyMMdd", "d-MMM-yy")
SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "yyyyMMdd": r"^\d{8}$", "d-MMM-yy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{2}$",
}


def day_of(text: Column) -> Column:
    """The day that a text names, whatever time follows it; null where it names none. Months are in any case."""
    # a time of day comes after a T or blank and has a colon
    bare = F.regexp_replace(F.trim(text.cast("string")), r"[Tt ]+\d{1,2}:.*$", "")
    month = F.regexp_extract(bare, "[A-Za-z]+", 0)
    bare = F.replace(bare, month, F.initcap(month))
    return F.coalesce(*[F.when(bare.rlike(SHAPES[f]), F.to_date(F.try_to_timestamp(bare, F.lit(f)))) for f in FORMATS])


def written(day: Column, form: str) -> Column:
    """A day as a feed writes it, its month in capitals."""
    return F.upper(F.date_format(day, form))
