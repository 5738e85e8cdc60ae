"""Ranks over groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored


def tie_ranks(rows: DataFrame, value: str, by: list[str], ranges: int = 64) -> DataFrame:
    """by, value, n, rank, total: of each distinct value how many rows have it, one more than have a smaller one, and how many there are in all.

    Rows are first counted by value, before they are shuffled, so that values which very many rows share are one row each.
    Cuts at sampled quantiles (a mergeable sketch a group) deal a group's values out over ``ranges`` ranges; each is ranked
    by itself, and what stands in the ranges before is added. A group has as many rows in the tables of cuts and of ranges
    as there are ranges. Values must not be null; of an empty table nothing is ranked.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    key = by or ["_all"]
    if not by:
        counted = counted.withColumn("_all", F.lit(0))
    cuts = counted.groupBy(*key).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    placed = counted.join(cuts, key).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*key, "_range").agg(F.sum("n").alias("m"))
    group = Window.partitionBy(*key)
    before = F.coalesce(F.sum("m").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*key, "_range", before.alias("_before"), F.sum("m").over(group).alias("total"))
    so_far = Window.partitionBy(*key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, [*key, "_range"]).withColumn("rank", F.col("_before") + F.sum("n").over(so_far) - F.col("n") + 1)
    return ranked.select(*by, value, "n", "rank", "total")


#: Values of a group up to which ``ranked_cells`` deals none out to ranges, and that a range holds then, about; cuts of a group; and tasks (a power of two) that share out rows which need no order.
RANGE_ROWS, MOST_CUTS, SHARE_BITS = 65_536, 63, 4


def at_range(cuts: Column, value: Column) -> list[Column]:
    """Steps of a binary search that leave in ``_range`` twice the number of ``cuts`` (ordered, different, at most ``MOST_CUTS``) below a value, and one more where the value is a cut itself."""
    i, steps = F.lit(0), []
    for k in (32, 16, 8, 4, 2, 1):
        steps.append(F.when(F.get(cuts, i + (k - 1)) < value, i + k).otherwise(i))
        i = F.col("_range")
    return [*steps, 2 * i + F.coalesce((F.get(cuts, i) == value).cast("int"), F.lit(0))]


def ranked_cells(wide: DataFrame, by: list[str], key: str, columns: list[str], within: tuple[str, list[str]] | None, rows: int) -> DataFrame:
    """by, key, code, lt, le, total: of each value in ``columns`` how many of its column are smaller, how many no larger, and how many there are. Nulls have no rank.

    ``wide``: by, key and the columns, a stored table. A column's values are ranked for each ``by`` apart, and have its
    place in ``columns`` as ``code``; those named ``within`` a further column once more within each of its values, with
    codes from there on. ``rows``: how many a ``by`` has at most, about.

    Rows travel once to be ranked, as a number that names group and range, the value and the key. Groups of more than
    ``RANGE_ROWS`` are dealt out to ranges between cuts at approximate quantiles; a cut is a range itself, of ties, whose
    rank follows from counts; so no task has all of a group, however many share a value. Cuts decide where a value is
    ranked, not how.
    """
    n = min(MOST_CUTS, rows // RANGE_ROWS)
    group, inner = within or (None, [])
    inside = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def groups(column: str | None, named: dict[int, str]) -> DataFrame:
        """by, code, the value they are within as text, how many values there are, and cuts: a row a group."""
        keys = [*by, *([column] if column else [])]
        some = (wide.where(F.col(column).isNotNull()) if column else wide).groupBy(*keys)
        at = [i / (n + 1) for i in range(1, n + 1)]
        cuts = lambda x: F.array_sort(F.array_distinct(F.percentile_approx(x, at, 1000))) if n else F.array().cast("array<double>")
        found = some.agg(*[F.when(F.count(x) > 0, F.struct(F.count(x).alias("total"), cuts(x).alias("cuts"))).alias(str(i)) for i, x in named.items()])
        found = found.unpivot(keys, [str(i) for i in named], "code", "_x").where("_x is not null")
        return found.select(*by, F.col("code").cast("int").alias("code"), (inside(column) if column else F.lit("")).alias("_in"), "_x.total", F.col("_x.cuts").alias("_cuts"))

    coded = {str(i): x for i, x in enumerate([*columns, *inner])}
    every = groups(None, dict(enumerate(columns)))
    if inner:
        every = every.unionByName(groups(group, dict(enumerate(inner, len(columns)))))
    # a row a group: as many as there are days, columns and values of what they are ranked within
    every = stored(every.withColumn("_group", F.row_number().over(Window.orderBy(*by, "code", "_in"))))
    cells = wide.select(*by, key, (inside(group) if group else F.lit("")).alias("_in"), *[(F.when(F.col(group).isNotNull(), F.col(x)) if int(i) >= len(columns) else F.col(x)).alias(i) for i, x in coded.items()])
    cells = cells.unpivot([*by, key, "_in"], list(coded), "code", "value").where("value is not null").withColumn("code", F.col("code").cast("int"))
    cells = cells.withColumn("_in", F.when(F.col("code") >= len(columns), F.col("_in")).otherwise("")).join(F.broadcast(every), [*by, "code", "_in"])
    for step in at_range(F.col("_cuts"), F.col("value")) if n else [F.lit(0)]:
        cells = cells.withColumn("_range", step)
    place = (F.col("_group").cast("long") * 128 + F.col("_range")).alias("_place")
    share = F.when(F.col("_range") % 2 == 1, F.pmod(F.hash(key), F.lit(1 << SHARE_BITS))).otherwise(0)
    slot = Window.partitionBy("_slot").orderBy("value")
    ranked = cells.select((place * (1 << SHARE_BITS) + share).alias("_slot"), key, "value")
    ranked = ranked.withColumns({"_lt": F.rank().over(slot) - 1, "_le": F.count(F.lit(1)).over(slot.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    # joins by what the search has found are outer ones, though each has its row: inner ones would test it for null before it is there
    if not n:
        named = every.select((F.col("_group").cast("long") * 128).alias("_place"), *by, "code", "total")
        return ranked.withColumn("_place", F.shiftright("_slot", SHARE_BITS)).join(F.broadcast(named), "_place", "left").select(*by, key, "code", F.col("_lt").alias("lt"), F.col("_le").alias("le"), "total")
    counts = cells.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group").orderBy("_range")
    before = F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_group", place, "_n", before.alias("_before")).join(F.broadcast(every.drop("_cuts", "_in")), "_group")
    offsets = stored(offsets.drop("_group"))  # a row a group and range
    found = ranked.withColumn("_place", F.shiftright("_slot", SHARE_BITS)).join(F.broadcast(offsets), "_place", "left")
    alike = F.col("_place") % 2 == 1
    return found.select(*by, key, "code", (F.col("_before") + F.when(alike, 0).otherwise(F.col("_lt"))).alias("lt"), (F.col("_before") + F.when(alike, F.col("_n")).otherwise(F.col("_le"))).alias("le"), "total")


def mean_rank() -> Column:
    """The rank in per cent of ``tie_ranks``, ties sharing their average."""
    return (F.col("rank") + (F.col("n") - 1) / 2.0) / F.col("total") * 100.0


def at_place(ranks: DataFrame, value: str, place: Column) -> Column:
    """As an aggregate of ``tie_ranks``: the value at a place from the top, counted from 0."""
    above = F.col("total") - F.col("rank") - F.col("n") + 1
    return F.max(F.when((place >= above) & (place < above + F.col("n")), F.col(value)))
