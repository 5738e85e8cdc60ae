"""Windows whose cost a row does not grow with their width, and scans in order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drawdown(bars: DataFrame, k: int = 252, x: str = "close", name: str = "max_dd_1y") -> DataFrame:
    """Adds at every bar the deepest fall below the highest value so far, within the symbol's last k bars (all, if fewer).

    (highest, lowest, deepest fall) of two neighbouring stretches gives that of both, so a window of k is put together
    from stretches of powers of two, each from two of the last size. All are lags over one order: log2(k) window steps
    and no shuffle but by symbol. Values must be positive; a null one has no part in it.
    """
    order = Window.partitionBy("symbol").orderBy("date")
    c = F.col(x)

    def joined(older, newer):
        (h0, l0, f0), (h1, l1, f1) = older, newer
        return F.greatest(h0, h1), F.least(l0, l1), F.least(f0, f1, l1 / h0 - 1)

    def named(j):
        return tuple(F.col(f"_{p}{j}") for p in "hlf")

    d = bars.withColumns({"_h0": c, "_l0": c, "_f0": F.when(c.isNotNull(), F.lit(0.0))})
    top = k.bit_length() - 1
    for j in range(top):
        before = tuple(F.lag(v, 1 << j).over(order) for v in named(j))
        d = d.withColumns(dict(zip((f"_{p}{j + 1}" for p in "hlf"), joined(before, named(j)), strict=True)))
    whole, place = named(top), 1 << top
    for j in reversed(range(top)):
        if k >> j & 1:
            whole = joined(tuple(F.lag(v, place).over(order) for v in named(j)), whole)
            place += 1 << j
    return d.withColumn(name, whole[2]).drop(*[f"_{p}{j}" for j in range(top + 1) for p in "hlf"])


def sorted_rank(panel: DataFrame, x: str, k: int, least: int, name: str) -> DataFrame:
    """Adds the place of a value among the symbol's values of the last k sessions, itself included, in (0, 1], ties by their average; null below ``least`` values.

    One pass in order of sessions, which holds the window's values sorted: a row's cost is two bisections, whatever k is,
    and a symbol of any length streams through.
    """
    columns = panel.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        symbol, held, values = None, deque(), []
        for b in batches:
            out = []
            for s, at, v in zip(b.column("symbol").to_pylist(), b.column("session_no").to_pylist(), b.column(x).to_pylist(), strict=True):
                if s != symbol:
                    symbol, held, values = s, deque(), []
                while held and held[0][0] <= at - k:
                    del values[bisect_left(values, held.popleft()[1])]
                if v is None:
                    out.append(None)
                    continue
                held.append((at, v))
                insort(values, v)
                below = bisect_left(values, v)
                same = bisect_right(values, v, below) - below
                out.append((below + (same + 1) / 2) / len(values) if len(values) >= least else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.float64())], [*columns, name])

    ordered = panel.repartition("symbol").sortWithinPartitions("symbol", "session_no")
    return ordered.mapInArrow(run, panel.select("*", F.lit(None).cast("double").alias(name)).schema)


def spaced(events: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """Of each group's events the first, and then each that is at least ``gap`` after the last one kept.

    Greedy, in one pass in order that remembers the last event kept; so a group's events are not gathered, and its time is linear in them.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, last = None, 0
        for b in batches:
            keep = []
            for *g, t in zip(*(b.column(c).to_pylist() for c in (*by, at)), strict=True):
                first = g != group
                keep.append(first or t - last >= gap)
                if keep[-1]:
                    group, last = g, t
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = events.select(*by, at)
    return rows.repartition(*by).sortWithinPartitions(*by, at).mapInArrow(run, rows.schema)
