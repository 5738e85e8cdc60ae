"""Operator 11: hard negatives by exact integer scores, from products of residues and Chinese remaindering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, partitions, runs

#: Odd primes below 2^10, largest first: products of their balanced residues stay small in single precision.
PRIMES = [p for p in range(1021, 500, -2) if all(p % q for q in range(3, 32, 2))]
ROWS = 131_072  # of the table, that a task holds at once
CHUNK, TILE = 256, 1024  # anchors and rows of a product


def moduli(bound: int) -> list[int]:
    """As many primes as tell whole numbers from -bound to bound apart."""
    out, reach = [], 1
    for p in PRIMES:
        if reach > 2 * bound:
            return out
        out.append(p)
        reach *= p
    raise ValueError("more range than the primes have")


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2, as doubles; doubles given are whole and below 2^50."""
    if x.dtype != np.float64:
        x = np.mod(x, p).astype(np.float64)
    return x - p * np.rint(x / p)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p, balanced. Columns are taken in panels whose sums single precision holds exactly."""
    step = max(1, (1 << 24) // (p // 2) ** 2)
    out = None
    for s in range(0, a.shape[1], step):
        left, right = (balanced(x[:, s : s + step], p).astype(np.float32) for x in (a, b))
        part = balanced((left @ right.T).astype(np.float64), p)
        out = part if out is None else balanced(out + part, p)
    return np.zeros((len(a), len(b))) if out is None else out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as long as they fit 63 bits.

    A product is taken modulo each prime; balanced mixed-radix digits (Garner's form of Chinese remaindering) then give
    the signed score directly: digit k is what is left of residue k after the digits before it, divided by their primes.
    """
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (a, b)]
    primes = moduli(a.shape[1] * most[0] * most[1])
    out, radix, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for k, p in enumerate(primes):
        digit, scale = residue_product(a, b, p), 1
        for q, d in zip(primes[:k], digits, strict=True):
            digit -= d * scale
            scale = scale * q % p
        digit = balanced(balanced(digit, p) * pow(scale, -1, p), p)
        digits.append(digit)
        # sums wrap, but the score itself fits
        with np.errstate(over="ignore"):
            out += digit.astype(np.int64) * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= p
    return out


def best(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest good scores, highest first and ties by smaller column; fewer, if fewer are good."""
    n = score.shape[1]
    if n > k:
        kept = np.where(good, score, np.iinfo(np.int64).min)
        good = good & (kept >= np.partition(kept, n - k, axis=1)[:, n - k, None])
    i, j = np.nonzero(good)
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


class Top:
    """The k highest scores of each of m rows, of tiles that come by ascending ids: ties go to the smaller id."""

    def __init__(self, m: int, k: int):
        self.k, self.least = k, np.full(m, np.iinfo(np.int64).min)
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        good = good & (score > self.least[:, None])
        asked = np.flatnonzero(good.any(1))
        if not len(asked):
            return
        i, j = best(score[asked], good[asked], self.k)
        row, found, value = np.r_[self.row, asked[i]], np.r_[self.id, ids[j]], np.r_[self.score, score[asked[i], j]]
        order = np.lexsort((found, -value, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        self.row, self.id, self.score = row[place < self.k], found[order], value[order]
        full = place == self.k - 1
        self.least[row[full]] = self.score[place[place < self.k] == self.k - 1]


def read(vectors: DataFrame, id_column: str, column: str, label_column: str) -> DataFrame:
    """id, label, d, v: rows that take part, with whole components as little-endian bytes (two each if they fit, else eight)."""

    def run(batches):
        for b in bounded(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for i, label, v in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("v").to_pylist(), strict=True):
                if not v or None in v:
                    continue
                x = np.floor(256 * np.array(v, np.float64))
                if not np.isfinite(x).all() or len(x) * float(np.abs(x).max()) ** 2 >= 2.0**62:
                    continue
                small = np.abs(x).max() < 1 << 15
                for held, value in zip(out, (i, label, len(x), x.astype("<i2" if small else "<i8").tobytes()), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_pydict({"id": pa.array(out[0], pa.int64()), "label": pa.array(out[1], pa.int64()), "d": pa.array(out[2], pa.int32()), "v": pa.array(out[3], pa.binary())})

    known = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(column).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    moved = known.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return moved.mapInArrow(run, "id long, label long, d int, v binary")


def matrix(t: pa.Table) -> np.ndarray:
    """The rows' components; all rows have as many."""
    d = t["d"][0].as_py()
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * d else "<i8") for v in t["v"].to_pylist()], np.int64)


def meet(pick, schema: str, rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """``pick`` of the anchors' chunks and each block of rows.

    Rows are dealt out to ``blocks`` blocks of at most about ROWS rows, in blocks of their own for each number of
    components. A task holds one block, and the anchors, sorted behind it, stream past in chunks; so what is held does
    not grow with either table, and of the two the table of queries is the one that is copied.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    sides = rows.select("d", own, F.lit(0).alias("asks"), *rows.columns[:2], "v", F.lit(None).cast("array<long>").alias("windows"))
    asks = anchors.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), "id", "label", "v", "windows" if "windows" in anchors.columns else F.lit(None).cast("array<long>").alias("windows"))

    def run(batches):
        block, at = None, None
        for t in pieces(batches):
            now = (t["d"][0].as_py(), t["block"][0].as_py())
            if not t["asks"][0].as_py():
                at, ids, labels = now, t["id"].to_numpy(), t["label"].to_numpy()
                order = np.argsort(ids, kind="stable")
                block = (ids[order], labels[order], matrix(t)[order])
            elif at == now:
                yield from pick(t, *block)

    return sides.unionByName(asks).repartition(2 * blocks, "d", "block").sortWithinPartitions("d", "block", "asks").mapInArrow(run, schema)


def pieces(batches: Iterator) -> Iterator[pa.Table]:
    """A block of rows whole, then its anchors in chunks."""
    held: list = []
    last = None
    for b in batches:
        for t in runs([b], "d", "block", "asks"):
            now = (t["d"][0].as_py(), t["block"][0].as_py(), t["asks"][0].as_py())
            if held and (now != last or (now[2] and sum(map(len, held)) >= CHUNK)):
                yield from cut(pa.concat_tables(held))
                held = []
            held.append(t)
            last = now
    if held:
        yield from cut(pa.concat_tables(held))


def cut(t: pa.Table) -> Iterator[pa.Table]:
    step = CHUNK if t["asks"][0].as_py() else len(t)
    for s in range(0, len(t), step):
        yield t.slice(s, step)


def tiles(t: pa.Table, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    asked = matrix(t)
    for s in range(0, len(ids), TILE):
        at = slice(s, s + TILE)
        yield scores(asked, values[at]), ids[at], labels[at]


def positives(k: int):
    def pick(t, *block):
        anchor, own, top = t["id"].to_numpy(), t["label"].to_numpy(), Top(len(t), k)
        for s, ids, labels in tiles(t, *block):
            top.add(s, (labels[None, :] == own[:, None]) & (ids[None, :] != anchor[:, None]), ids)
        yield pa.RecordBatch.from_pydict({"anchor_id": pa.array(anchor[top.row]), "positive_id": pa.array(top.id), "positive_score": pa.array(top.score)})

    return pick


def negatives(k: int, low: int, high: int):
    def pick(t, *block):
        anchor, own = t["id"].to_numpy(), t["label"].to_numpy()
        windows = [sorted(w) for w in t["windows"].to_pylist()]
        asks = []
        for n in range(max(map(len, windows))):
            at = np.array([x for x, w in enumerate(windows) if len(w) > n])
            # whole numbers of Python: the bounds of very large scores don't overflow
            base = [windows[x][n] for x in at]
            floor, ceil = (np.array(x, np.int64)[:, None] for x in ([-(-low * p // 100) for p in base], [high * p // 100 for p in base]))
            asks.append((at, np.array(base, np.int64), floor, ceil, Top(len(at), k)))
        for s, ids, labels in tiles(t, *block):
            other = labels[None, :] != own[:, None]
            for at, _, floor, ceil, top in asks:
                part = s if len(at) == len(s) else s[at]
                top.add(part, (other if len(at) == len(s) else other[at]) & (part >= floor) & (part <= ceil), ids)
        for at, base, _, _, top in asks:
            yield pa.RecordBatch.from_pydict({"anchor_id": pa.array(anchor[at[top.row]]), "positive_score": pa.array(base[top.row]), "negative_id": pa.array(top.id), "negative_score": pa.array(top.score)})

    return pick


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Hard negatives of the anchors, rows whose id is divisible by ``every``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of components floor(256 x). An anchor's positives are its highest other rows of
    the same label; for each, the negatives are the highest rows of another label whose score lies from ``low`` to
    ``high`` hundredths of the positive's. Ties go to the smaller id. Where an id is divisible by 7 its label is one
    further, modulo 10.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; nor do vectors so
    long that a score might not fit 63 bits (number of components times the square of the largest, after scaling, from
    2^62). Rows with different numbers of components are not compared. An id that repeats stands for one row, that of the
    smallest label and then the smallest stored bytes. An anchor without positives, a positive without negatives and an
    empty table give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    # one row for an id, pre-aggregated before the shuffle
    one = read(vectors, id_column, column, label_column).groupBy("id").agg(F.min(F.struct("label", "d", "v")).alias("x")).select("id", "x.*")
    rows = scratch.put(one, "rows")
    anchors = rows.where(F.col("id") % every == 0)
    n = rows.count()
    blocks = max(1, math.ceil(n / ROWS), min(partitions(spark), n // 1024))
    near = meet(positives(n_positives), "anchor_id long, positive_id long, positive_score long", rows, anchors, blocks)
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = scratch.put(near.withColumn("place", first).where(F.col("place") <= n_positives).drop("place"), "positives")
    # an anchor's positives are few, and equal scores share a window
    windows = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("windows"))
    hard = meet(negatives(n_negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long", rows, anchors.join(windows, "id"), blocks)
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    kept = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    out = found.join(kept, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
