"""Operator 8: near-duplicate vectors by int8 tile products with error bounds, within buckets of hashed directions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, bounded, mix64, runs
from .components import stars

CHUNK = 1024
FILL = 128
LINK = "a long, b long, n long"


def planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """(dims, tables * bits) directions, the same in every worker."""
    return np.random.default_rng((dims, 8)).standard_normal((dims, tables * bits)).astype(np.float32)


def codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(n, tables): on which sides of each table's planes a vector lies."""
    side = (vectors.astype(np.float32) @ planes(vectors.shape[1], tables, bits) > 0).reshape(len(vectors), tables, bits)
    return (side * (1 << np.arange(bits, dtype=np.uint64))).sum(2, dtype=np.uint64)


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 times a scale each, and the length of what that leaves out, rounded up."""
    scale = (np.abs(units).max(1) / 127).astype(np.float32)
    q = np.clip(np.rint(units / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    return q, scale, (np.linalg.norm(units - q * scale[:, None].astype(np.float64), axis=1) + 1e-6).astype(np.float32)


def possible(left: tuple, right: tuple, least: float, square: bool) -> np.ndarray:
    """Which pairs of two quantised lists may have a cosine >= ``least``; of a square tile those with i < j.

    The int8 product differs from the cosine by at most e_j + (1 + e_j) e_i, where e are the lengths of the quantisation
    errors.
    """
    (q_a, s_a, e_a), (q_b, s_b, e_b) = left, right
    # sums of at most 1,040 products of int8 are exact in single precision; longer vectors are summed in double
    kind = np.float32 if q_a.shape[1] <= 1024 else np.float64
    about = (q_a.astype(kind) @ q_b.astype(kind).T) * s_a[:, None] * s_b[None, :]
    about += e_b[None, :] + (1 + e_b[None, :]) * e_a[:, None] + np.float32(2e-6)
    maybe = about >= np.float32(least)
    return np.triu(maybe, 1) if square else maybe


def tile(left: tuple, right: tuple, least: float, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs with cosine >= ``least``; of a square tile those with i < j.

    Pairs that ``possible`` leaves are computed again in double precision, and only they.
    """
    raw_a, raw_b = left[0], right[0]
    maybe = possible(left[1:], right[1:], least, square)
    i, j = np.nonzero(maybe)
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 65536):
        a, b = raw_a[i[s : s + 65536]], raw_b[j[s : s + 65536]]
        good[s : s + 65536] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= least
    return i[good], j[good]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that links lead to, for each of ``n`` places."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def width(vectors: DataFrame, column: str) -> str:
    """The kind in which components travel: single precision where the column has no more."""
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, FloatType) else "<f8"


def read(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, h1, h2 (hash of the vector), vec (its components' bytes); the last three are null where a vector can't link."""
    kind = width(vectors, column)

    def run(batches):
        for b in bounded(batches):
            raw, h1, h2 = [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                one = None
                if i is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x + 0.0  # one kind of zero
                        x = x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x
                        one = x.astype(kind).tobytes()
                raw.append(one)
                h1.append(xxhash.xxh3_64_intdigest(one or b"", 1))
                h2.append(xxhash.xxh3_64_intdigest(one or b"", 2))
            none = np.array([r is None for r in raw], bool)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "h1": pa.array(np.array(h1, np.uint64).view(np.int64), mask=none), "h2": pa.array(np.array(h2, np.uint64).view(np.int64), mask=none), "vec": pa.array(raw, pa.binary())})

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec")).mapInArrow(run, "id long, h1 long, h2 long, vec binary")


def deal(tables: int, bits: int, kind: str):
    """A row for each vector and table: the bucket's key and the vector's int8 code (code, scale, error), not the vector."""

    def run(batches):
        for b in bounded(batches):
            raw, ids = b.column("vec").to_pylist(), b.column("id")
            sizes = np.array([len(r) for r in raw])
            key, code = np.zeros((len(raw), tables), np.uint64), np.empty(len(raw), object)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
                u = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = codes(u, tables, bits)
                key[at] = mix64(own ^ mix64(np.arange(tables, dtype=np.uint64) + np.uint64(int(size) << 16)))
                for i, q, s, e in zip(at, *quantise(u), strict=True):
                    code[i] = q.tobytes() + s.tobytes() + e.tobytes()
            code = pa.array(code, pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[:, t].view(np.int64)), "t": pa.array([t] * len(raw), pa.int32()), "id": ids, "code": code})

    return run


def sift(least: float):
    """Of each tile's rows those that may have a partner there, by the codes alone."""

    def load(t):
        flat = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
        ends = np.ascontiguousarray(flat[:, -8:]).view("<f4")
        return flat[:, :-8].view(np.int8), ends[:, 0], ends[:, 1]

    def run(batches):
        for t in runs(batches, "key", "i", "j"):
            if len(t) < 2:
                continue
            if t["i"][0].as_py() == t["j"][0].as_py():
                codes = load(t)
                maybe = possible(codes, codes, least, True)
                keep = maybe.any(0) | maybe.any(1)
            else:
                part = t["chunk"].to_numpy() == t["i"][0].as_py()
                if part.all() or not part.any():
                    continue
                maybe = possible(load(t.filter(pa.array(part))), load(t.filter(pa.array(~part))), least, False)
                keep = np.zeros(len(t), bool)
                keep[part], keep[~part] = maybe.any(1), maybe.any(0)
            if keep.any():
                yield from t.drop_columns(["code"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def compare(least: float, tables: int, bits: int, kind: str):
    """Links within buckets: (id, null, copies linked) rows, and (id, smaller id, null) rows that connect what is linked.

    A pair that meets in several tables counts in the first of them.
    """

    def load(t):
        ids = t["id"].to_numpy()
        raw = np.frombuffer(b"".join(t["vec"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        return ids, t["m"].to_numpy(), raw, (raw, *quantise(raw / np.linalg.norm(raw, axis=1, keepdims=True)))

    def run(batches):
        out: list[tuple] = []
        for t in runs(batches, "key", "i", "j"):
            now, i, j = t["t"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
            if len(t) < 2:
                continue
            if i == j:
                ids, m, raw, whole = load(t)
                a, b = tile(whole, whole, least, True)
            else:
                part = t["chunk"].to_numpy() == i
                if part.all() or not part.any():
                    continue
                one, two = load(t.filter(pa.array(part))), load(t.filter(pa.array(~part)))
                a, b = tile(one[3], two[3], least, False)
                ids, m, raw = (np.concatenate([one[k], two[k]]) for k in range(3))
                b = b + len(one[0])
            if not len(a):
                continue
            used, back = np.unique(np.r_[a, b], return_inverse=True)
            x = raw[used]
            own = codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, bits)
            p, q = back[: len(a)], back[len(a) :]
            label = roots(len(used), p, q)
            moved = np.flatnonzero(label != np.arange(len(used)))
            out.append((ids[used[moved]], ids[used[label[moved]]], np.full(len(moved), -1)))
            first = np.ones(len(p), bool)
            for s in range(0, len(p), 65536):
                first[s : s + 65536] = ~(own[p[s : s + 65536], :now] == own[q[s : s + 65536], :now]).any(1)
            p, q = p[first], q[first]
            n = np.bincount(p, m[used[q]], len(used)) + np.bincount(q, m[used[p]], len(used))
            held = np.flatnonzero(n)
            out.append((ids[used[held]], np.full(len(held), -1), n[held].astype(np.int64)))
            if sum(len(o[0]) for o in out) > 8192:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        a, b, n = (np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n >= 0), pa.array(n, mask=n < 0)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, miss: float = 0.003, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Links between vectors of cosine >= ``least`` and what they connect: vec_id, n_links, component_id, kept.

    Candidate pairs share a bucket in one of several tables of hashed directions. There are as many bits as leave some FILL
    vectors to a bucket, and as many tables as find a pair at the threshold but for a chance of ``miss`` (closer pairs are
    missed more rarely); no link below the threshold is given. What goes to the buckets is an int8 code of each vector;
    whole vectors follow, once for each tile, for those alone that by the codes may have a partner there. Equal vectors are compared as one and
    counted as many. A bucket of over CHUNK vectors is compared in tiles of chunks, dealt out over many tasks. Vectors of
    different lengths don't link; nor do null, empty, zero ones or ones with null or non-finite components, which are
    their own component. Each row has its row here, with the links of its own vector; rows that repeat an id and a vector
    count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch, kind = Scratch(spark, "vectors"), width(vectors, column)
    every = scratch.put(read(vectors, id_column, column), "vectors")
    # a node is a distinct vector; nodes are numbered in the order of their smallest id, so that a component's smallest node has its smallest id
    each = every.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count_distinct("id").alias("m"), F.first("vec").alias("vec"))
    nodes = scratch.put(each.orderBy("first", "h1", "h2").withColumn("id", F.monotonically_increasing_id()), "nodes")
    single = nodes.select("id", "m", "vec")
    n = single.count()
    bits = min(40, max(6, math.ceil(math.log2(max(1, n) / FILL))))
    same = (1 - math.acos(least) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-same)))
    rows = single.mapInArrow(deal(tables, bits, kind), "key long, t int, id long, code binary")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    big = scratch.put(keys.where(F.col("n") > CHUNK), "big")
    if big.isEmpty():
        tiles = rows.select("*", F.lit(0).alias("chunk"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        ways = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
        dealt = rows.join(big, "key", "left").select(*rows.columns, ways.alias("ways"), F.pmod(F.xxhash64("id"), ways.cast("long")).cast("int").alias("chunk"))
        other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("other"))
        tiles = other.select(*rows.columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    near = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(sift(least), "key long, t int, id long, chunk int, i int, j int")
    pairs = scratch.put(near, "near").join(single, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.put(pairs.mapInArrow(compare(least, tables, bits, kind), LINK), "links")
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    root = stars(found.where("b is not null").select("a", "b"), scratch).join(nodes.select(F.col("id").alias("root"), F.col("first").alias("component_id")), "root").select(F.col("node").alias("id"), "component_id")
    of = nodes.select("id", "h1", "h2", "first", "m").join(links, nodes["id"] == links["a"], "left").join(root, "id", "left")
    # written before it is joined: joined straight, a vector with very many copies could not be split
    of = scratch.put(of.select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "of")
    out = every.select(F.col("id").alias("vec_id"), "h1", "h2").join(of.hint("merge"), ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
