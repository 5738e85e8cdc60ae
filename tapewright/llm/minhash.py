"""Operator 9: near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

A node is a distinct text, whichever rows hold it. Nodes that share a band meet in buckets, and every link is checked on
the exact sets of shingles, in three steps that together test each pair of a bucket that might be similar and is not
connected yet:

1. in each bucket members follow leaders, which gives fewer edges than members;
2. members that look similar but stand in different classes: each one's likeliest partners;
3. where there were more than those, all of them, in tiles of sets by matrix products: what leaves a tile is what it joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, bounded, doc_columns, mix64, runs, texts
from .components import stars
from .dart import GOLDEN, Shingler, bands, signatures

#: Slots agree with a standard error of 0.037 at similarity 0.8: pairs below this are not checked (four of them away).
LOW = 0.65
CHUNK = 512
#: Partners of each member that step 2 checks.
PARTNERS = 2
#: Members, and words of theirs, in a chunk of step 3.
TILE, TILE_WORDS = 1024, 1 << 20


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (content hash), n (words), bands, sketch (16 bits of each slot); texts without words have no bands, rows without text or doc_id no content."""

    def run(batches):
        shingler = Shingler()
        for b in bounded(batches, rows=256):
            rows = texts(b)
            doc, element, weight, content = shingler.sets(rows)
            sig = signatures(doc, element, weight, len(rows))
            held = np.bincount(doc, minlength=len(rows))
            keys, low = bands(sig).view(np.int64), sig.astype(np.uint16)
            nothing = np.array([i is None or t is None for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)], bool)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "h1": pa.array(content[:, 0].view(np.int64), mask=nothing), "h2": pa.array(content[:, 1].view(np.int64), mask=nothing), "n": pa.array(held, pa.int64()),
                "bands": pa.array([k if ok else [] for k, ok in zip(keys, held > 0, strict=True)], pa.list_(pa.int64())), "sketch": pa.array([s.tobytes() for s in low], pa.binary()),
            })

    return doc_columns(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, n long, bands array<long>, sketch binary")


def likeness(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sketches == one).mean(1)


def cluster(ids: np.ndarray, sketches: np.ndarray, at_least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges to check within one bucket, and its leaders (places).

    Members follow the first leader that looks similar enough; those that follow none are leaders too. Among leaders the
    edges are a spanning forest of the likeliest ones that might be similar.
    """
    edges, leaders, rest = [], [], np.argsort(ids, kind="stable")
    while len(rest):
        lead, rest = rest[0], rest[1:]
        like = likeness(sketches[rest], sketches[lead])
        edges += [(int(ids[lead]), int(ids[i])) for i in rest[like >= at_least]]
        leaders.append(int(lead))
        rest = rest[like < at_least]
    if len(leaders) > 1:
        # Prim's algorithm, from every leader that the forest has not reached
        left = np.array(leaders)
        near, best = np.full(len(left), -1), np.zeros(len(left))
        while len(left):
            i = int(best.argmax())
            if best[i] >= LOW:
                edges.append((int(min(ids[near[i]], ids[left[i]])), int(max(ids[near[i]], ids[left[i]]))))
            now = left[i]
            keep = np.arange(len(left)) != i
            left, near, best = left[keep], near[keep], best[keep]
            like = likeness(sketches[left], sketches[now])
            closer = like > best
            near[closer], best[closer] = now, like[closer]
    return edges, leaders


def gathered(batches, keys: tuple[str, ...], one, schema: pa.Schema):
    """Rows that ``one`` gives for each run of equal keys, in batches of some thousands."""
    out: list[tuple] = []
    for t in runs(batches, *keys):
        out += one(t)
        if len(out) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def sketches_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t["sketch"]), np.uint16).reshape(t.num_rows, -1)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("sketch", pa.binary())])


def bucket_edges(rows: DataFrame, at_least: float) -> DataFrame:
    """a, b for edges; for leaders of buckets that are split: key, a, sketch. ``rows``: key, salt, split, id, sketch."""

    def one(t):
        ids, at = np.unique(t["id"].to_numpy(), return_index=True)
        sketches = sketches_of(t)[at]
        edges, leaders = cluster(ids, sketches, at_least)
        out = [(a, b, None, None) for a, b in edges]
        if t["split"][0].as_py():
            out += [(int(ids[i]), None, t["key"][0].as_py(), sketches[i].tobytes()) for i in leaders]
        return out

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lambda batches: gathered(batches, ("key", "salt"), one, EDGES), "a long, b long, key long, sketch binary")


def candidates(nodes: DataFrame, scratch: Scratch, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) with a < b, from buckets of equal band keys; and these buckets' members (id, key, n).

    Buckets of over CHUNK members are dealt out in chunks by a hash of the member, each with the bucket's smallest member
    besides. The chunks' leaders are dealt out anew, as long as each time they become half as many or fewer; what leaders
    in different chunks have in common after that is found by the next steps.
    """
    members = nodes.select("id", F.explode("bands").alias("key"))
    # counts are written first: joined straight from their aggregation, a hot key's rows could not be split
    counts = scratch.put(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1"), "counts")
    shared = scratch.put(members.join(counts.hint("merge"), "key"), "shared")
    level = shared.join(nodes.select("id", "sketch"), "id")
    found, before = [], None
    while True:
        ways = F.ceil(F.col("n") / CHUNK).cast("int")
        # a bucket's head goes to every chunk
        salts = F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), ways - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(len(found))), ways.cast("long")).cast("int")))
        rows = level.select("key", "id", "sketch", (ways > 1).alias("split"), F.explode(salts).alias("salt"))
        made = scratch.put(bucket_edges(rows, at_least), "edges")
        found.append(made.where("b is not null").select("a", "b"))
        leaders = made.where("b is null").select("key", F.col("a").alias("id"), "sketch").dropDuplicates(["key", "id"])
        counts = scratch.put(leaders.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1"), "counts")
        left = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if not left or (before is not None and 2 * left > before):
            break
        level, before = leaders.join(counts.hint("merge"), "key"), left
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct(), shared.select("id", "key", "n")


def cells(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one: as many hashes of an element as it weighs, sorted. Common weight is then the number of common ones."""
    first = np.repeat(np.cumsum(weight) - weight, weight)
    return np.sort(mix64(np.repeat(element, weight) + (np.arange(len(first)) - first).astype(np.uint64) * GOLDEN))


def sets_of(docs: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """id, cells of the nodes that share a bucket, from the texts of one doc_id each: more than once where rows repeat it."""
    wanted = nodes.join(shared.select("id").distinct().hint("merge"), "id", "left_semi").select("id", F.col("first").alias("doc_id"), "h1", "h2")
    # sorted and merged at every size: the texts are the large side, and the wanted ones grow with them
    rows = doc_columns(docs).where("text is not null").join(wanted.hint("merge"), "doc_id").select("id", "h1", "h2", "text")

    def run(batches):
        shingler = Shingler()
        for b in bounded(batches, rows=64):
            doc, element, weight, content = shingler.sets(texts(b))
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            # rows that repeat a doc_id may hold other texts
            own = (content.view(np.int64) == np.stack([b.column(c).to_numpy() for c in ("h1", "h2")], 1)).all(1)
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(at)), "cells": pa.array([cells(element[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]).tobytes() for i in at], pa.binary())})

    return rows.mapInArrow(run, "id long, cells binary")


def once(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """One row an id. Sets are large, so they are moved for it only where some id is there twice."""
    n = sets.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    return sets if n["rows"] == n["ids"] else scratch.put(sets.dropDuplicates(["id"]), "sets")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct numbers."""
    if not len(a) or not len(b):
        return 0.0
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def check(edges: DataFrame, sets: DataFrame, scratch: Scratch, at_least: float) -> DataFrame:
    """The edges (a, b) whose texts are exactly similar enough. A node with very many edges is compared in chunks of them."""
    degree = scratch.put(edges.groupBy("a").agg(F.count("*").alias("n")), "degree")
    salted = edges.join(degree.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 256)).cast("int").alias("salt"))
    wanted = salted.select("a", "salt", F.col("b").alias("id")).unionByName(salted.select("a", "salt", F.col("a").alias("id")).distinct())
    rows = sets.join(wanted.hint("merge"), "id").select("a", "salt", "id", "cells")

    def run(batches):
        out, last, lead = [], None, None
        for b in bounded(batches, rows=256):
            for a, salt, id_, raw in zip(*(b.column(c).to_pylist() for c in ("a", "salt", "id", "cells")), strict=True):
                if id_ == a:  # stands before those it is compared with
                    last, lead = (a, salt), np.frombuffer(raw, np.uint64)
                elif last == (a, salt) and alike(lead, np.frombuffer(raw, np.uint64)) >= at_least:
                    out.append((a, id_))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("id") != F.col("a")).mapInArrow(run, "a long, b long")


def mixed(members: DataFrame, root: DataFrame, scratch: Scratch, size, words) -> DataFrame:
    """Members (key, id, ...) of buckets that hold several components, dealt into tiles: key, salt, side, id, comp.

    Members of a bucket's most frequent component meet all others, and these each other, in tiles of chunk by chunk; a
    chunk holds about ``size`` members, and ``words`` of theirs.
    """
    live = scratch.put(members.join(root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"), "live")
    sizes = live.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "w", "comp")).alias("big"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("comps"))
    ways = lambda c, w: F.greatest(F.ceil(c / size), F.ceil(w / words)).cast("int")
    several = scratch.put(sizes.where("comps > 1").select("key", F.col("big.comp").alias("big"), ways(F.col("c") - F.col("big.c"), F.col("w") - F.col("big.w")).alias("others"), ways(F.col("big.c"), F.col("big.w")).alias("alike")), "several")
    rows = live.join(several.hint("merge"), "key")
    main, wide = F.col("comp") == F.col("big"), F.col("others") + F.col("alike")
    rows = rows.withColumn("wide", wide).withColumn("at", F.pmod(F.xxhash64("id"), F.when(main, F.col("alike")).otherwise(F.col("others")).cast("long")).cast("int"))
    tile = lambda i, j, side: F.struct((i * F.col("wide") + j).alias("salt"), F.lit(side).alias("side"))
    at = F.col("at")
    as_first = F.transform(F.sequence(at, F.col("wide") - 1), lambda j: tile(at, j, 0))
    as_second = F.when(at > 0, F.transform(F.sequence(F.lit(0), at - 1), lambda i: tile(i, at, 1))).otherwise(F.array().cast("array<struct<salt:int,side:int>>"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: tile(i, F.col("others") + at, 1))
    return rows.select("key", "id", "comp", F.explode(F.when(main, of_main).otherwise(F.concat(as_first, as_second))).alias("t")).select("key", "t.salt", "t.side", "id", "comp")


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of a tile's two sides; one of a single side is compared with itself."""
    side = t["side"].to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return one, two if len(two) else one, not len(two)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def likely(members: DataFrame, nodes: DataFrame, root: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b of pairs that share a bucket, might be similar and stand in different components: each member's likeliest PARTNERS in a tile; and where there are more, key, a of all members of such pairs."""
    rows = mixed(members, root, scratch, CHUNK, float(1 << 40)).join(nodes.select("id", "sketch"), "id")

    def one(t):
        one, two, _ = sides(t)
        if not len(one):
            return []
        ids, comp, sketches = t["id"].to_numpy(), t["comp"].to_numpy(), sketches_of(t)
        like = np.stack([likeness(sketches[two], sketches[i]) for i in one])
        like[comp[one][:, None] == comp[two][None, :]] = 0
        near, top = like >= LOW, np.zeros(like.shape, bool)
        for whole, chosen in ((like, top), (like.T, top.T)):
            k = min(PARTNERS, whole.shape[1])
            chosen[np.arange(len(whole))[:, None], np.argpartition(-whole, k - 1, axis=1)[:, :k]] = True
        i, j = np.nonzero(near & top)
        out = [(a, b, None) for a, b in {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[one[i]], ids[two[j]], strict=True)}]
        if (near & ~top).any():
            i, j = np.nonzero(near)
            out += [(int(a), None, t["key"][0].as_py()) for a in np.unique(np.r_[ids[one[i]], ids[two[j]]])]
        return out

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lambda batches: gathered(batches, ("key", "salt"), one, PAIRS), "a long, b long, key long")


def similar(one: list[np.ndarray], two: list[np.ndarray], at_least: float) -> np.ndarray:
    """Which pairs of two lists of sets are similar enough: common cells by matrix products, rare cells one by one."""
    flat = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [*map(len, one), *map(len, two)])
    _, column = np.unique(flat, return_inverse=True)
    left = row < len(one)
    width = int(column.max()) + 1 if len(column) else 0
    a, b = np.bincount(column[left], minlength=width), np.bincount(column[~left], minlength=width)
    common = np.zeros((len(one), len(two)), np.float32)
    often = np.flatnonzero((a > 0) & (b > 0) & (a * b > 64))
    for s in range(0, len(often), 1024):
        place = np.full(width, -1)
        place[often[s : s + 1024]] = np.arange(len(often[s : s + 1024]))
        parts = []
        for mask, n, first in ((left, len(one), 0), (~left, len(two), len(one))):
            m = np.zeros((n, len(often[s : s + 1024])), np.float32)
            at = place[column[mask]]
            m[row[mask][at >= 0] - first, at[at >= 0]] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    rare = (a > 0) & (b > 0) & (a * b <= 64)
    x, y = (np.flatnonzero(mask & rare[column]) for mask in (left, ~left))
    x, y = x[np.argsort(column[x], kind="stable")], y[np.argsort(column[y], kind="stable")]
    start, many = np.searchsorted(column[y], column[x]), b[column[x]]
    i = np.repeat(row[x], many)
    j = row[y[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(len(i))]] - len(one)
    np.add.at(common, (i, j), 1)
    size = np.array([*map(len, one)])[:, None] + np.array([*map(len, two)])[None, :]
    return common / np.maximum(size - common.astype(np.float64), 1) >= at_least


def merge(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
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


def exact(members: DataFrame, sets: DataFrame, root: DataFrame, scratch: Scratch, at_least: float) -> DataFrame:
    """a, b: components (one member of each) that a link between members (key, id, n) of a bucket joins. All pairs of different components are tested; a tile gives fewer rows than it has components."""
    rows = mixed(members, root, scratch, TILE, float(TILE_WORDS)).join(sets.hint("merge"), "id")

    def one(t):
        one, two, _ = sides(t)
        if not len(one):
            return []
        each = [np.frombuffer(x.as_py(), np.uint64) for x in t["cells"]]
        comp, number = np.unique(t["comp"].to_numpy(), return_inverse=True)
        linked = similar([each[i] for i in one], [each[i] for i in two], at_least)
        linked &= number[one][:, None] != number[two][None, :]
        i, j = np.nonzero(linked)
        label = merge(len(comp), number[one[i]], number[two[j]])
        return [(int(comp[label[c]]), int(comp[c]), None) for c in np.flatnonzero(label != np.arange(len(comp)))]

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lambda batches: gathered(batches, ("key", "salt"), one, PAIRS), "a long, b long, key long").select("a", "b")


def classes(docs: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2; null contents for rows without doc_id or text), and of each content h1, h2 its class: class_id, and the class's first content (c1, c2)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.put(sign(docs), "signed")
    each = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbers in the order of (doc_id, content), so that a class's smallest node has its smallest doc_id
    nodes = scratch.put(each.orderBy("first", "h1", "h2").withColumn("id", F.monotonically_increasing_id()), "nodes")
    edges, shared = candidates(nodes, scratch, at_least)
    edges = scratch.put(edges, "candidates")
    sets = once(scratch.put(sets_of(docs, nodes, shared), "sets"), scratch)
    whole = lambda links, root: stars(links.unionByName(root.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
    root = stars(check(edges, sets, scratch, at_least), scratch)
    # a bucket of two has had its only pair
    members = shared.where("n > 2").select("key", "id").join(nodes.select("id", "n"), "id")
    made = scratch.put(likely(members, nodes, root, scratch), "likely")
    new = scratch.put(made.where("b is not null").select("a", "b").distinct().join(edges, ["a", "b"], "left_anti"), "new")
    if not new.isEmpty():
        root = whole(check(new, sets, scratch, at_least), root)
    more = made.where("b is null").select("key", F.col("a").alias("id")).distinct()
    if not more.isEmpty():
        # buckets of the same members are one
        one_each = scratch.put(more.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("h")).groupBy("c", "h").agg(F.min("key").alias("key")).select("key"), "buckets")
        active = more.join(one_each.hint("merge"), "key").join(nodes.select("id", "n"), "id")
        joined = scratch.put(exact(active, sets, root, scratch, at_least), "exact")
        if not joined.isEmpty():
            root = whole(joined, root)
    first = nodes.select(F.col("id").alias("root"), F.col("first").alias("class_id"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    root = scratch.put(root.join(first, "root").select(F.col("node").alias("id"), "class_id", "c1", "c2"), "roots")
    of = nodes.select("id", "h1", "h2", "first").join(root, "id", "left").select("h1", "h2", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2"))
    return signed.select("doc_id", "h1", "h2"), scratch.put(of, "classes")


def near_duplicates(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, class_id (the smallest doc_id of the class), kept (doc_id = class_id).

    Documents are linked if the weighted Jaccard similarity of their five-word shingles is ``at_least``, which is tested
    exactly; a class is what links connect. A pair is found if it shares one of 24 bands and at least 0.65 of its slots
    agree: at a similarity of just 0.8 all but about 1 in 10,000 pairs are. Texts with the same words are one document.
    Texts without words, also empty ones, are copies of each other; very long texts are compared whole. Null texts are
    classes of their own, and rows with a null doc_id have a null class and stay. Each row has its row here: rows that
    repeat a doc_id have the class of their own text. An empty table gives no rows.
    """
    rows, of = classes(docs, at_least)
    out = rows.join(of.hint("merge"), ["h1", "h2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def contents(docs: DataFrame) -> DataFrame:
    """The rows as they are, with the content hashes of ``sign`` as two more columns."""
    taken = {c.lower() for c in docs.columns}
    one, two = (next(n for n in (f"{name}{'_' * i}" for i in range(99)) if n not in taken) for name in ("content_a", "content_b"))

    names = [*docs.columns, one, two]

    def run(batches):
        shingler = Shingler()
        for b in bounded(batches, rows=256):
            text, ids = b.column("text").cast(pa.string()).to_pylist(), b.column("doc_id").to_pylist()
            content = shingler.sets([t or "" for t in text])[3]
            nothing = np.array([i is None or t is None for i, t in zip(ids, text, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(content[:, i].view(np.int64), mask=nothing) for i in (0, 1))], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(one, LongType()), StructField(two, LongType())]))


def keep_one(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """One row of each class, columns as they are, and all rows whose doc_id or text is null.

    Very long texts are compared whole, by all their shingles; an empty table stays empty. The row of the smallest doc_id
    stays; of rows that share it, one of the class's first text, and of equal ones the one
    whose columns have the smallest hash.
    """
    _, of = classes(docs, at_least)
    first = of.where("h1 = c1 and h2 = c2").select("class_id", "c1", "c2")
    named = contents(docs)
    one, two = named.columns[-2:]
    plain = docs.columns
    same = (F.col("doc_id").cast("long") == first["class_id"]) & (F.col(one) == first["c1"]) & (F.col(two) == first["c2"])
    kept = named.where(F.col(one).isNotNull()).join(first.hint("merge"), same, "left_semi")
    place = F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), one, two).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain])))
    kept = kept.withColumn(f"{one}_", place).where(F.col(f"{one}_") == 1)
    return kept.select(plain).unionByName(named.where(F.col(one).isNull()).select(plain))
