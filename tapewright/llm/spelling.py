"""Operator 12: spelling variants of the words of a corpus, by pairs of nodes of a trie and of the trie of reversed words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, doc_columns, partitions

WORD = re.compile(r"[A-Za-zÀ-ÿ]+")
HELD = 200_000  # distinct words that a task counts before it hands them on


def count_words(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """(word, n) of every run of letters, pre-aggregated; texts are walked run by run, so none is held in pieces."""
    total: Counter = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        total.clear()
        return out

    for b in bounded(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            here: Counter = Counter()
            # bytes.lower changes A-Z alone
            for m in WORD.finditer(text.encode().lower().decode() if text else ""):
                here[m.group()] += 1
                if len(here) >= HELD:
                    spell(here, doc, total)
                    yield hand_on()
            spell(here, doc, total)
            if len(total) >= HELD:
                yield hand_on()
    if total:
        yield hand_on()


def spell(here: Counter, doc: int | None, total: Counter) -> None:
    """Adds a document's runs to the total, those that the hash picks without one of their code points."""
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in here.items():
        h = zlib.crc32(run.encode(), start)
        if not h % 199:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        total[run] += n
    here.clear()


def vocabulary(docs: DataFrame, least: int = 5, letters: int = 6) -> DataFrame:
    """word, n: results of at least ``letters`` code points that occur at least ``least`` times in all."""
    counts = doc_columns(docs).where("text is not null").mapInArrow(count_words, "word string, n long")
    return counts.where(F.char_length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """Code points that two words begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low agree, the first high don't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def number(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of a partition's sorted words: rank (place in the order) and nodes (of every prefix, the empty one first).

    Words with a common prefix are neighbours, so a word keeps the nodes that it shares with the one before and numbers
    the rest anew. Numbers carry the partition in their upper bits. A partition's first word numbers all its nodes anew,
    in order of depth; ``seams`` tells which of them earlier partitions have already.
    """
    from pyspark import TaskContext

    top = TaskContext.get().partitionId() << 40
    last, nodes, free, rank = "", [top], top + 1, top
    for b in batches:
        out: tuple[list, ...] = ([], [])
        for word in b.column("key").to_pylist():
            nodes = nodes[: shared(last, word) + 1]
            nodes += range(free, free + len(word) + 1 - len(nodes))
            free, last = max(free, nodes[-1] + 1), word
            out[0].append(rank)
            out[1].append(nodes)
            rank += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], [*b.schema.names, "rank", "nodes"])


def seams(numbered: DataFrame) -> dict[int, list[int]]:
    """For each partition of the order but the first, the earlier numbers of the nodes that its first word shares with the words before.

    Two words and their nodes a partition reach the driver; there are as many partitions as the session shuffles into.
    """
    part = F.shiftright("rank", 40)
    ends = numbered.groupBy(part.alias("part")).agg(F.min_by(F.struct("key"), "rank")["key"].alias("first"), F.max_by(F.struct("key", "nodes"), "rank").alias("last"))
    out: dict[int, list[int]] = {}
    before, held = "", []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        own = held[: shared(before, r["first"]) + 1] if held else []
        out[r["part"]] = own
        before, held = r["last"]["key"], [renumber(x, out) for x in r["last"]["nodes"]]
    return out


def renumber(node: int, known: dict[int, list[int]]) -> int:
    own = known[node >> 40]
    at = node & ((1 << 40) - 1)
    return own[at] if at < len(own) else node


def trie(words: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict[int, list[int]]]:
    """The rows of ``words`` with rank and nodes of the trie of their ``key``, distinct strings, and the seams of its partitions."""
    dealt = words.repartitionByRange(partitions(words.sparkSession), "key").sortWithinPartitions("key")
    schema = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    out = scratch.put(dealt.mapInArrow(number, f"{schema}, rank long, nodes array<long>"), name)
    return out, seams(out)


def entries(forward: dict[int, list[int]], backward: dict[int, list[int]]) -> Callable:
    """(prefix, suffix, id, n, kind) of each word: where it is split (kind 0) and where a code point is skipped (1, or 2).

    Skipping any of a run of equal code points gives one result; of these the first is kind 1, the others 2, which only
    count for replacement.
    """

    def run(batches):
        for b in bounded(batches, 2048, 2):
            out: tuple[list, ...] = ([], [], [], [], [])
            for word, i, n, f, r in zip(*(b.column(c).to_pylist() for c in ("word", "id", "n", "nodes", "back")), strict=True):
                size = len(word)
                f, r = [renumber(x, forward) for x in f], [renumber(x, backward) for x in r]
                out[0].extend(f + f[:size])
                out[1].extend(r[::-1] + r[size - 1 :: -1])
                out[2].extend([i] * (2 * size + 1))
                out[3].extend([n] * (2 * size + 1))
                out[4].extend([0] * (size + 1))
                out[4].extend(2 if at and word[at] == word[at - 1] else 1 for at in range(size))
                if len(out[0]) >= 32_768:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["prefix", "suffix", "id", "n", "kind"])
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["prefix", "suffix", "id", "n", "kind"])

    return run


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """id, near, near_n for all pairs of words, both ways, that differ by exactly one inserted, deleted or replaced code point, and the words by id.

    ``words`` has word, distinct, and n. Words that are skipped at the same pair of nodes differ by a replaced code point;
    a word skipped where another is split has one more. A pair of nodes has as many words as the alphabet has letters, and
    one more, at most, whatever the table; so what is gathered of it is bounded. Numbers of nodes are exact: no pair is
    tested twice, and none is missed.
    """
    forward, seam = trie(words.select("word", "n", F.col("word").alias("key")), scratch, "forward")
    ahead = forward.select("word", "n", F.col("rank").alias("id"), "nodes")
    backward, back_seam = trie(ahead.select("id", F.reverse("word").alias("key")), scratch, "backward")
    both = ahead.join(backward.select("id", F.col("nodes").alias("back")), "id")
    met = both.mapInArrow(entries(seam, back_seam), "prefix long, suffix long, id long, n long, kind long").groupBy("prefix", "suffix").agg(F.collect_list(F.struct("id", "n", "kind")).alias("own")).where(F.size("own") > 1)
    one = met.select("own", F.explode("own").alias("a"))
    other = F.filter("own", lambda b: (b["id"] != F.col("a.id")) & (((b["kind"] > 0) & (F.col("a.kind") > 0)) | ((b["kind"] + F.col("a.kind")) == 1)))
    pair = one.select(F.col("a.id").alias("id"), F.explode(other).alias("b"))
    return pair.select("id", F.col("b.id").alias("near"), F.col("b.n").alias("near_n")), ahead.select("id", "word", "n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: where the chain of forms from each id ends. Every round halves the chains, and a form is at least twice its word's n, so rounds are few."""
    now = scratch.put(forms.select("id", F.col("form").alias("root")), "chain")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = scratch.put(step, "chain")
        if step.where("moved").isEmpty():
            return step.select("id", "root")
        done, now = now, step.select("id", "root")
        scratch.drop(done)
        now._scratch_path = step._scratch_path


def variants(docs: DataFrame, least: int = 5, letters: int = 6, times: int = 5) -> DataFrame:
    """Words, their near words and the forms that they are variants of: word, form, root, n, n_near, form_n.

    A word is a run of Latin letters of a text, A-Z in lower case, spelt without one code point where a hash of document
    and run says so; words of fewer than ``letters`` code points or ``least`` occurrences in all don't count. Its form is
    its near word of largest n (ties: the smallest in the order of code points) where that is at least ``times`` its own,
    which must be over 1; its root is the last of the chain of forms, or itself.

    Null and empty texts have no words; a null doc_id counts as empty in the hash; each row counts, repeated or not. An
    empty table gives no rows. Runs may be of any length: a word of L code points has 2 L + 1 pairs of nodes, each two numbers.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    scratch = Scratch(docs.sparkSession, "spelling")
    pairs, words = near_words(scratch.put(vocabulary(docs, least, letters), "words"), scratch)
    # ids rise in the order of code points
    near = pairs.groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("m"))).alias("best"))
    known = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best.near_n") >= times * F.col("n"), F.struct((-F.col("best.m")).alias("id"), F.col("best.near_n").alias("n"))).alias("of"))
    known = scratch.put(known, "known")
    root = roots(known.where("of is not null").select("id", F.col("of.id").alias("form")), scratch)
    name = known.select(F.col("id").alias("key"), "word")
    found = known.join(root, "id", "left").select("id", "word", "n", "n_near", F.col("of.id").alias("form_id"), F.col("of.n").alias("form_n"), "root")
    form, last = (name.select(F.col("key").alias(f"{c}_id"), F.col("word").alias(c)) for c in ("form", "root"))
    out = found.withColumnRenamed("root", "root_id").join(form, "form_id", "left").join(last, "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
