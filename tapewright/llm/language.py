"""Operator 2: language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc_mod, doc_columns, mix64

#: Bytes of context; a context and the byte after it fill 40 bits of a 64-bit key.
ORDER = 4
#: Bytes that are scored at once.
PIECE = 1 << 20
UNDEFINED = "und"
ASCII_LETTER = re.compile("[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text the byte with the ``ORDER`` bytes before it (zero bytes before a text's start), and each text's first place."""
    pad = b"\0" * ORDER
    flat = np.frombuffer(b"".join(pad + t for t in texts) or pad, np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    keys = flat[ORDER:].copy()
    for i in range(1, ORDER + 1):
        keys |= flat[ORDER - i : len(flat) - i] << np.uint64(8 * i)
    # places of the padding of all texts but the first are no bytes of any text
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
    for i in range(ORDER):
        inside[ends + i] = False
    return keys[inside], np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


class Tree:
    """One language's context tree with frozen counts.

    For each order: the sorted keys of (context, byte) with their counts, and of contexts with their totals and numbers of
    distinct bytes. A byte after a known context has probability count / (total + distinct); the escape to the next
    shorter context has distinct / (total + distinct); below order 0 all 256 bytes are alike.
    """

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.levels = levels

    @classmethod
    def learn(cls, texts: list[bytes]) -> Tree:
        keys = grams(texts)[0]
        levels = []
        for k in range(ORDER + 1):
            pairs, counts = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
            levels.append((pairs, counts.astype(np.float64), contexts, np.add.reduceat(counts, first).astype(np.float64) if len(first) else counts.astype(np.float64), np.diff(np.r_[first, len(pairs)]).astype(np.float64)))
        return cls(levels)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits for each key's byte after its context."""
        bits = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            pairs, counts, contexts, totals, distinct = self.levels[k]
            if not len(pairs) or not len(open_):
                continue
            wanted = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(contexts, wanted >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == wanted >> np.uint64(8)
            p = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            seen = pairs[p] == wanted
            whole = totals[c] + distinct[c]
            bits[open_[seen]] -= np.log2(counts[p[seen]] / whole[seen])
            escape = known & ~seen
            bits[open_[escape]] -= np.log2(distinct[c[escape]] / whole[escape])
            open_ = open_[~seen]
        bits[open_] += 8.0
        return bits

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.levels)


class Judge:
    """Code lengths of texts under all trees. What a key costs is kept in a direct-mapped table, as most keys come again and again."""

    def __init__(self, trees: list[Tree], slots: int = 1 << 20):
        self.trees = trees
        self.shift = np.uint64(64 - int(np.log2(max(1024, slots * 4 // max(4, len(trees))))))
        n = 1 << int(64 - int(self.shift))
        self.key = np.full(n, np.uint64(2**64 - 1))
        self.cost = np.zeros((n, len(trees)), np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, trees). Long texts are walked in pieces, each with the context before it, so that memory does not follow their length."""
        total = np.zeros((len(texts), len(self.trees)))
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
        total[short] = self.piece([texts[i] for i in short])
        for i, t in enumerate(texts):
            if len(t) > PIECE:
                for s in range(0, len(t), PIECE):
                    total[i] += self.piece([t[s : s + PIECE]], t[max(0, s - ORDER) : s])[0]
        return total

    def piece(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        """(texts, trees), of bytes that follow on ``before``."""
        keys, starts = grams([before + t for t in texts] if before else texts)
        keys = keys[len(before) :]
        total = np.zeros((len(texts), len(self.trees)))
        if not len(keys):
            return total
        slot = (mix64(keys) >> self.shift).astype(np.int64)
        hit = self.key[slot] == keys
        cost = self.cost[slot]
        if not hit.all():
            new, which = np.unique(keys[~hit], return_inverse=True)
            lengths = np.stack([t.code_lengths(new) for t in self.trees], 1).astype(np.float32)
            cost[~hit] = lengths[which]
            at = (mix64(new) >> self.shift).astype(np.int64)
            self.key[at] = new  # of keys that share a slot the last one stays, in both
            self.cost[at] = lengths
        held = np.flatnonzero(np.diff(np.r_[starts, len(keys)]))
        total[held] = np.add.reduceat(cost.astype(np.float64), starts[held], axis=0)
        return total


def fit(docs: DataFrame, rows: Column, sample_mb: float = 1.0, total_mb: float = 12.0) -> dict[str, bytes]:
    """Trees of all languages from the rows of ``docs`` (text, lang) that ``rows`` admits.

    The sample is bounded: whole texts picked by a hash, about ``sample_mb`` MB a language, less where all languages
    together would take more than ``total_mb``; at most twice that, and one text of each language at least. So what is
    broadcast does not grow with the table or the number of languages.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    known = docs.where(rows & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("place", place)
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.min("place").alias("least")).collect()
    if not sizes:
        return {}
    each = 1e6 * min(sample_mb, total_mb / len(sizes))
    until = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], int((1 << 40) * min(1.0, each / r["size"]))))])
    # rows that repeat are one, so that copies don't fill a task
    sample = known.where(F.col("place") <= F.element_at(until, F.col("lang"))).select("lang", "text", "place").distinct()

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "text"])
        raw = [t.encode() for t in pdf["text"]]
        before = np.cumsum([0, *map(len, raw)])[:-1]
        tree = Tree.learn([r for r, b in zip(raw, before, strict=True) if b < 2 * each])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [tree.to_bytes()]})

    return {r["lang"]: bytes(r["tree"]) for r in sample.groupBy("lang").applyInPandas(learn, "lang string, tree binary").toLocalIterator()}


class Verdicts:
    """Texts to (languages, scores, bits a byte), for workers."""

    def __init__(self, names: list[str], trees: list[bytes]):
        self.names, self.judge = names, Judge([Tree(pickle.loads(t)) for t in trees])

    def __call__(self, rows: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        lettered = [bool(self.names) and has_letter(t) for t in rows]
        raw = [t.encode() if ok else b"" for t, ok in zip(rows, lettered, strict=True)]
        bits = self.judge.bits(raw) if self.names else np.zeros((len(rows), 1))
        best = bits.argmin(1)
        least = bits[np.arange(len(rows)), best]
        score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
        each = list(zip(lettered, best.tolist(), score.tolist(), least.tolist(), raw, strict=True))
        return [self.names[i] if ok else UNDEFINED for ok, i, *_ in each], [s if ok else 0.0 for ok, _, s, *_ in each], [n / len(r) if ok else None for ok, _, _, n, r in each]


def identify(docs: DataFrame, sample_mb: float = 1.0, total_mb: float = 12.0, fold: int = 4, held: int = 2, train: DataFrame | None = None) -> DataFrame:
    """The language in which each whole text has the shortest code.

    Learns from rows whose crc32(doc_id) mod ``fold`` is not ``held`` (of ``train`` if given), from a sample of about
    ``sample_mb`` MB a language and ``total_mb`` in all (see ``fit``); predicts from the text alone.
    Output: doc_id, held_out, lang_pred, score (the best language's share of 2**-bits over all), bits_per_byte. Null or
    letterless texts, and all texts if nothing could be learnt, are ``und`` with score 0; empty ones too. Very long texts
    count whole, in pieces. Ties go to the language that sorts first. Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs if train is None else train, sample_mb, total_mb, fold, held))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"))

    def run(batches):
        verdicts = Verdicts(*shared.value)
        for b in bounded(batches, mb=1):
            lang, score, bits = verdicts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(bits, pa.float64())})

    return out.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def learn(docs: DataFrame, sample_mb: float, total_mb: float, fold: int, held: int) -> tuple[list[str], list[bytes]]:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trees = fit(source, F.coalesce(crc_mod("doc_id", fold) != held, F.lit(True)), sample_mb, total_mb)
    return sorted(trees), [trees[n] for n in sorted(trees)]


def keep_language(docs: DataFrame, sample_mb: float = 1.0, total_mb: float = 12.0, least: float = 0.5, fold: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` that have a language: not ``und`` (null, empty and letterless texts are), and with a score of ``least`` at least.

    Columns stay as they are; nothing but the sample, bounded as in ``identify``, is shuffled. Very long texts count whole. Repeated rows each stay or go; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_mb, total_mb, fold, held))

    def run(batches):
        verdicts = Verdicts(*shared.value)
        for b in bounded(batches, mb=1):
            lang, score, _ = verdicts(b.column("text").to_pylist())
            yield b.filter(pa.array([x != UNDEFINED and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
