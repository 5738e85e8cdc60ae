"""Operator 3: language-model scoring by a Katz backoff model of any order over words.

Counts cover all training documents and the tables grow with them, so nothing of the corpus is broadcast. Documents stand
in blocks of about a million tokens. Level by level, from words to n-grams, a block sends its distinct n-grams with their
training counts as packed requests to buckets of contexts; a bucket merges the requests of all blocks, which gives the
level's table (followers, counts and what backoff weights are made of, for each context), and answers each block with the
counts of its n-grams and the weights it has to back off with. With the answers of all levels a block evaluates the model
recursively for each of its tokens.

A level asks for what the levels below have answered, so words travel as numbers (the more frequent, the smaller), and an
n-gram's probability one level down as two counts. Buckets number as many as the tokens ask for, and a very frequent
context is dealt out over several of them, so that no task grows with the corpus.
"""

from __future__ import annotations

import functools
import math
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, crc_mod, mix64, partitions

#: The end of a text; no word holds a space.
END = b" "
#: Counts up to this are discounted, as Katz has it.
K = 5
#: Counts of counts are fitted up to this count.
FITTED = 32
#: Tokens whose requests make one bucket.
BUCKET_TOKENS = 1 << 19
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one packed value: bytes of equal weight stand together, and high ones that are zero throughout are left out."""
    head, parts = [], []
    for a in arrays:
        if a.dtype.kind == "u":
            used = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            parts += [(a >> a.dtype.type(8 * i) if i else a).astype(np.uint8).tobytes() for i in range(used)]
        else:
            used = a.dtype.itemsize
            parts.append(a.tobytes())
        head.append([len(a), used])
    return np.array(head, np.int64).tobytes() + zstandard.compress(b"".join(parts), 1)


def expand(data: bytes, *kinds) -> list[np.ndarray]:
    n = len(kinds)
    head = np.frombuffer(data, np.int64, 2 * n).reshape(n, 2)
    planes, at, out = zstandard.decompress(data[16 * n :]), 0, []
    for (length, used), kind in zip(head.tolist(), map(np.dtype, kinds), strict=True):
        if kind.kind == "u":
            a = np.frombuffer(planes, np.uint8, length, at).astype(kind)
            for i in range(1, used):
                a |= np.frombuffer(planes, np.uint8, length, at + i * length).astype(kind) << kind.type(8 * i)
        else:
            a = np.frombuffer(planes, kind, length, at)
        out.append(a)
        at += length * used
    return out


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, ASCII letters in lower case, cut at ASCII white space; then one end."""
    return [*(text or "").encode().lower().split(), END]


class Number(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks(docs: DataFrame, size: int, fold: int) -> DataFrame:
    """Documents in blocks of about ``size`` tokens: block, n (tokens), taught (training documents), docs (ids, training flags, lengths), body (word numbers), words (their hashes)."""
    held = F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))

    def run(batches):
        base, n = TaskContext.get().partitionId() << 24, 0

        def flush():
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
            ids = np.array([0 if i is None else i for i in doc_ids], np.int64)
            null = np.array([i is None for i in doc_ids], np.uint8)
            packed = squeeze(ids, null, np.array(flags, np.uint8), np.array([len(b) for b in body], np.uint64))
            return pa.RecordBatch.from_pydict({"block": [base + n], "n": [held], "taught": [sum(flags)], "docs": [packed], "body": [squeeze(np.concatenate(body).astype(np.uint32))], "words": [squeeze(hashes)]})

        number, doc_ids, flags, body, held = Number(), [], [], [], 0
        for b in bounded(batches):
            for doc_id, text, out in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                line = tokens(text)
                body.append(np.fromiter(map(number.__getitem__, line), np.uint32, len(line)))
                doc_ids.append(doc_id)
                flags.append(not out)
                held += len(line)
                if held >= size:
                    yield flush()
                    number, doc_ids, flags, body, held, n = Number(), [], [], [], 0, n + 1
        if doc_ids:
            yield flush()

    return source.mapInArrow(run, "block long, n long, taught long, docs binary, body binary, words binary")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and of every place the number of its key. Keys are sorted with their places in one word if they fit."""
    bits = max(1, len(keys) - 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_index=True, return_inverse=True)
    packed = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    order, packed = packed & (1 << bits) - 1, packed >> bits
    new = np.r_[True, packed[1:] != packed[:-1]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return packed[new], order[new], which


def cut(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of those that have members."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    edges = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
    return order, [(i, a, b) for i, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(words) % np.uint64(buckets)).astype(np.int64)


def chain(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words from the hash of all but the last."""
    with np.errstate(over="ignore"):
        return mix64(state * GOLDEN + word.astype(np.uint64) + np.uint64(1))


class Split:
    """Where an n-gram goes: by its context, or for frequent contexts by context and word over as many buckets as the count asks for."""

    def __init__(self, hot: dict[int, int], total: int, buckets: int):
        self.buckets = buckets
        share = max(1.0, total / (4 * buckets))
        chosen = sorted((c, min(buckets, math.ceil(n / share))) for c, n in hot.items() if n >= share)
        self.contexts = np.array([c for c, _ in chosen], np.uint64)
        self.ways = np.array([n for _, n in chosen], np.uint64)

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        return np.isin(contexts, self.contexts)

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = mix64(context)
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            hot = self.contexts[at] == context
            with np.errstate(over="ignore"):
                key[hot] += mix64(word[hot].astype(np.uint64) ^ np.uint64(0x5BD1)) % self.ways[at[hot]]
        return (key % np.uint64(self.buckets)).astype(np.int64)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's d_r for r = 0..K (d_0 unused) from Good-Turing estimates, such that counts beyond K keep theirs.

    Counts of counts are smoothed as in Simple Good-Turing: a line of log Z_r over log r, where Z_r spreads n_r over the
    gap between the neighbouring counts that occur. With the line's slope b, r* / r is (1 + 1/r)**(b + 1). All d lie in
    (0, 1) as soon as b < -1; tables so small that their line is flatter get the slope -1.1, and ones with a single count
    -2, which is that of words by Zipf's law.
    """
    n = np.asarray(counts_of_counts, np.float64)
    r = np.flatnonzero(n[: FITTED + 1] * (np.arange(len(n[: FITTED + 1])) > 0))
    slope = -2.0
    if len(r) > 1:
        before = np.r_[0, r[:-1]]
        after = np.r_[r[1:], 2 * r[-1] - r[-2]]
        z = n[r] / (0.5 * (after - before))
        x, y = np.log(r), np.log(z)
        slope = min(-1.1, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    r = np.arange(1, K + 1)
    rest = (K + 1.0) ** (slope + 1)
    return np.r_[1.0, ((1 + 1 / r) ** (slope + 1) - rest) / (1 - rest)]


class Words:
    """The unigram level: discounted counts of known words, and what that leaves for all unknown words together."""

    def __init__(self, total: int, counts_of_counts: np.ndarray):
        self.total, self.d = max(1, total), discounts(counts_of_counts)
        r = np.arange(K + 1)
        n = np.asarray(counts_of_counts, np.float64)[: K + 1]
        left = ((1 - self.d) * r * n).sum() / self.total if total else 1.0
        # without a rare word nothing would be left; then unknown words get the share of one more token
        self.scale = 1.0 if left > 0 else self.total / (self.total + 1)
        self.unknown = left if left > 0 else 1 / (self.total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.int64)
        return np.where(c > 0, self.scale * kept(self.d, c) / self.total, self.unknown)


def kept(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return np.where(counts > K, 1.0, d[np.minimum(counts, K)]) * counts


class Level:
    """A block's distinct n-grams of one length. Number 0 is the run of text starts, whose count is that of the training texts."""

    def __init__(self, which: np.ndarray, context: np.ndarray, word: np.ndarray, first: np.ndarray, columns: list[np.ndarray], state: np.ndarray):
        self.which = which  # of each token, the n-gram it ends
        self.context, self.word, self.first = context, word, first  # of each n-gram: numbers of its context (a level below) and of its last word, a token that ends it
        self.columns, self.state = columns, state  # its words' global numbers, and their hash
        self.count = self.denominator = self.weight = None


class Block:
    """A block's row, opened, with the levels that were answered so far."""

    def __init__(self, docs: bytes, body: bytes, words: bytes):
        self.ids, self.null, self.train, lengths = expand(docs, np.int64, np.uint8, np.uint8, np.uint64)
        (numbers,) = expand(body, np.uint32)
        (self.words,) = expand(words, np.uint64)
        self.body, self.lengths = numbers.astype(np.int64), lengths.astype(np.int64)
        self.taught = np.repeat(self.train, self.lengths).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.levels: list[Level] = []

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.body[self.taught], minlength=len(self.words))

    def number(self, answers: dict[int, bytes], texts: int, buckets: int) -> None:
        """Level 1, from the words' answers; words are numbered anew in the order of their global numbers."""
        count, known = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.uint64)
        order, parts = cut(word_bucket(self.words, buckets), buckets)
        for bucket, s, e in parts:
            c, rank = expand(answers[bucket], np.uint64, np.uint64)
            count[order[s:e]], known[order[s:e]] = c.astype(np.int64), rank * np.uint64(buckets) + np.uint64(bucket + 1)
        by = np.argsort(known)
        new = np.empty(len(by), np.int64)
        new[by] = np.arange(1, len(by) + 1)
        self.body = new[self.body]
        self.known = np.r_[np.uint64(0), known[by]]
        level = Level(self.body, np.zeros(len(by) + 1, np.int64), np.arange(len(by) + 1), np.zeros(0, np.int64), [self.known], chain(np.zeros(len(by) + 1, np.uint64), self.known))
        level.count = np.r_[texts, count[by]]
        self.levels = [level]

    def deepen(self) -> Level:
        """The next level's n-grams, not answered yet."""
        below, width = self.levels[-1], len(self.known)
        history = np.empty_like(below.which)
        history[1:] = below.which[:-1]
        history[self.starts] = 0
        keys, first, which = distinct(history * width + self.body)
        context, word = np.r_[0, keys // width], np.r_[0, keys % width]
        columns = [c[context] for c in below.columns] + [self.known[word]]
        level = Level(which + 1, context, word, np.r_[0, first], columns, chain(below.state[context], self.known[word]))
        self.levels.append(level)
        return level

    def asked(self, split: Split) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The last level's n-grams (numbers) by bucket, within it by context."""
        top, below = self.levels[-1], self.levels[-2]
        order, parts = cut(split.of(below.state[top.context[1:]], self.known[top.word[1:]]), split.buckets)
        return order + 1, parts

    def settle(self, answers: dict[int, bytes], split: Split, d: np.ndarray, hot: dict[int, tuple[float, np.ndarray]]) -> None:
        """Takes the last level's answers: counts of its n-grams, denominators and logarithms of backoff weights of their contexts."""
        top, below = self.levels[-1], self.levels[-2]
        n = len(below.count)
        top.count, plain = np.zeros(len(top.context), np.int64), np.zeros(n, bool)
        top.count[0] = below.count[0]
        top.weight = np.full(n, np.nan)
        order, parts = self.asked(split)
        for bucket, s, e in parts:
            counts, flags, mass, by_count = expand(answers[bucket], np.uint64, np.uint8, np.float64, np.uint64)
            top.count[order[s:e]] = counts.astype(np.int64)
            contexts = starts_of(top.context[order[s:e]])[0]
            plain[contexts[flags & 2 > 0]] = True
            need = contexts[flags & 1 > 0]
            top.weight[need] = weight(d, below.count[need], mass, by_count.reshape(-1, K).astype(np.int64))
        if hot:
            states = np.array(sorted(hot), np.uint64)
            for i in np.flatnonzero(np.isin(below.state, states)):
                mass, by_count = hot[int(below.state[i])]
                plain[i] = not by_count.any()
                top.weight[i] = weight(d, below.count[[i]], np.array([mass]), by_count[None])[0]
        top.denominator = below.count + plain
        top.d = d

    def log10(self, words: Words) -> np.ndarray:
        """Of each token, by the recursion from words up: a seen n-gram by its discounted count, another by its context's weight times the shorter n-gram's probability."""
        each = np.log10(words.p(self.levels[0].count))
        for below, top in pairwise(self.levels):
            lower = each[below.which[top.first]]
            contexts = below.count[top.context]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log10(kept(top.d, top.count) / np.maximum(top.denominator[top.context], 1))
                unseen = np.where(contexts > 0, top.weight[top.context], 0.0) + lower
            each = np.where(top.count > 0, seen, unseen)
        return each[self.levels[-1].which]


def weight(d: np.ndarray, context: np.ndarray, mass: np.ndarray, by_count: np.ndarray) -> np.ndarray:
    """log10 of backoff weights: what discounting leaves of a context, over what the followers seen there leave of the level below.

    A context whose followers are all frequent leaves one token in its count + 1.
    """
    freed = (by_count * (1 - d[1:]) * np.arange(1, K + 1)).sum(-1)
    with np.errstate(divide="ignore"):
        left = np.where(by_count.any(-1), freed / np.maximum(context, 1), 1 / (context + 1.0))
        return np.log10(left) - np.log10(np.maximum(1 - mass, 1e-12))


def joined(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers that are equal, and in the order, of the pairs (code, word); codes are numbered anew where they would not fit."""
    most = int(word.max()) + 1
    if (int(code.max()) + 1) * most >= 1 << 63:
        code = distinct(code)[2]
        known, _, word = distinct(word.astype(np.int64))
        most = len(known)
    return code * most + word.astype(np.int64)


def starts_of(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal contexts: the contexts, and how many stand in each run."""
    start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    return context[start], np.diff(np.r_[start, len(context)])


ANSWER = "kind string, block long, bucket int, body binary"


def ask_words(buckets: int):
    def run(batches):
        for b in batches:
            for docs, body, words, block in zip(*(b.column(c).to_pylist() for c in ("docs", "body", "words", "block")), strict=True):
                x = Block(docs, body, words)
                counts = x.word_counts().astype(np.uint64)
                order, parts = cut(word_bucket(x.words, buckets), buckets)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(parts), pa.int64()), "bucket": pa.array([i for i, _, _ in parts], pa.int32()), "body": [squeeze(x.words[order[s:e]], counts[order[s:e]]) for _, s, e in parts]})

    return run


def of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, FITTED + 1).astype(np.int64), minlength=FITTED + 2)[: FITTED + 1].astype(np.uint64)


def rows_of(out: list[tuple], pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"kind": [k for k, _, _ in out], "block": [b for _, b, _ in out], "bucket": int(pdf["bucket"].iloc[0]), "body": [x for _, _, x in out]})


def answer_words(buckets: int):
    """One bucket of words: to each block its words' counts and ranks in the bucket; the table; counts of counts, the total and the most frequent words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [expand(b, np.uint64, np.uint64) for b in pdf["body"]]
        words, which = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([c for _, c in asked]), len(words)).astype(np.uint64)
        order = np.lexsort((words, -counts.astype(np.int64)))
        rank = np.empty(len(words), np.uint64)
        rank[order] = np.arange(len(words), dtype=np.uint64)
        out, at = [], 0
        for block, (w, _) in zip(pdf["block"], asked, strict=True):
            mine = which[at : at + len(w)]
            out.append(("answer", block, squeeze(counts[mine], rank[mine])))
            at += len(w)
        bucket = int(pdf["bucket"].iloc[0])
        state = chain(np.zeros(min(8, len(words)), np.uint64), np.arange(min(8, len(words)), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1))
        out.append(("facts", -1, squeeze(np.r_[counts.sum(), (counts > 0).sum()].astype(np.uint64), of_counts(counts), state, counts[order[:8]], np.empty(0, np.uint64), np.empty(0, np.float64), np.empty(0, np.uint64))))
        out.append(("table", -1, squeeze(words[order], counts[order])))
        return rows_of(out, pdf)

    return run


class Levels:
    """What has been learnt so far: the unigram model, and of each further level its split, discounts and split contexts' sums."""

    def __init__(self, texts: int, buckets: int):
        self.texts, self.buckets = texts, buckets
        self.words: Words | None = None
        self.above: list[tuple[Split, np.ndarray, dict]] = []

    def open(self, row, answers: pd.DataFrame) -> Block:
        x = Block(row.docs, row.body, row.words)
        of: dict[int, dict[int, bytes]] = {}
        for level, bucket, body in zip(answers["level"], answers["bucket"], answers["body"], strict=True):
            of.setdefault(level, {})[bucket] = body
        x.number(of[1], self.texts, self.buckets)
        for k, (split, d, hot) in enumerate(self.above, 2):
            x.deepen()
            x.settle(of[k], split, d, hot)
        return x


def ask(levels: Levels, split: Split, turn: int, turns: int):
    """Of one block: the next level's distinct n-grams by bucket: contexts (words, denominators a level below, numbers of followers) and followers (words, counts, counts a level below). In each turn the buckets of that remainder are asked."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            x = levels.open(row, right)
            top, below = x.deepen(), x.levels[-2]
            counts = np.r_[0, np.bincount(top.which[x.taught] - 1, minlength=len(top.context) - 1)].astype(np.uint64)
            shorter = below.which[top.first]  # the n-gram without its first word
            order, parts = x.asked(split)
            # of runs of equal contexts within each bucket: where they start, and what goes with them
            context, ends = top.context[order], np.array([e for _, _, e in parts], np.int64)
            new = np.r_[True, context[1:] != context[:-1]]
            new[ends[:-1]] = True
            start = np.flatnonzero(new)
            many = np.diff(np.r_[start, len(order)]).astype(np.uint64)
            columns = [c[context[start]] for c in below.columns]
            lower = (below.denominator[below.context[shorter[order[start]]]] if below.denominator is not None else np.zeros(len(start))).astype(np.uint64)
            word, counts, short = x.known[top.word[order]], counts[order], below.count[shorter[order]].astype(np.uint64)
            edges = np.searchsorted(start, np.r_[0, ends]).tolist()
            for (bucket, s, e), (i, j) in zip(parts, pairwise(edges), strict=True):
                if bucket % turns != turn:
                    continue
                with np.errstate(over="ignore"):
                    first = np.diff(columns[0][i:j], prepend=np.uint64(0))
                out.append((row.block, bucket, squeeze(first, *(c[i:j] for c in columns[1:]), many[i:j], lower[i:j], word[s:e], counts[s:e], short[s:e])))
        return pd.DataFrame(out, columns=["block", "bucket", "body"])

    return run


def answer(order: int, split: Split, words: Words | None, d: np.ndarray | None):
    """One bucket of ``order``-grams: to each block its counts and the weights it needs; the table; counts of counts, the most frequent, and sums of split contexts.

    The table: contexts (words, numbers of followers), followers (words, counts), and what backoff weights are made of:
    the followers' probability a level below (of contexts of more than one) and how many have each discounted count.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [expand(b, *[np.uint64] * (order + 4)) for b in pdf["body"]]
        for a in asked:
            a[0] = np.cumsum(a[0])
        sizes = [len(a[0]) for a in asked]
        columns = [np.concatenate([a[i] for a in asked]) for i in range(order - 1)]
        followers, lower = (np.concatenate([a[i] for a in asked]).astype(np.int64) for i in (order - 1, order))
        word, count, short = (np.concatenate([a[i] for a in asked]) for i in (order + 1, order + 2, order + 3))
        del asked
        code, state = np.zeros(len(lower), np.int64), np.zeros(len(lower), np.uint64)
        for c in columns:
            code, state = joined(code, c), chain(state, c)
        _, first, code = distinct(code)
        keys, at, which = distinct(joined(np.repeat(code, followers), word))
        owner, own_word, contexts = np.repeat(code, followers)[at], word[at], len(first)
        counts = np.bincount(which, count, len(keys)).astype(np.int64)
        seen = counts > 0
        short = short[at].astype(np.int64)
        p = words.p(short) if d is None else kept(d, short) / np.maximum(lower[first][owner], 1)
        mass = np.bincount(owner[seen], p[seen], contexts)
        by_count = np.stack([np.bincount(owner[counts == r], minlength=contexts) for r in range(1, K + 1)], 1)
        state = state[first]
        hot, plain = split.is_hot(state), ~by_count.any(1) & (np.bincount(owner[seen], minlength=contexts) > 0)
        out, i, j = [], 0, 0
        for block, size in zip(pdf["block"], sizes, strict=True):
            n = followers[i : i + size]
            mine = which[j : j + n.sum()]
            own = code[i : i + size]
            missing = np.add.reduceat((counts[mine] == 0).astype(np.int64), np.cumsum(n) - n) > 0
            need = missing & ~hot[own]
            out.append(("answer", block, squeeze(counts[mine].astype(np.uint64), (need | (plain[own] & ~hot[own]) << 1).astype(np.uint8), mass[own[need]], by_count[own[need]].astype(np.uint64).ravel())))
            i, j = i + size, j + n.sum()
        top = np.argsort(-counts, kind="stable")[:8]
        out.append(("facts", -1, squeeze(np.zeros(2, np.uint64), of_counts(counts), chain(state[owner[top]], own_word[top]), counts[top].astype(np.uint64), state[hot], mass[hot], by_count[hot].astype(np.uint64).ravel())))
        many = np.bincount(owner[seen], minlength=contexts)
        stored = many > 0
        out.append(("table", -1, squeeze(*(c[first][stored] for c in columns), many[stored].astype(np.uint64), own_word[seen], counts[seen].astype(np.uint64), mass[many > 1].astype(np.float32), by_count[stored].astype(np.uint64).ravel())))
        return rows_of(out, pdf)

    return run


def facts(table: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int], dict[int, tuple[float, np.ndarray]]]:
    """What the buckets report of a level: totals, counts of counts, the most frequent n-grams (eight a bucket), and the split contexts' sums (at most four a bucket)."""
    totals, n, top, hot = np.zeros(2), np.zeros(FITTED + 1), {}, {}
    for row in table.where("kind = 'facts'").select("body").toLocalIterator():
        whole, counted, states, counts, split, mass, by_count = expand(bytes(row["body"]), *[np.uint64] * 5, np.float64, np.uint64)
        totals, n = totals + whole, n + counted
        top.update(zip(states.tolist(), counts.tolist(), strict=True))
        for s, m, c in zip(split.tolist(), mass.tolist(), by_count.reshape(-1, K).astype(np.int64), strict=True):
            before = hot.get(s, (0.0, np.zeros(K, np.int64)))
            hot[s] = before[0] + m, before[1] + c
    return totals, n, top, hot


def finish(levels: Levels, total: int, distinct: int):
    """One block's documents, from the answers of all levels."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            x = levels.open(row, right)
            count = x.levels[0].count
            base = np.log10((np.r_[0, count[1:]] + 0.1) / (total + 0.1 * (distinct + 1)))
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.where(x.null > 0, 0, x.ids), "Int64"), "held_out": x.train == 0, "n_tokens": x.lengths,
                "n_known": np.add.reduceat((count[x.body] > 0).astype(np.int64), x.starts), "train_tokens": total,
                "base_score": np.add.reduceat(base[x.body], x.starts), "score": np.add.reduceat(x.log10(levels.words), x.starts),
            }))
            out[-1].loc[x.null > 0, "doc_id"] = pd.NA
        return pd.concat(out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fit(docs: DataFrame, fold: int = 10, order: int = 3, block_tokens: int = 1 << 20) -> tuple[DataFrame, list[DataFrame], DataFrame, Levels, tuple[int, int], Scratch]:
    """(blocks, a table for each level, all answers, the levels' parameters, (tokens, distinct words), scratch); tables have a row of kind "table" for each bucket, see ``answer``.

    The buckets of n-grams are asked in n - 1 turns, so that the shuffle files of only one turn stand at a time.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "katz"), max(1, partitions(spark))
    stored = scratch.put_bucketed(blocks(docs, block_tokens, fold), "block", 2 * parts, "blocks")
    size = stored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("taught"), F.lit(0)).alias("taught")).first()
    buckets = max(parts, math.ceil(size["n"] / BUCKET_TOKENS))
    levels = Levels(size["taught"], buckets)
    tables = [scratch.put(stored.mapInArrow(ask_words(buckets), "block long, bucket int, body binary").groupBy("bucket").applyInPandas(answer_words(buckets), ANSWER), "words")]
    (total, distinct), n, hot, _ = facts(tables[0])
    levels.words = words = Words(int(total), n)
    answered = tables[0].where("kind = 'answer'").select(F.lit(1).alias("level"), "block", "bucket", "body")
    for k in range(2, order + 1):
        # texts start with a run of starts, which no n-gram of the level below holds
        start = np.zeros(1, np.uint64)
        for _ in range(k - 1):
            start = chain(start, np.zeros(1, np.uint64))
        split = Split(hot | {int(start[0]): size["taught"]}, int(total), buckets)
        d = levels.above[-1][1] if levels.above else None
        made, turns = [], k - 1
        for turn in range(turns):
            requests = lambda: stored.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(ask(levels, split, turn, turns), "block long, bucket int, body binary")  # noqa: B023, E731
            made.append(scratch.put(requests().groupBy("bucket").applyInPandas(answer(k, split, words, d), ANSWER), f"level{k}"))
        tables.append(functools.reduce(DataFrame.unionByName, made))
        _, n, hot, sums = facts(tables[-1])
        levels.above.append((split, discounts(n), sums))
        answered = answered.unionByName(tables[-1].where("kind = 'answer'").select(F.lit(k).alias("level"), "block", "bucket", "body"))
    return stored, tables, answered, levels, (int(total), int(distinct)), scratch


def score(docs: DataFrame, fold: int = 10, order: int = 3, block_tokens: int = 1 << 20) -> DataFrame:
    """log10 probability of every whole text under a Katz model of ``order`` words, of the rows whose crc32(doc_id) mod ``fold`` is not 0.

    Output: doc_id, held_out, n_tokens (the end counts), n_known, train_tokens, base_score (smoothed unigram), score.
    Null and empty texts are an end alone; very long ones are a block of their own. All words never seen in training
    together are one more outcome, in ``score`` as in ``base_score``; given any context the probabilities of all known
    words and that outcome sum to 1. Repeated rows count, and are scored, as often as they stand; an empty table gives no
    rows. Words are told apart by a 64-bit hash.
    """
    stored, _, answered, levels, (total, distinct), scratch = fit(docs, fold, order, block_tokens)
    out = scratch.put(stored.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish(levels, total, distinct), SCORED), "scores")
    scratch.forget(stored)
    return out
