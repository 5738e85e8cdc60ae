"""Operator 7: packing token sequences by minimum bin slack."""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded, doc_columns, texts, tokenizer_path

VOCABULARY, SPECIAL, END = "byte_bpe_50k", {"<|endoftext|>": 50256}, 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The byte-level vocabulary read as ranks; special strings inside a text become their ids, as in the library of the .json form."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coding = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: coding.encode_to_numpy(text, allowed_special="all")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``capacity`` from below.

    Bit s of ``reach`` says that some multiset sums to s. Each length enters in binary portions of its count, so a
    portion costs one shift; the states before every portion stay, and walking them back gives the counts. It stops as
    soon as the capacity is met.
    """
    reach, mask, goal = 1, (1 << capacity + 1) - 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left and not reach & goal:
            take = min(portion, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & mask
            left, portion = left - take, portion * 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


class Packer:
    """Collects documents' ids and gives pieces (doc_id, start, length, crc, doc_tokens, sequence, offset).

    A document's full windows become sequences of their own; what remains of it waits in a pool by length. A window
    takes the multiset of waiting lengths with the least slack; whatever slack is left is cut from a waiting piece, so
    only the very last window can be short. That one is cut into sequences of powers of two, which need no padding.
    """

    def __init__(self, window: int = 2048, first: int = 0, hold: int = 1 << 21):
        self.window, self.sequence, self.hold = window, first, hold
        self.pool: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.out: list[tuple] = []

    def place(self, piece: tuple, offset: int) -> None:
        doc_id, start, ids, n = piece
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.place((doc_id, at, ids[at : at + self.window], n), 0)
            self.sequence += 1
            at += self.window
        if at < n:
            self.wait((doc_id, at, ids[at:].copy(), n))
        if self.waiting > self.hold:
            self.drain(self.hold // 2)

    def wait(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.waiting += len(piece[2])

    def take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= length
        return piece

    def drain(self, until: int) -> None:
        while self.waiting >= max(until, self.window):
            offset = 0
            for length, n in fill({k: len(v) for k, v in self.pool.items()}, self.window).items():
                for _ in range(n):
                    self.place(self.take(length), offset)
                    offset += length
            if slack := self.window - offset:
                doc_id, start, ids, n = self.take(min(k for k in self.pool if k > slack))
                self.place((doc_id, start, ids[:slack], n), offset)
                self.wait((doc_id, start + slack, ids[slack:], n))
            self.sequence += 1

    def finish(self) -> None:
        self.drain(0)
        rest = [self.take(k) for k in sorted(self.pool, reverse=True) for _ in range(len(self.pool[k]))]
        room, offset = 0, 0
        left = sum(len(p[2]) for p in rest)
        for doc_id, start, ids, n in rest:
            while len(ids):
                if not room:
                    room, offset = 1 << left.bit_length() - 1, 0
                k = min(room, len(ids))
                self.place((doc_id, start, ids[:k], n), offset)
                start, ids, offset, room, left = start + k, ids[k:], offset + k, room - k, left - k
                if not room:
                    self.sequence += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.out, strict=True)], names)
            self.out = []


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    Input: doc_id, text (null: empty); a document is its ids and the end id. Each scan partition packs its own
    documents, holding a bounded pool, so nothing is shuffled; a partition that is run again gives the same rows.
    ``sequence_id`` is the partition's number times 2**32 plus a count. Output per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. Empty texts still have their end id; repeated rows are packed as often
    as they stand; other columns are ignored; an empty table gives no pieces.
    """
    path = tokenizer_path(f"{vocabulary}.tiktoken")

    def run(batches):
        encode, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 32)
        end = np.array([END], np.uint32)
        for b in bounded(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                packer.add(doc_id, np.concatenate([encode(text), end]))
            yield from packer.rows()
        packer.finish()
        yield from packer.rows()

    return doc_columns(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
