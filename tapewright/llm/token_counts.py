"""Operator 1: token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to all workers; tier two is a
bounded cache in each worker, filled by encoding misses. No pre-token is ever shuffled: the frequent ones are those of a
bounded sample of texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, doc_columns, texts, tokenizer_path
from .wordbpe import byte_letters, splitter

VOCABULARY = "word_bpe_49k.json"


class Lengths(dict):
    """Tier two: pre-token to token count; a miss is encoded and kept until the bound, then the cache starts anew."""

    def __init__(self, path: str, bound: int):
        super().__init__()
        self.model, self.special, self.bound = splitter(path).library.model, splitter(path).special, bound
        letters = byte_letters()
        self.letters = lambda w: "".join(map(letters.__getitem__, w.encode()))

    def __missing__(self, word: str) -> int:
        if word in self.special:
            return 1
        if len(self) >= self.bound:
            self.clear()
        n = self[word] = len(self.model.tokenize(self.letters(word)))
        return n


class Frequent(dict):
    """Tier one; what it lacks is asked of tier two."""

    def __init__(self, words: list[str], lengths: np.ndarray, misses: Lengths):
        super().__init__(zip(words, lengths.tolist(), strict=True))
        self.misses = misses

    def __missing__(self, word: str) -> int:
        return self.misses[word]


def frequent(docs: DataFrame, size: int = 32768, path: str | None = None, sample_mb: float = 4.0) -> tuple[list[str], np.ndarray]:
    """The most frequent pre-tokens of a sample and their token counts: at most ``size`` entries of at most 40 characters.

    The sample is of whole texts of up to a megabyte, picked by a hash, about ``sample_mb`` MB in all whatever the size of
    the table, repeated texts once; only it reaches the driver. Which words are in the table decides which tier answers, never a result.
    """
    path = path or tokenizer_path(VOCABULARY)
    length, place = F.octet_length("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    total = docs.agg(F.coalesce(F.sum(length), F.lit(0)).alias("n")).first()["n"]
    picked = docs.where((place <= int((1 << 40) * min(1.0, sample_mb * 1e6 / max(1, total)))) & (length < 1 << 20)).select("text").distinct()
    split, seen = splitter(path), Counter()
    for row in picked.toLocalIterator():
        seen.update(w for w in split.words(row["text"]) if len(w) <= 40)
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
    lengths = Lengths(path, size + 1)
    return words, np.array([lengths[w] for w in words], np.uint8)


def count_tokens(docs: DataFrame, limit: int = 2048, size: int = 32768, cache: int = 200_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token count of every whole text.

    Input: doc_id, text; other columns are ignored. Output: doc_id, n_bytes (UTF-8), n_tokens, over_limit. Null and empty
    texts have 0 tokens; very long ones are split whole; repeated rows each give a row; an empty table gives an empty result. Special strings inside a
    text count as one token each, as the vocabulary's library does by default.
    """
    path, spark = tokenizer_path(vocabulary), docs.sparkSession
    docs = doc_columns(docs)
    words, lengths = frequent(docs, size, path)
    shared = spark.sparkContext.broadcast(("\n".join(words).encode(), lengths.tobytes()))

    def run(batches):
        blob, counts = shared.value
        tier = Frequent(blob.decode().split("\n") if counts else [], np.frombuffer(counts, np.uint8), Lengths(path, cache))
        split, get = splitter(path).words, tier.__getitem__
        for b in bounded(batches):
            rows = texts(b)
            n = [sum(map(get, split(t))) for t in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in rows], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
