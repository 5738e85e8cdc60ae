"""Operator 6: BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, doc_columns, texts, tokenizer_path
from .wordbpe import merges, splitter

VOCABULARY = "word_bpe_49k.json"


class Codec:
    """Encodes texts by way of the distinct words of a batch; ids of words seen before come from a bounded cache."""

    def __init__(self, path: str, bound: int = 150_000):
        self.split, self.merges, self.bound = splitter(path), merges(path), bound
        self.ids: dict[str, np.ndarray] = {}
        self.reset()
        self.token = list(self.merges.text)
        for text, i in self.split.special.items():
            if i >= len(self.token):
                self.token += [""] * (i + 1 - len(self.token))
            self.token[i] = text

    def reset(self) -> None:
        self.ids = {s: np.array([i]) for s, i in self.split.special.items()}

    def learn(self, rows: list[list[str]]) -> None:
        new = {w for r in rows for w in r if w not in self.ids}
        if len(self.ids) + len(new) > self.bound:
            self.reset()
            new = {w for r in rows for w in r if w not in self.ids}
        new_words = list(new)
        self.ids.update(zip(new_words, self.merges.encode(new_words), strict=True))

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        words = [self.split.words(t) for t in rows]
        self.learn(words)
        empty = np.empty(0, np.int64)
        return [np.concatenate([self.ids[w] for w in r]) if r else empty for r in words]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, word-end marks kept: the vocabulary names no decoder."""
        return " ".join(map(self.token.__getitem__, np.asarray(ids).tolist()))


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids and decoded text of every whole text: doc_id, ids array<int>, decoded string.

    Null and empty texts give no ids and an empty decoded text; repeated rows each give a row; other columns are
    ignored. Very long words are merged in the same rounds as short ones. An empty table gives no rows.
    """
    path = tokenizer_path(vocabulary)

    def run(batches):
        codec = Codec(path)
        for b in bounded(batches):
            ids = codec.encode(texts(b))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([codec.decode(i) for i in ids], pa.string())})

    return doc_columns(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``; ids and texts stay in the worker. Rows at the edges are as there; an empty table gives none."""
    path = tokenizer_path(vocabulary)

    def run(batches):
        codec = Codec(path)
        number = [str(i) for i in range(len(codec.token))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in bounded(batches):
            ids = codec.encode(texts(b))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([sha(" ".join(map(number.__getitem__, i.tolist()))) for i in ids], pa.string()),
                "decoded_sha256": pa.array([sha(codec.decode(i)) for i in ids], pa.string()),
            })

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
