"""Operator 10: texts held in a media column, as lossless WebP images of 8-bit samples."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, doc_columns, texts
from .webp import decode, encode_samples

UNIT, SIDE = 64, 16384
#: Samples that one image holds: what an image takes to write and read is bounded by a megabyte of them.
MOST = UNIT * SIDE


def to_payload(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode()
    return raw + b"\0" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def store(payload: bytes) -> bytes:
    """An image of 64 samples a row; past 16,384 rows, several images one after the other."""
    return b"".join(encode_samples(np.frombuffer(payload, np.uint8, min(MOST, len(payload) - i), i), UNIT) for i in range(0, len(payload), MOST))


def images(media: bytes) -> list[np.ndarray]:
    """The samples (rows, columns) of each stored image."""
    out, at = [], 0
    while at < len(media) or not out:
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        width, height, pixels = decode(media[at:end])
        out.append((pixels >> np.uint32(8) & np.uint32(255)).astype(np.uint8).reshape(height, width))
        at = end
    return out


def joined(grids: list[np.ndarray], size: int) -> bytes:
    """The payload of ``size`` bytes that images hold."""
    return b"".join(g.ravel()[: min(MOST, size - MOST * i)].tobytes() for i, g in enumerate(grids))


def load(media: bytes, size: int) -> bytes:
    return joined(images(media), size)


def features(grids: list[np.ndarray]) -> str:
    """Of images as read: size, mean, deviation and entropy of samples, mean step along rows, and a 64-bit hash of block means."""
    return "|".join(describe(g) for g in grids)


def describe(grid: np.ndarray) -> str:
    height, width = grid.shape
    n = grid.size
    counts = np.bincount(grid.ravel(), minlength=256)
    share, value = counts / n, np.arange(256)
    held, mean = share[share > 0], int((counts * value).sum()) / n
    deviation = np.sqrt((share * (value - mean) ** 2).sum())
    step = np.abs(np.diff(grid.astype(np.int16), axis=1)).sum(dtype=np.int64) / max(1, n - height)
    # at least eight rows: short images repeat theirs
    rows = np.linspace(0, height, 9).astype(int)
    if height >= 8:
        tall = np.add.reduceat(grid, rows[:-1], axis=0, dtype=np.int64) / np.diff(rows)[:, None]
    else:
        tall = grid[np.minimum(rows[:-1], height - 1)].astype(np.float64)
    blocks = tall.reshape(8, 8, -1).mean(-1)
    sign = "".join("1" if v else "0" for v in (blocks > np.median(blocks)).ravel())
    return f"{width}x{height};mean={mean:.4f};sd={deviation:.4f};entropy={-(held * np.log2(held)).sum():.4f};step={step:.4f};hash={int(sign, 2):016x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, media binary"


def to_media(docs: DataFrame) -> DataFrame:
    """The media column: doc_id, n_bytes, payload_bytes, media (WebP files, for nearly all texts one).

    Null texts count as empty; equal texts, also of repeated rows, give equal bytes; very long ones are stored whole, in
    several images. An empty table gives no rows.
    """

    def run(batches):
        for b in bounded(batches):
            rows = texts(b)
            made = [to_payload(t) for t in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in rows], pa.int64()), "payload_bytes": pa.array([len(p) for p in made], pa.int64()), "media": pa.array([store(p) for p in made], pa.binary())})

    return doc_columns(docs).mapInArrow(run, SCHEMA)


def pixel_arrays(media: DataFrame) -> DataFrame:
    """The images as arrays: doc_id, image (its number), width, height, pixels (ARGB words, row by row).

    A row for each image of each row, repeated or not; a row without stored bytes has none; an empty table gives no rows.
    """

    def run(batches):
        for b in bounded(batches, rows=64):
            out = []
            for doc_id, stored in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                at, n = 0, 0
                while at < len(stored):
                    end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
                    out.append((doc_id, n, *decode(stored[at:end])))
                    at, n = end, n + 1
            ids, ns, widths, heights, pixels = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "image": pa.array(ns, pa.int32()), "width": pa.array(widths, pa.int32()), "height": pa.array(heights, pa.int32()), "pixels": pa.array(pixels, pa.list_(pa.int64()))})

    return media.mapInArrow(run, "doc_id long, image int, width int, height int, pixels array<long>")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A row for each row, repeated or not; very long texts are read image by image; an empty table gives no rows.
    """

    def run(batches):
        for b in bounded(batches):
            out: dict[str, list] = {k: [] for k in ("payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for size, image in zip(b.column("payload_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                grids = images(image)
                payload = joined(grids, size)
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
                out["media_bytes"].append(len(image))
                out["media_sha256"].append(hashlib.sha256(image).hexdigest())
                out["feature"].append(features(grids))
            kinds = {"tail_crc32": pa.int64(), "media_bytes": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("doc_id", "n_bytes", "payload_bytes")} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
