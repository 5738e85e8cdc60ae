"""DartMinHash signatures of weighted shingle sets, and their exact weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64, unit

SHINGLE, SLOTS, BANDS = 5, 120, 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word to 64-bit hash; bounded, it starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


class Shingler:
    """Texts to weighted sets: hashes of five consecutive words (a shorter text: of all its words), in lower case, cut at white space.

    A shingle that stands once weighs 1, and one more for each doubling of its count.
    """

    def __init__(self):
        self.hashes = Hashes()

    def words(self, text: str) -> np.ndarray:
        line = text.lower().split()
        return np.fromiter(map(self.hashes.__getitem__, line), np.uint64, len(line))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        n = min(SHINGLE, len(words))
        h = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            h = mix64(h ^ words[i : len(words) - n + 1 + i]) + GOLDEN
        return h

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of text, shingle, weight) of all sets, in order, and each text's 128-bit content hash (two words)."""
        words = [self.words(t) for t in texts]
        content = np.array([[xxhash.xxh3_64_intdigest(w.tobytes(), s) for s in (1, 2)] for w in words], np.uint64).reshape(-1, 2)
        each = [self.shingles(w) for w in words]
        doc = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        h = np.concatenate(each) if each else np.empty(0, np.uint64)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, np.int64)
        counts = np.diff(np.r_[new, len(h)])
        return doc[new], h[new], 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), content


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) words; a slot of two sets is equal with the probability of their weighted Jaccard similarity.

    Each unit of an element's weight is a region that darts hit at hashed ranks, a Poisson process of rate 1 that is the
    same whatever set the region is in. A dart carries a hashed slot; each slot keeps the earliest dart. Darts are thrown
    up to the rank by which all slots are likely to be hit, which is the sooner the more a set weighs, so their number
    does not depend on a set's size. A set that has a slot left is thrown anew, up to twice the rank.
    """
    out = np.zeros((n, slots), np.uint64)
    total = np.bincount(doc, weight, n)
    cell_doc = np.repeat(doc, weight)
    first = np.repeat(np.cumsum(weight) - weight, weight)
    layer = (np.arange(len(cell_doc)) - first).astype(np.uint64)
    cell = mix64(np.repeat(element, weight) + layer * GOLDEN)
    limit = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        on = todo[cell_doc]
        who, seed = cell_doc[on], cell[on]
        rank = np.zeros(len(who))
        best = np.full(n * slots, np.inf)
        got: list[tuple] = []
        step = np.uint64(0)
        with np.errstate(over="ignore"):
            while len(who):
                step += np.uint64(1)
                h = mix64(seed + step * GOLDEN)
                rank = rank - np.log(unit(h))
                alive = rank <= limit[who]
                who, seed, rank, h = who[alive], seed[alive], rank[alive], h[alive]
                dart = mix64(h ^ GOLDEN)
                place = who * slots + (dart % np.uint64(slots)).astype(np.int64)
                np.minimum.at(best, place, rank)
                got.append((place, rank, dart))
        place, rank, dart = (np.concatenate(x) for x in zip(*got, strict=True))
        win = rank == best[place]
        out.reshape(-1)[place[win]] = dart[win]
        empty = np.isinf(best.reshape(n, slots)).any(1)
        todo &= empty
        limit = np.where(todo, 2 * limit, limit)
    return out


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """(n, count) keys of runs of slots."""
    rows = signature.reshape(len(signature), count, -1)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN, rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        key = mix64(key ^ rows[:, :, i]) + GOLDEN
    return key


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole else 0.0
