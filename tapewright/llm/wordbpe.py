"""Word pieces of the lower-casing word-end BPE vocabulary: splitting, and merging in batched numpy rounds."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from tokenizers import Tokenizer

# The vocabulary's split pattern, written for texts that are already lower case and hold only
# ASCII, Latin-1 and Latin Extended-A characters.
LETTER = "a-zªµºà-öø-ÿßĀ-ſ"
DIGIT = "0-9²³¹¼½¾"
SPACE = "\\t-\\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{DIGIT}{LETTER}]+")
#: İ lower-cases to two characters, ŉ and ŀ-like forms do not; only İ needs the library.
PLAIN = re.compile("[\x00-įı-ſ]*").fullmatch


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(extra)) for b in range(256)]


class Splitter:
    """Cuts a text into what the BPE sees: words, and special strings as they stand."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def plain(self, part: str) -> list[str]:
        if PLAIN(part):
            return WORDS.findall(part.lower())
        norm = self.library.normalizer.normalize_str(part)
        return [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def words(self, text: str) -> list[str]:
        """Special strings come out as themselves; no word can equal one, as words hold either letters or signs."""
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else self.plain(part))]


class Merges:
    """The vocabulary as arrays: pair keys sorted for binary search, with rank and product of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.text = [""] * (max(self.vocab.values()) + 1)
        for token, i in self.vocab.items():
            self.text[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.rank = keys, first.astype(np.int64)
        self.product = np.array([self.vocab[a + b] for a, b in pairs], np.int64)[first]
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word.

        One flat array holds the symbols of all words. In every round the pair of each neighbouring two is looked up
        by binary search, each word takes its lowest rank, and all places of that pair are joined from left to right.
        A product's own pairs rank after the pair that made it, so joining all its places at once equals one by one.
        Words without a pair left the round's arrays.
        """
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        held = lengths > 0
        symbols[ends[held] - 1] = self.last[flat[ends[held] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        never = len(self.keys) + 1
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), never, np.int64)
            product = np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                keys = symbols[:-1] << 32 | symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                good = np.flatnonzero((self.keys[at] == keys) & (word[1:] == word[:-1]))
                rank[good], product[good] = self.rank[at[good]], self.product[at[good]]
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            ended = least == never
            if ended.any():
                for s, n in zip(starts[ended], sizes[ended], strict=True):
                    out[word[s]] = symbols[s : s + n].copy()
                if ended.all():
                    break
                keep = np.repeat(~ended, sizes)
                symbols, word, rank, product = symbols[keep], word[keep], rank[keep], product[keep]
                least, sizes = least[~ended], sizes[~ended]
            join = np.flatnonzero(rank == np.repeat(least, sizes))
            # neighbouring places overlap (a a a): within each run take every other one, from the left
            new_run = np.r_[True, np.diff(join) > 1]
            offset = np.arange(len(join)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            join = join[offset % 2 == 0]
            symbols[join] = product[join]
            stay = np.ones(len(symbols), bool)
            stay[join + 1] = False
            symbols, word = symbols[stay], word[stay]
        return out


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)
