import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapewright.llm import bpe, packing, token_counts
from tapewright.llm.common import tokenizer_path
from tapewright.llm.wordbpe import merges, splitter

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), "byte_bpe_50k.json"


def hard(n=400):
    rng = random.Random(3)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0, 0x180), lambda: rng.randrange(0, 0x3000)]
    made = ["".join(chr(rng.choice(kinds)()) if rng.random() < 0.85 else rng.choice("'  \n") for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*made, "", "aaaa" * 300, "can't I'LL", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "İ ŉ ΣΑΣ ß ẞ", "日本 ½² é"]


def test_codec_equals_the_library():
    library, codec, lengths = Tokenizer.from_file(WORD), bpe.Codec(WORD), token_counts.Lengths(WORD, 50)
    texts = hard()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)
        assert sum(map(lengths.__getitem__, splitter(WORD).words(text))) == len(want)


def test_merge_rounds_with_overlaps():
    words = ["a" * n for n in range(1, 40)] + ["lalala" * 5, "xyxyxyx"]
    library = Tokenizer.from_file(WORD)
    assert [i.tolist() for i in merges(WORD).encode(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_counts_and_digests(documents, empty):
    library = Tokenizer.from_file(WORD)
    rows = documents.select("doc_id", "text").collect()
    want = sorted((str(r[0]), len(library.encode(r[1] or "", add_special_tokens=False).ids), len((r[1] or "").encode())) for r in rows)
    got = token_counts.count_tokens(documents, limit=100, size=64, cache=128).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in bpe.digests(documents).collect():
        if r["doc_id"] is not None:
            i = ids[r["doc_id"]]
            assert r["n_tokens"] == len(i)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(documents).collect()}
    assert full[906] == ids[906]
    for op in (token_counts.count_tokens, bpe.digests, bpe.encode_decode, packing.pack):
        assert op(empty).count() == 0


def brute(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= capacity}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_the_closest_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 60): rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))}
    used = packing.fill(counts, 100)
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == brute(counts, 100)


def test_packing_covers_every_id_once(documents):
    library = Tokenizer.from_file(tokenizer_path(BYTE))
    rows = packing.pack(documents, window=256).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0  # a full window, or a power of two
    for text, doc_id in ((r["text"], r["doc_id"]) for r in documents.collect()):
        if doc_id in (None, 907):
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in docs[907]) == 2 * docs[907][0]["doc_tokens"]  # a repeated row is packed twice
