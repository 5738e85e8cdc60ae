import hashlib
import zlib

import numpy as np
import pytest

from tapewright.llm import media, webp
from tapewright.llm.webp import CROSS_COLOR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Writer, canonical, channels, container, header, put_flat, put_single, words


def test_payloads_round_trip():
    for text in ["", "a", "ab" * 40, "abcd" * 33, "abcdefgh" * 17, "".join(map(chr, range(32, 127))) * 3, "é日本" * 50, "x" * 1_200_000]:
        payload = media.to_payload(text)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
        assert media.load(media.store(payload), len(payload)) == payload


def test_every_palette_size_round_trips():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 15, 16, 17, 31, 32, 33, 64, 100, 128, 129, 255, 256]:
        values = rng.permutation(256)[:n].astype(np.uint8)
        samples = np.r_[values, rng.choice(values, 64 * 7 - n)].astype(np.uint8)
        assert (webp.decode_samples(webp.encode_samples(samples, 64)) == samples).all()


class Coder:
    """A slow encoder for all of the format that the reader must take."""

    def __init__(self, width, height):
        self.w, self.width, self.height = Writer(), width, height
        header(self.w, width, height)

    def prefix(self, counts):
        """Writes a prefix code with a length for every symbol in use; returns it."""
        used = sorted(counts)
        if len(used) == 1:
            if used[0] < 256:
                put_single(self.w, used[0])
                return {used[0]: (0, 0)}
            used = [0, used[0]]
        lengths = [0] * 2330
        depth = max(1, (len(used) - 1).bit_length())
        spare = (1 << depth) - len(used)  # so many codes can be one shorter
        for i, s in enumerate(sorted(used, key=lambda s: -counts.get(s, 0))):
            lengths[s] = depth - 1 if i < spare else depth
        while sum(2.0**-n for n in lengths if n) > 1 + 1e-12:
            raise AssertionError
        order = webp.CODE_LENGTH_ORDER
        self.w.put(0, 1)
        self.w.put(15, 4)
        have = canonical([4 if s < 16 else 0 for s in range(19)])
        for s in order:
            self.w.put(4 if s < 16 else 0, 3)
        self.w.put(0, 1)
        for n in lengths[: self.size]:
            self.w.code(have[n])
        return canonical(lengths)

    def image(self, pixels, width, main, cache_bits=0, refs=None):
        """``refs``: places where (length, distance code) is written instead of pixels."""
        refs = refs or {}
        self.w.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.w.put(cache_bits, 4)
        if main:
            self.w.put(0, 1)
        cache, out, at = {}, [], 0
        while at < len(pixels):
            p = int(pixels[at])
            slot = (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0
            if at in refs:
                n, code = refs[at]
                out.append(("ref", n, code))
                for q in pixels[at : at + n]:
                    cache[(webp.CACHE_MULTIPLIER * int(q) & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0] = int(q)
                at += n
                continue
            out.append(("cache", slot, 0) if cache_bits and cache.get(slot) == p else ("pixel", p, 0))
            cache[slot] = p
            at += 1
        split = lambda v: (v - 1, 0, 0) if v <= 4 else (2 * (k := (v - 1).bit_length() - 2) + 2 + ((v - 1) >> k & 1), k, (v - 1) & (1 << k) - 1)
        seen = [{} for _ in range(5)]
        for kind, a, b in out:
            symbols = [(0, 256 + split(a)[0]), (4, split(b)[0])] if kind == "ref" else [(0, 280 + a)] if kind == "cache" else [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
            for i, s in symbols:
                seen[i][s] = seen[i].get(s, 0) + 1
        codes = []
        for i, counts in enumerate(seen):
            self.size = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)[i]
            codes.append(self.prefix(counts or {0: 1}))
        for kind, a, b in out:
            if kind == "ref":
                for i, v in ((0, a), (4, b)):
                    s, k, extra = split(v)
                    self.w.code(codes[i][256 + s if i == 0 else s])
                    self.w.put(extra, k)
            elif kind == "cache":
                self.w.code(codes[0][280 + a])
            else:
                for i, s in ((0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)):
                    self.w.code(codes[i][s])

    def transform(self, kind):
        self.w.put(1 | kind << 1, 3)

    def end(self):
        self.w.put(0, 1)

    def file(self):
        return container(self.w.bits())


def picture(width=21, height=17, seed=1, colors=None):
    rng = np.random.default_rng(seed)
    if colors:
        return rng.choice(rng.integers(0, 2**32, colors, dtype=np.uint32), width * height)
    ramp = np.add.outer(np.arange(height) * 3, np.arange(width) * 5)
    return words(np.stack([255 - ramp % 7, ramp % 256, ramp * 2 % 256, ramp * 3 + rng.integers(0, 5, ramp.shape)], -1).reshape(-1, 4) & 255)


def check(coder, pixels):
    width, height, got = webp.decode(coder.file())
    assert (width, height) == (coder.width, coder.height)
    assert (got == pixels).all()


def test_plain_and_cached_pixels():
    for cache_bits in (0, 1, 4, 11):
        p = picture(colors=9)
        c = Coder(21, 17)
        c.end()
        c.image(p, 21, True, cache_bits)
        check(c, p)


def test_back_references():
    p = np.tile(picture(21, 1), 17)
    c = Coder(21, 17)
    c.end()
    c.image(p, 21, True, 3, {21: (21, 1), 42: (40, 21 + 120), 82: (275, 1)})  # distance code 1 is the pixel above
    check(c, p)
    run = np.full(21 * 17, np.uint32(0xFF102030))
    c = Coder(21, 17)
    c.end()
    c.image(run, 21, True, 0, {1: (356, 2)})  # code 2 is the pixel to the left, and overlaps itself
    check(c, run)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    p, tile = picture(), 3
    modes = np.full(3 * 3, mode, np.uint32)
    c = Coder(21, 17)
    c.transform(PREDICTOR)
    c.w.put(tile - 2, 3)
    c.image(modes << 8 | np.uint32(0xFF000000), 3, False)
    c.end()
    c.image(webp.predict(p, 21, modes, tile, True), 21, True)
    check(c, p)


def test_cross_color_and_green():
    p, tile = picture(), 2
    rng = np.random.default_rng(4)
    elements = words(np.stack([np.full(30, 255), *(rng.integers(0, 256, 30) for _ in range(3))], -1))
    c = Coder(21, 17)
    c.transform(CROSS_COLOR)
    c.w.put(tile - 2, 3)
    c.image(elements, 6, False)
    c.transform(SUBTRACT_GREEN)
    c.end()
    after = webp.cross_color(p, 21, elements, tile, True)
    parts = channels(after)
    parts[:, 1] -= parts[:, 2]
    parts[:, 3] -= parts[:, 2]
    c.image(words(parts & 255), 21, True)
    check(c, p)


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 11, 16, 40])
def test_palettes(colors):
    p = picture(colors=colors)
    palette = np.unique(p)
    index = np.searchsorted(palette, p).reshape(17, 21)
    shift = webp.per_word(len(palette))
    bits = 8 >> shift
    wide = np.pad(index, ((0, 0), (0, -21 % (1 << shift)))).reshape(17, -1, 1 << shift)
    packed = (wide << bits * np.arange(1 << shift)).sum(-1).ravel().astype(np.uint32)
    c = Coder(21, 17)
    c.transform(PALETTE)
    c.w.put(len(palette) - 1, 8)
    steps = np.diff(np.r_[np.zeros((1, 4), np.int32), channels(palette)], axis=0) & 255
    c.image(words(steps), len(palette), False)
    c.end()
    c.image(packed << 8, 0, True)
    check(c, p)


def test_broken_files_raise():
    whole = media.store(media.to_payload("some text"))
    for bad in (b"", b"RIFF", whole[:30], whole[:20] + b"\x00" + whole[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_flat_codes_are_the_plain_ones():
    for k in range(1, 9):
        w = Writer()
        put_flat(w, k)
        w.put(0, 32)
        width, symbols = webp.read_prefix(webp.Bits(np.packbits(w.bits(), bitorder="little").tobytes()), 280).even
        assert width == k and symbols.tolist() == list(range(1 << k))


def test_media_column(documents, empty):
    rows = {r["doc_id"]: r for r in media.read_media(media.to_media(documents)).collect()}
    for r in documents.collect():
        if r["doc_id"] is None:
            continue
        payload = media.to_payload(r["text"] or "")
        got = rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"]) == (len((r["text"] or "").encode()), len(payload))
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[907]["media_sha256"] == rows[908]["media_sha256"] and rows[900]["feature"] == rows[901]["feature"]
    assert media.read_media(media.to_media(empty)).count() == 0


def test_written_files_use_prefix_codes_and_back_references(monkeypatch, documents):
    """Of ordinary texts: shorter than plain numbering, read by the general rules as by the fast ones."""
    rng = np.random.default_rng(8)
    line = "".join(rng.choice(list("etaoin shrdlu,."), 90)) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = "\n".join(line if i % 3 == 0 else "".join(rng.choice(list("etaoin shrdlucmfwypvbgkjqxz"), 70)) for i in range(400))
    reads = {"greens": 0, "refs": 0}
    greens, far = webp.read_greens, webp.distance
    monkeypatch.setattr(webp, "read_greens", lambda *a: [reads.__setitem__("greens", reads["greens"] + 1), greens(*a)][1])
    monkeypatch.setattr(webp, "distance", lambda *a: [reads.__setitem__("refs", reads["refs"] + 1), far(*a)][1])
    payload = media.to_payload(text)
    stored = media.store(payload)
    assert media.load(stored, len(payload)) == payload
    assert reads == {"greens": 1, "refs": 133} and len(stored) < 0.55 * len(payload)
    reads["greens"] = 0
    for r in documents.collect():
        p = media.to_payload(r["text"] or "")
        assert media.load(media.store(p), len(p)) == p
    assert reads["greens"] > 10  # those of more than sixteen letters
    # bit by bit
    width, height, fast = webp.decode(stored)
    slow = webp.Prefix.read
    monkeypatch.setattr(webp, "read_greens", lambda bits, total, width, green, far_: plain_greens(bits, total, width, green, far_, slow))
    assert (webp.decode(stored)[2] == fast).all()


def plain_greens(bits, total, width, green, far, read):
    out = []
    while len(out) < total:
        s = read(green, bits)
        if s < 256:
            out.append(s)
        else:
            n = webp.extended(s - 256, bits)
            d = webp.distance(webp.extended(read(far, bits), bits), width)
            for _ in range(n):
                out.append(out[-d])
    return np.array(out, np.uint8)


def test_windows_and_every_number_of_colours(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(webp, "WINDOW", 512)
    for n in [17, 18, 40, 60, 61, 100, 200, 230, 240, 241, 242, 256]:
        p = 1.0 / np.arange(1, n + 1)
        samples = np.r_[np.arange(n), rng.choice(n, 64 * 40 - n, p=p / p.sum())].astype(np.uint8)
        samples[-30:] = 0
        assert (webp.decode_samples(webp.encode_samples(samples, 64)) == samples).all()
    for text in ("a\n" * 5000, ("x" * 5000 + "\n") * 4 + "".join(map(chr, range(32, 120))), "".join(map(chr, range(48, 110))) + "\0" * 500):
        p = media.to_payload(text)
        assert media.load(media.store(p), len(p)) == p


def test_long_texts_take_several_images(monkeypatch, spark):
    monkeypatch.setattr(media, "MOST", 1024)
    text = "".join(map(chr, np.random.default_rng(1).integers(32, 120, 5000)))
    p = media.to_payload(text)
    stored = media.store(p)
    assert len(media.images(stored)) == 5 and media.load(stored, len(p)) == p and media.features(media.images(stored)).count("|") == 4


def test_pixel_arrays(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.pixel_arrays(media.to_media(docs)).collect()}
    assert bytes(v >> 8 & 255 for v in got[1]["pixels"]) == b"some words" + b"\0" * 54 and (got[2]["width"], got[2]["height"]) == (64, 1)
