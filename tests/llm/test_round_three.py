"""Hard negatives, spelling variants and secrets, each held against a plain version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapewright.llm import credentials, negatives, spelling

VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, block int, d int, windows int, anchor_id long, rank int"


@pytest.mark.parametrize(("most", "dims"), [(300, 64), (2**31 - 1, 1), (2**28, 50), (2**20, 3000), (0, 3)])
def test_scores_are_exact(most, dims):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-most, most + 1, (9, dims)), rng.integers(-most, most + 1, (13, dims))
    assert (negatives.scores(a, b) == np.array(a.astype(object) @ b.astype(object).T)).all()


def test_top_keeps_the_highest_and_smallest_ids():
    rng = np.random.default_rng(1)
    score, good = rng.integers(0, 6, (20, 500)), rng.random((20, 500)) < 0.7
    top = negatives.Top(20, 7)
    for s in range(0, 500, 60):
        top.add(score[:, s : s + 60], good[:, s : s + 60], np.arange(s, min(500, s + 60)))
    for r in range(20):
        want = sorted((-int(v), c) for c, v in enumerate(score[r]) if good[r, c])[:7]
        assert [(-s, c) for s, c in zip(top.score[top.row == r].tolist(), top.id[top.row == r].tolist(), strict=True)] == want


def vector_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (6, 8))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(0, 0.05, 8)).tolist(), int(rng.integers(0, 10))) for i in range(0, 1500)]
    rows += [(i, rows[3][1], 1) for i in range(2000, 2900)]  # one vector a third of all, some of its rows anchors
    rows += [(3000, None, 1), (3100, [0.1] * 8, None), (3200, [0.1, None] * 4, 1), (3300, [float("nan")] * 8, 1), (3400, [float("inf")] * 8, 1), (3500, [], 1), (None, [0.1] * 8, 1)]
    rows += [(3600, [0.1] * 3, 1), (3601, [0.1] * 3, 1), (3602, [0.05] * 3, 2), (3700, [0.0] * 8, 2), (3800, [1e30] * 8, 1), (-700, [9.0, -8.0] * 4, -1), (-699, [9.0, -7.0] * 4, 1)]
    rows += [(4000, [5e6, 1.0], 4), (4001, [4e6, 1.0], 4), (4002, [2e6, 3.0], 5)]  # scores beyond 53 bits
    return rows + rows[100:110] + [(100, [5.0] * 8, 9)]  # repeated rows, and an id with another vector


def plain_negatives(rows):
    whole = {}
    for i, v, label in rows:
        if i is None or not v or label is None or None in v or not np.isfinite(v).all():
            continue
        x = [int(np.floor(256 * c)) for c in v]
        if len(x) * max(map(abs, x)) ** 2 >= 2**62:
            continue
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        kind = "<i2" if max(map(abs, x)) < 1 << 15 else "<i8"
        whole.setdefault(i, []).append((label, len(x), np.array(x, kind).tobytes(), tuple(x)))
    one = {i: min(x) for i, x in whole.items()}
    out = []
    for a, (label, size, _, x) in one.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, o[3], strict=True)) for i, o in one.items() if o[1] == size and i != a}
        for p in sorted((i for i in score if one[i][0] == label), key=lambda i: (-score[i], i))[:5]:
            fit = (i for i in score if one[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p])
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_held", "chunk", "tile"), [(131_072, 256, 1024), (300, 5, 64)])
def test_hard_negatives_equal_brute_force(spark, rows_held, chunk, tile, monkeypatch):
    for name, value in (("ROWS", rows_held), ("CHUNK", chunk), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], VECTORS).repartition(5)
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == plain_negatives(rows)
    assert {4000, 2000, 3600, -700} & {r[0] for r in got} and max(r[5] for r in got) > 2**53


def test_hard_negatives_of_nothing(spark):
    none = negatives.mine(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (b, a) if len(a) < len(b) else (a, b)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows, least=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    with_gap = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            with_gap.setdefault(key, set()).add(w)
    beside = {w: {b for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for b in with_gap[key] if near(w, b)} for w in words}
    best = {w: min(b, key=lambda x: (-words[x], x)) if b else None for w, b in beside.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n, len(beside[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def spelling_rows():
    rng = np.random.default_rng(3)
    stems = ["garden", "gardens", "gardena", "aabbaa", "aabbaaa", "naïveté", "naiveté", "strasse", "straßen", "x×÷yzzz", "ÀÉÎõüÿ"]
    rows = []
    for d in range(400):
        words = []
        for s in stems:
            at = rng.integers(0, len(s) + 1)
            letter = "abcé"[rng.integers(4)]
            words += [s] * int(rng.integers(1, 40)) + [s[:at] + letter + s[at:], s[:at] + letter + s[at + 1 :], s[:at] + s[at + 1 :]]
        rows.append((d, " ".join(words)))
    # a chain of forms, each five times as frequent; more words beside one than letters in it; a very long run
    rows += [(1000 + i, " ".join(["chainaa"] * 5 + ["chainab"] * 25 + ["chainbb"] * 125 + ["chaicbb"] * 625)) for i in range(2)]
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    rows += [(1100 + i, " ".join(f"wxyz{c}tuv" for c in letters)) for i in range(9)]
    long = "q" * 20_000 + "r" * 20_000
    rows += [(1200 + i, f"{long}, {long[:-1]}\n{long[:100]}s{long[101:]}") for i in range(6)]
    return rows + [(None, "garden garden Garden"), (None, None), (5, None), (6, ""), (7, "123 !! 日本語"), rows[3], rows[3]]


def test_spelling_equals_brute_force(spark):
    rows = spelling_rows()
    df = spark.createDataFrame([(*r, "x", "y", 3, 4, 5) for r in rows], "doc_id long, text string, word string, form string, n long, id long, key int").repartition(6)
    got = spelling.variants(df).collect()
    want = plain_variants(rows)
    assert {r["word"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert want["chainaa"][2] == "chaicbb" and want["chainaa"][1] == "chainab" and max(x[4] for x in want.values()) >= 80
    assert any(len(w) == 39_999 and x[4] == 1 for w, x in want.items())


def test_spelling_hands_on_what_it_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = spelling_rows()[:40]
    got = {r["word"]: tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_variants(rows)


def test_spelling_of_nothing(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def plain_secrets(text, reach=500):
    text = text or ""
    link = r"""["']?\x20*[:=]\x20*["']?"""
    base, weak = [], []
    for m in re.finditer(r"(?ai:password|passwd|secret|token|api_?key)" + link + r"([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            base.append((m.start(), 0, m.end()))
        elif len(m[1]) >= 6:
            weak.append((m.start(), 4, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    weak += [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"(?ai:user_?name|user|login|account|client_?id|key_?id)" + link + r"[A-Za-z0-9@._-]{3,}", text)]
    place = r"(?:(?ai:https?|wss?|ftps?|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|rediss?|mongodb|amqps?|s3)://|(?ai:endpoint|hostname|host|server)" + link + r")[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}"
    weak += [(m.start(), 6, m.end()) for m in re.finditer(place, text)]
    scope = {s: len(re.findall(r"\n[ \t\r]*\n", text[:s])) for s, _, _ in base + weak}
    part = {0: "secret", 3: "secret", 4: "secret", 1: "strong", 5: "weak", 6: "endpoint"}
    told = list(base)
    for s, k, e in weak:
        has = {part[o] for at, o, _ in base + weak if o in part and abs(at - s) <= reach and scope[at] == scope[s]}
        if k in (3, 4):
            holds = "strong" in has or {"weak", "endpoint"} <= has
        elif k == 5:
            holds = {"secret", "endpoint"} <= has
        else:
            holds = bool(has & {"strong", "weak"}) and "secret" in has
        if holds:
            told.append((s, k, e))
    said = lambda spans: ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(told))


def secret_texts():
    key, mixed = "AKIA" + "Q7" * 8, "aB3" * 13 + "x"
    rng = np.random.default_rng(4)
    parts = [key, mixed, "user: bob_1", "Login='x.y'", "https://db.example.org:5432/a?b=c", "host = db1.local", "password=short1", 'API_KEY: "abcdefghijkl"', "token=abc", "0123456789abcdef01", "😀é", "\n\n", "\n \t\r\n", " ", "word " * 30, "x" * 480, "Secret = = zz", "PASSWORD='aaaaaaaaaaaa=='", "AKIA", "AKIA" * 9, "ſecret=abcdefghijklmn"]
    texts = [" ".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 25))) for _ in range(300)]
    texts += [f"token=secret: {'a1' * 9}", f"{key}{'y' * 496} {mixed}", f"{key}{'y' * 470} \n{mixed}", f"{key}\n\n{mixed}", f"{mixed}\n{mixed}", "user=joe\npassword=abcdef", "user=joe\npassword=abcdef\nhttp://h.x/", f"user=joe {mixed} host: abc", f"{mixed} {key}", key, "f" * 16, "F" * 16, "f" * 15]
    texts += [("user=joe password=abcdef server=abc " * 3000), "a" * 3_000_000, f"{'word ' * 200_000}{key} {mixed}"]  # a hot and two long ones
    return texts


def test_secrets_equal_brute_force(spark):
    texts = secret_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, "token: 0123456789ab"), (None, texts[0]), (9000, None), (9001, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows], "doc_id long, text string, rid int, parts string, start int, scope string").repartition(4)
    got = credentials.scan(df).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    quick = {t: plain_secrets(t) for t in {t for _, t in rows} if t is None or len(t) < 50_000}
    want = sorted(((i, *quick[t]) for i, t in rows if t in quick), key=order)
    slow = {i: t for i, t in rows if t not in quick}
    assert sorted((tuple(r) for r in got if r["doc_id"] not in slow), key=order) == want
    for r in got:
        if r["doc_id"] in slow:
            text = slow[r["doc_id"]]
            if text.startswith("user"):
                assert r["spans"].count("user:") == r["spans"].count("short:") == r["spans"].count("endpoint:") == 3000
            elif text.startswith("word"):
                assert re.sub(r":\d+", "", r["spans"]) == "access,key" and r["n_access"] == 1
            else:
                assert r["n_hex"] == 1 and r["spans"] == "hex:0:3000000"
    kinds = {s.split(":")[0] for r in got for s in r["spans"].split(",")}
    assert kinds >= set(credentials.KINDS)


def test_secrets_use_no_python_and_no_text_is_kept(spark, documents):
    plan = credentials.spots(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text" not in credentials.spots(documents).columns


def test_secrets_of_nothing(spark, empty):
    none = credentials.scan(empty)
    assert none.count() == 0 and none.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
