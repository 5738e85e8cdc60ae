import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import katz, language, licenses, toxicity


def fold(doc_id, m):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


# --- language


def plain_bits(texts, probe):
    """PPM without numpy: dictionaries by context."""
    seen = [Counter() for _ in range(language.ORDER + 1)]
    for t in texts:
        t = b"\0" * language.ORDER + t
        for i in range(language.ORDER, len(t)):
            for k in range(language.ORDER + 1):
                seen[k][t[i - k : i + 1]] += 1
    bits, probe = 0.0, b"\0" * language.ORDER + probe
    for i in range(language.ORDER, len(probe)):
        for k in range(language.ORDER, -1, -1):
            context = probe[i - k : i]
            inside = {g: n for g, n in seen[k].items() if g[:-1] == context}
            if not inside:
                continue
            whole = sum(inside.values()) + len(inside)
            if (n := inside.get(probe[i - k : i + 1])) is not None:
                bits -= math.log2(n / whole)
                break
            bits -= math.log2(len(inside) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_ppm():
    texts, probes = [b"abracadabra", b"the cat sat", "été là".encode()], [b"abra the", b"zzz", "là été".encode(), b""]
    tree = language.Tree.learn(texts)
    judge = language.Judge([tree, language.Tree.learn([b"q"])], slots=1024)
    for _ in range(2):  # the second time from the table
        assert judge.bits(probes)[:, 0] == pytest.approx([plain_bits(texts, p) for p in probes], abs=1e-3)


def test_languages(documents, empty):
    got = language.identify(documents).join(documents.select("doc_id", "lang", "source"), "doc_id").distinct().collect()
    real = [r for r in got if r["doc_id"] < 300]
    assert np.mean([r["lang_pred"] == r["lang"] for r in real if r["held_out"]]) > 0.95
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in language.identify(documents).collect()}
    assert len(language.identify(documents).collect()) == documents.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 903, 909))
    assert language.identify(empty).count() == 0
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(none).collect()} == {"und"}
    kept = language.keep_language(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902, 903, 909})


def test_every_language_is_learnt(spark):
    """More languages than a fixed list would hold, one of them in a single long text."""
    rng = np.random.default_rng(3)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    rows = []
    for n in range(90):
        letters = alphabet[40 * n : 40 * n + 40]
        for i in range(1 if n == 7 else 6):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 5)) for _ in range(3000 if n == 7 else 40)), f"l{n}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, fold=1, held=2).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    few = language.identify(docs, sample_mb=0.0001, fold=1, held=2).select("lang_pred").distinct().count()
    assert few == 90


# --- toxicity


def plain_train(positive, unlabelled, width, prior, rounds, rate=0.1, decay=1e-5):
    """The same training, feature by feature; also how often the bound on the unlabelled risk acted."""
    s = lambda x: 1 / (1 + math.exp(-x))
    w, mean, square, acted = [0.0] * width + [-1.0], [0.0] * (width + 1), [0.0] * (width + 1), 0
    for t in range(1, rounds + 1):
        out = lambda row: s(sum(w[j] for j in row) + w[-1])  # noqa: B023, E731
        grad = lambda rows: [sum(out(r) * (1 - out(r)) * (j in r or j == width) for r in rows) / len(rows) for j in range(width + 1)]  # noqa: B023, E731
        gp, gu = grad(positive), grad(unlabelled)
        risk = sum(map(out, unlabelled)) / len(unlabelled) - prior * sum(map(out, positive)) / len(positive)
        acted += risk < 0
        step = [-prior * p + (u - prior * p) if risk >= 0 else prior * p - u for p, u in zip(gp, gu, strict=True)]
        step = [g + (decay * x if j < width else 0) for j, (g, x) in enumerate(zip(step, w, strict=True))]
        mean = [0.9 * m + 0.1 * g for m, g in zip(mean, step, strict=True)]
        square = [0.999 * q + 0.001 * g * g for q, g in zip(square, step, strict=True)]
        w = [x - rate * (m / (1 - 0.9**t)) / (math.sqrt(q / (1 - 0.999**t)) + 1e-8) for x, m, q in zip(w, mean, square, strict=True)]
    return w, acted


def test_training_equals_plain_with_and_without_the_bound():
    rng = np.random.default_rng(6)
    rows = lambda n, p: [sorted({int(j) for j in range(6) if rng.random() < p[j]}) for _ in range(n)]
    positive, unlabelled = rows(30, [0.9, 0.5, 0.4, 0.2, 0.1, 0.1]), rows(60, [0.1, 0.1, 0.3, 0.5, 0.5, 0.4])
    acted = []
    for prior in (0.1, 0.6):
        want, n = plain_train(positive, unlabelled, 6, prior, 120)
        w, b = toxicity.train(toxicity.Sparse([np.array(r, np.int64) for r in positive], 6), toxicity.Sparse([np.array(r, np.int64) for r in unlabelled], 6), prior, rounds=120)
        assert [*w, b] == pytest.approx(want, abs=1e-6)
        acted.append(n)
    assert acted[0] < 120 and acted[1] > 0


def test_risk_gradient_never_goes_below_the_bound():
    rng = np.random.default_rng(0)
    positive = toxicity.Sparse([np.array([0]) for _ in range(40)], 3)
    unlabelled = toxicity.Sparse([np.array([0]) if i % 10 == 0 else np.array([1 + rng.integers(2)]) for i in range(400)], 3)
    w, b = toxicity.train(positive, unlabelled, 0.1)
    assert toxicity.sigmoid(np.array([w[0] + b]))[0] > 0.9 > 0.1 > toxicity.sigmoid(np.array([w[1] + b]))[0]


def test_toxicity(documents, labels, empty, spark):
    rows = toxicity.score(documents, labels).collect()
    assert len(rows) == documents.count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    corpus = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 8 == 0) for r in corpus if r["held_out"]]) > 0.95
    assert toxicity.score(empty, labels).count() == 0
    unlabelled = toxicity.score(documents, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r["predicted"] == 0 for r in unlabelled)
    kept = toxicity.keep_clean(documents, labels)
    assert kept.columns == documents.columns and kept.where("doc_id is null").count() == 2


# --- language model


def plain_discounts(counts):
    """Simple Good-Turing by the book: averaged counts of counts, their line in logarithms, Katz's discounts to count 5."""
    n = Counter(counts)
    known = sorted(r for r in n if 0 < r <= 32)
    slope = -2.0
    if len(known) > 1:
        x, y = [], []
        for i, r in enumerate(known):
            before = known[i - 1] if i else 0
            after = known[i + 1] if i + 1 < len(known) else 2 * r - before
            x.append(math.log(r))
            y.append(math.log(2 * n[r] / (after - before)))
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = min(-1.1, sum((u - mx) * (v - my) for u, v in zip(x, y, strict=True)) / sum((u - mx) ** 2 for u in x))
    smooth = lambda r: r**slope
    star = {r: (r + 1) * smooth(r + 1) / smooth(r) for r in range(1, 6)}
    rest = 6 * smooth(6) / smooth(1)
    return {r: (star[r] / r - rest) / (1 - rest) for r in star}


def plain_katz(docs, order):
    """The same model with dictionaries; returns a function (context, word) -> probability, the words' counts, and the contexts."""
    counts = [Counter() for _ in range(order + 1)]
    for doc_id, text in docs:
        if fold(doc_id, 10) != 0:
            line = [None] * (order - 1) + katz.tokens(text)
            for i in range(order - 1, len(line)):
                for k in range(1, order + 1):
                    counts[k][tuple(line[i - k + 1 : i + 1])] += 1
    d = [None] + [plain_discounts(c.values()) for c in counts[1:]]
    after = defaultdict(dict)
    for k in range(2, order + 1):
        for gram, n in counts[k].items():
            after[gram[:-1]][gram[-1]] = n
    total = sum(counts[1].values())
    kept = lambda k, n: n * d[k].get(n, 1.0)

    @functools.cache
    def p(context, w):
        if not context:
            return kept(1, counts[1][(w,)]) / total if (w,) in counts[1] else 1 - sum(kept(1, n) for n in counts[1].values()) / total
        seen = after.get(context)
        if not seen:
            return p(context[1:], w)
        c = sum(seen.values())
        c += all(n > 5 for n in seen.values())
        return kept(len(context) + 1, seen[w]) / c if w in seen else bow(context, c) * p(context[1:], w)

    @functools.cache
    def bow(context, c):
        seen = after[context]
        return (1 - sum(kept(len(context) + 1, n) for n in seen.values()) / c) / (1 - sum(p(context[1:], w) for w in seen))

    return p, {g[0]: n for g, n in counts[1].items()}, total, list(after)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_equals_plain_and_is_normalised(documents, empty, order):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    p, uni, total, contexts = plain_katz(docs, order)
    for context in contexts[:: len(contexts) // 12]:
        assert sum(p(context, w) for w in uni) + p(context, b"neverseen") == pytest.approx(1, abs=1e-9)
    got = defaultdict(list)
    for r in katz.score(documents, order=order, block_tokens=5000).collect():
        got[r["doc_id"]].append(r)
    v = len(uni)
    for doc_id, text in docs:
        if doc_id is None:
            continue
        line, r = katz.tokens(text), got[doc_id][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(line), sum(w in uni for w in line), total, fold(doc_id, 10) == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni.get(w, 0) + 0.1) / (total + 0.1 * (v + 1))) for w in line))
        if r["held_out"] or doc_id % 7 == 0 or doc_id > 890:
            whole = [None] * (order - 1) + line
            assert r["score"] == pytest.approx(sum(math.log10(p(tuple(whole[i - order + 1 : i]), whole[i])) for i in range(order - 1, len(whole))), rel=1e-7)
    assert sum(map(len, got.values())) == documents.count()
    if order == 3:
        assert katz.score(empty).count() == 0


def test_blocks_and_split_contexts_do_not_matter(documents, monkeypatch):
    one = {r["doc_id"]: r["score"] for r in katz.score(documents, block_tokens=1 << 30).collect()}
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 2000)
    many = {r["doc_id"]: r["score"] for r in katz.score(documents, block_tokens=500).collect()}
    assert all(one[i] == pytest.approx(many[i], rel=1e-9) for i in one)


def test_discounts_are_good_turing_ones():
    for n in ([0, 900, 300, 150, 200, 60, 40, 30], [0, 5], [0], [0, 10, 10, 10, 10, 10, 10], [0, 0, 0, 7], [0, 1195, 400, 200, 260, 70, 60]):
        d = katz.discounts(np.array(n))[1:]
        assert ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all()
        assert list(d) == pytest.approx(list(plain_discounts([r for r, k in enumerate(n) for _ in range(k)]).values()))


def test_the_tables_hold_the_counts_and_nothing_stays_in_the_catalog(spark, documents):
    before = len(spark.catalog.listTables())
    katz.score(documents).count()
    assert len(spark.catalog.listTables()) == before
    stored, tables, *_, scratch = katz.fit(documents, order=3)
    counts = Counter()
    for r in documents.select("doc_id", "text").collect():
        if fold(r["doc_id"], 10) != 0:
            line = [None, None, *katz.tokens(r["text"])]
            counts.update(zip(line, line[1:], line[2:], strict=False))
    held = []
    for r in tables[2].where("kind = 'table'").collect():
        *_, n = katz.expand(bytes(r["body"]), *[np.uint64] * 5, np.float32, np.uint64)[:5]
        held += n.tolist()
    assert sorted(held) == sorted(counts.values())
    scratch.forget(stored)


# --- licences


def test_licences(documents, empty):
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(documents).collect()}
    assert [m["license"] for m in got[500]] == ["Apache-2.0"] and got[500][0]["dice"] == 1.0
    assert all(not m for i, m in got.items() if i not in (500,))
    assert licenses.scan(empty).count() == 0


def test_scan_equals_brute_force():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    pool = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rng = np.random.default_rng(2)
    for i in range(120):
        words = pool[i % len(pool)].split()
        for _ in range(rng.integers(0, 1 + len(words) // 5)):
            words[rng.integers(len(words))] = "other"
        text = " ".join(words)
        own = licenses.bigrams(licenses.normalise(text))
        best = max(licenses.dice(own, licenses.bigrams(licenses.normalise(t))) for t in pool)
        hit = scanner.best(text)
        assert (hit is not None) == (best >= 0.8) and (hit is None or hit[1] == pytest.approx(best))


@pytest.mark.parametrize("name", ["MIT", "GPL-3.0", "BSD-3-Clause", "Apache-2.0"])
def test_a_licence_of_several_paragraphs_inside_a_document(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    text = max(licenses.TEMPLATES[name][:3] if name != "Apache-2.0" else licenses.TEMPLATES[name], key=len)
    cut, times = text.replace(". ", ".\n\n"), 10 + len(text) // 30
    before, after = "Some words of a report that stand first.\n\n" * times, "\n\nOther words close the file here.\n" * times
    found = [m for m in scanner.scan(before + cut + after) if m[2] == "window"]
    assert [m[0] for m in found] == [name] and found[0][1] > 0.9
    assert abs(found[0][3] - len(before)) < 120 and abs(found[0][4] - len(before) - len(cut)) < 120
    line = [m for m in scanner.scan(before.strip() + " " + text + " " + after.strip()) if m[0] == name]
    assert line and line[0][1] > 0.9
    assert [m[0] for m in scanner.scan(text)] == [name]
