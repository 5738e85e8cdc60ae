import numpy as np
import pytest

from tapewright.llm import components, dart, minhash, vectors
from tapewright.llm.common import Scratch


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(300, 340)]  # and a long chain
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert [got.get(i, i) for i in range(341)] == groups(341, links)
    assert components.stars(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_slots_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**62, 300).astype(np.uint64)
    sets = [base, np.r_[base[:270], base[:30] + np.uint64(1)], base[:150], base[:3]]
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    weight = 1 + (np.concatenate(sets) % np.uint64(3)).astype(np.int64)
    sig = dart.signatures(doc, np.concatenate(sets), weight, 5, 2048)
    assert not sig[4].any() and sig[:4].all()
    pair = lambda i: (np.sort(sets[i]), (1 + np.sort(sets[i]) % np.uint64(3)).astype(np.int64))
    for i, j in ((0, 1), (0, 2), (1, 2), (2, 3)):
        assert (sig[i] == sig[j]).mean() == pytest.approx(dart.jaccard(pair(i), pair(j)), abs=0.05)


def brute_classes(rows):
    shingler = dart.Shingler()
    texts = [t for _, t in rows]
    doc, element, weight, content = shingler.sets(texts)
    each = [(element[doc == i], weight[doc == i]) for i in range(len(rows))]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (content[i] == content[j]).all() or dart.jaccard(each[i], each[j]) >= 0.8]
    label = groups(len(rows), links)
    return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates_equal_brute_force(documents, empty, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = sorted({(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] is not None and r["text"] is not None})
    want = brute_classes(rows)
    got = minhash.near_duplicates(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["kept"]
        else:
            assert r["class_id"] == want.get(r["doc_id"], r["doc_id"]) and r["kept"] == (r["class_id"] == r["doc_id"])
    assert want[908] == 907 and want[300] == 0 and want[909] == 901
    if chunk == 512:
        kept = minhash.keep_one(documents)
        assert kept.columns == documents.columns
        assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in want.values()} | {900})
        assert minhash.near_duplicates(empty).count() == 0


def test_a_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        words[rng.integers(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert all(r["class_id"] == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize(("hub", "chunk"), [(299, 512), (150, 512), (0, 512), (299, 32)])
def test_a_hub_whose_copies_are_alike_only_through_it(spark, hub, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(112)]
    rows = [(hub, " ".join(base))]
    for i in range(300):
        if i != hub:
            words = list(base)
            words[rng.integers(5, 50)], words[rng.integers(60, 106)] = f"x{i}", f"y{i}"
            rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(sorted(rows))
    assert len(set(want.values())) == 1 and got == want


@pytest.mark.parametrize(("groups_", "variants", "changes"), [(8, 40, 6), (8, 60, 6), (60, 3, 6), (1, 200, 7)])
def test_variants_near_the_threshold(spark, groups_, variants, changes):
    """Texts of which many pairs lie on either side of 0.8, so that candidates fail and other ones must take their place."""
    rng, rows = np.random.default_rng(groups_ * variants), []
    for g in range(groups_):
        base = [f"g{g}w{i}" for i in range(280)]
        for v in range(variants):
            words = list(base)
            for at in rng.integers(0, 280, changes):
                words[at] = f"g{g}v{v}at{at}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    want = brute_classes(sorted((int(i), str(t)) for i, t in rows))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_rows_that_share_an_id_but_not_a_text(spark):
    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"x{i}" for i in range(80))
    rows = [(5, long, "p"), (5, other, "q"), (5, other, "q"), (7, long + " more", "r"), (8, other + " more", "s"), (5, long, "a"), (9, None, "n"), (None, long, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content_a string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert found == sorted([(0, long), (5, long), (5, other), (9, "")])


def test_tiles_equal_pairs():
    rng = np.random.default_rng(11)
    base = rng.integers(1, 2**62, 300).astype(np.uint64)
    make = lambda n: [np.unique(np.r_[rng.choice(base, 300 - int(k), replace=False), rng.integers(1, 2**62, int(k)).astype(np.uint64)]) for k in rng.integers(0, 60, n)] + [np.empty(0, np.uint64)]
    one, two = make(70), make(40)
    assert minhash.similar(one, two, 0.8).tolist() == [[minhash.alike(a, b) >= 0.8 for b in two] for a in one]
    assert minhash.similar(one, one, 0.8)[:-1].any(1).all()
    e, w = np.array([5, 9], np.uint64), np.array([3, 1])
    f, v = np.array([5, 8], np.uint64), np.array([2, 1])
    assert minhash.alike(minhash.cells(e, w), minhash.cells(f, v)) == pytest.approx(dart.jaccard((e, w), (np.sort(f), v)))


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 24))
    x[40:] = x[:40] + 0.3 * rng.standard_normal((40, 24))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    whole = (x, *vectors.quantise(u))
    i, j = vectors.tile(whole, whole, 0.95, True)
    cos = u @ u.T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(80) for b in range(a + 1, 80) if cos[a, b] >= 0.95}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((150, 16))
    near = base[:60] + 0.12 * rng.standard_normal((60, 16))
    hot = base[0] + 0.05 * rng.standard_normal((50, 16))
    x = np.r_[base, near, hot, base[5:9], 3 * base[10:12]]
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(1000 + i, v, None) for i, v in enumerate(odd)] + [(None, base[0].tolist(), 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n double")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, miss=1e-4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    label = groups(n, [(a, b) for a in range(n) for b in range(a) if link[a, b]])
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum() - 1, label[i], label[i] == i)
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["component_id"] == 1000 + i for i in range(len(odd)))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_just_over_the_threshold(spark):
    """At the operator's own setting: pairs of cosine 0.95 to 0.96 among unrelated vectors."""
    rng = np.random.default_rng(17)
    base = rng.standard_normal((3000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((1500, 48))
    away -= (away * base[:1500]).sum(1, keepdims=True) * base[:1500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.96, (1500, 1))
    x = np.r_[base, cos * base[:1500] + np.sqrt(1 - cos**2) * away]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    found = np.mean([got[i]["component_id"] == got[3000 + i]["component_id"] for i in range(1500)])
    assert found >= 0.99
    assert all(got[i]["n_links"] == 0 for i in range(1500, 3000))


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (1, b), (2, a), (3, [0.0, 1.0, 0.01]), (4, None)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
