"""Texts of many megabytes: whole results, and memory that a worker has."""

import random
import subprocess
import sys
import time

import numpy as np
import pytest

from tapewright.llm import components, language, licenses, media, token_counts, toxicity
from tapewright.llm.common import Scratch

LONG = """
import random, resource, sys, time
rng = random.Random(3)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randrange(2, 10))) for _ in range(5000)]
lines = [" ".join(rng.choices(words, k=12)) for _ in range(3000)]
text = "\\n".join(rng.choices(lines, k=20_000_000 // len(lines[0])))
"""
RUNS = {
    "op1": "from tapewright.llm import token_counts as m; from tapewright.llm.common import tokenizer_path as p; path = p(m.VOCABULARY); tier = m.Lengths(path, 200000); n = sum(map(tier.__getitem__, m.splitter(path).words(text))); assert n > len(text) // 10",
    "op2": "from tapewright.llm import language as m; t = [m.Tree.learn([l.encode() for l in x]) for x in (lines[:900], lines[900:1800], lines[1800:2400], [x.upper() for x in lines[:500]])]; b = m.Judge(t).bits([text.encode()]); assert b.argmin() < 3",
    "op4": "from tapewright.llm import toxicity as m; m.scorer({w: 0.1 for w in words[:2000]}, -1.0)([text])",
    "op5": "from tapewright.llm import licenses as m; s = m.Scanner(m.TEMPLATES, 0.8); found = s.scan(text); assert not found",
    "op10": "from tapewright.llm import media as m; p = m.to_payload(text); assert m.load(m.store(p), len(p)) == p",
    "op12": "import pyarrow as pa; from tapewright.llm import spelling as m; n = sum(sum(b.column('n').to_pylist()) for b in m.count_words([pa.RecordBatch.from_pydict({'doc_id': [1], 'text': [text]})])); assert n == len(m.WORD.findall(text))",
}


@pytest.mark.parametrize("name", RUNS)
def test_twenty_megabytes_stay_under_one_gigabyte(name):
    code = f"{LONG}\n{RUNS[name]}\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    assert float(done.stdout.split()[-1]) < 1000


def noise(n):
    return "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=n))


@pytest.mark.parametrize("between", [1_040_000, 1_048_420, 1_060_000, 2_500_000])
def test_lines_that_stood_far_before_come_back_whole(between):
    line = "abcdefghijklmnopqrstuvwxyz0123456789"
    payload = media.to_payload(f"{line}\n{noise(between)}\n{line}\n")
    assert media.load(media.store(payload), len(payload)) == payload


def test_a_text_of_fifty_megabytes_is_stored_and_read():
    block = noise(700_000)
    text = "\n".join(block[i : i + 70] for i in range(0, len(block), 71)) + "\n"
    payload = media.to_payload(text * 72)
    stored = media.store(payload)
    assert len(payload) > 49_000_000 and media.load(stored, len(payload)) == payload
    assert len(media.images(stored)) == -(-len(payload) // media.MOST)


def test_pieces_of_a_text_cost_what_the_whole_does(monkeypatch):
    texts = [noise(5000).encode(), b"", b"abc", noise(2500).encode() + "é".encode() * 30]
    trees = [language.Tree.learn([noise(900).encode()]), language.Tree.learn([b"abcde" * 50])]
    whole = language.Judge(trees).bits(texts)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.allclose(language.Judge(trees).bits(texts), whole, rtol=1e-6)


def test_notices_take_time_by_their_number():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    notice = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
    took = []
    for n in (400, 1600):
        start = time.perf_counter()
        assert scanner.scan(("some words of prose stand here between.\n" + notice) * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0]


def test_copies_of_a_sampled_text_reach_the_driver_once(spark):
    docs = spark.createDataFrame([(1, "the same words")] * 5000 + [(2, "other words")], "doc_id long, text string").repartition(4)
    words, _ = token_counts.frequent(docs, sample_mb=100.0)
    assert "same" in "".join(words)
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs).select("n_tokens").distinct().collect()]
    labels = spark.createDataFrame([(1, 1), (2, 0), (77, 1), (78, 1), (79, 1)], "doc_id long, toxic int")
    rows = [(i, f"plain text number {i}") for i in range(100, 140)]
    some = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert toxicity.score(some, labels).count() == 5041


def test_the_prior_counts_documents_that_exist(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: (seen.append((prior, p.shape[0])), (np.zeros(p.shape[1]), 0.0))[1])
    docs = spark.createDataFrame([(i, f"words {i} {'bad' if i % 3 == 0 else 'good'}") for i in range(60)] * 2, "doc_id long, text string")
    known = [(i, int(i % 3 == 0)) for i in range(60)]
    import zlib

    taught = [t for i, t in known if zlib.crc32(str(i).encode()) % 5]
    toxicity.fit(docs, spark.createDataFrame([*known, *((1000 + i, 1) for i in range(500))], "doc_id long, toxic int"))
    assert seen == [((sum(taught) + 1) / (len(taught) + 2), sum(taught))]


def test_a_star_whose_hub_is_the_largest(spark):
    n = 20_000
    edges = spark.range(n).selectExpr("id as a", f"{n}L as b")
    got = components.stars(edges, Scratch(spark, "star"))
    assert got.count() == n and got.where("root <> 0").count() == 0
