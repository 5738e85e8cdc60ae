"""Operator 4: toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, crc_mod, doc_columns, texts

WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """A word's features: itself, and how it begins (two to four letters, marked)."""
    return [word, *("^" + word[:k] for k in (2, 3, 4) if len(word) > k)]


def words(text: str) -> set[str]:
    """A text's features: those of its distinct words."""
    return {x for w in set(WORD.findall(text.lower())) for x in parts(w)}


class Hits(dict):
    """Word to those of its features that have a weight; most have none. Bounded: it starts anew when full."""

    def __init__(self, weights: dict[str, float], bound: int = 200_000):
        super().__init__()
        self.weights, self.bound = weights, bound

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.bound:
            self.clear()
        self[word] = found = tuple(x for x in parts(word) if x in self.weights)
        return found

    def total(self, text: str) -> float:
        found = {x for hit in map(self.__getitem__, set(WORD.findall(text.lower()))) if hit for x in hit}
        return sum(self.weights[x] for x in sorted(found))


class Sparse:
    """A 0/1 matrix as (row, column) places."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.shape = (len(rows), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def frequencies(sample: DataFrame) -> DataFrame:
    """feature, p, u: in how many confirmed and how many unlabelled texts of the sample each feature stands."""

    def run(batches):
        p, u = Counter(), Counter()
        for b in bounded(batches):
            for text, positive, plain in zip(texts(b), b.column("positive").to_pylist(), b.column("plain").to_pylist(), strict=True):
                found = words(text)
                if positive:
                    p.update(found)
                if plain:
                    u.update(found)
        names = list(p.keys() | u.keys())
        for i in range(0, len(names), 1 << 16):
            part = names[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "p": pa.array([p[w] for w in part], pa.int64()), "u": pa.array([u[w] for w in part], pa.int64())})

    return sample.mapInArrow(run, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def choose(counts: DataFrame, n: int, m: int, size: int) -> list[str]:
    """The features that most tell confirmed texts from text at large: by the likelihood ratio of their frequencies in n and m texts."""
    a, b = (F.col("p") + 0.5) / (n + 1), (F.col("u") + 0.5) / (m + 1)
    gain = F.col("p") * F.log(a / b) + (n - F.col("p")) * F.log((1 - a + 1e-9) / (1 - b + 1e-9))
    best = counts.where((F.col("p") >= 3) & (a > b)).select("feature", F.round(gain, 6).alias("gain")).where("gain > 4").orderBy(F.desc("gain"), "feature").limit(size)
    return [r["feature"] for r in best.collect()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = 800, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear classifier under the non-negative risk  prior*R_p(+1) + max(0, R_u(-1) - prior*R_p(-1))  with sigmoid loss.

    Adam on the whole sample. Where the second part turns negative, its gradient is followed upwards instead, as the
    method prescribes, so that the classifier can't fit the unlabelled rows below what the prior allows.
    """
    width = positive.shape[1]
    w, b = np.zeros(width), -1.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    n, m = positive.shape[0], unlabelled.shape[0]
    for t in range(1, rounds + 1):
        sp, su = sigmoid(positive.times(w) + b), sigmoid(unlabelled.times(w) + b)
        slope_p, slope_u = sp * (1 - sp) / n, su * (1 - su) / m
        negative = su.mean() - prior * sp.mean()  # loss of calling x negative is sigmoid(g(x))
        down = np.r_[unlabelled.back(slope_u) - prior * positive.back(slope_p), slope_u.sum() - prior * slope_p.sum()]
        up = -prior * np.r_[positive.back(slope_p), slope_p.sum()]
        step = up + down if negative >= 0 else -down
        step[:-1] += decay * w
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        move = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def sampled(df: DataFrame, n: int, total: int) -> DataFrame:
    """About ``n`` of ``total`` rows, by a hash of doc_id."""
    return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n / max(1, total))))


def matrices(sample: DataFrame, names: list[str]) -> tuple[Sparse, Sparse]:
    """The sample as matrices over the chosen features: some numbers a text reach the driver."""
    shared = sample.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def run(batches):
        place = shared.value
        for b in bounded(batches):
            found = [sorted(place[w] for w in words(t) if w in place) for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "positive": b.column("positive"), "plain": b.column("plain"), "at": pa.array(found, pa.list_(pa.int32()))})

    rows = sorted((r["doc_id"], r["positive"], r["plain"], r["at"]) for r in sample.mapInArrow(run, "doc_id long, positive boolean, plain boolean, at array<int>").toLocalIterator())
    pick = lambda i: Sparse([np.array(r[3], np.int64) for r in rows if r[i]], len(names))
    return pick(1), pick(2)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, positives: int = 3000, unlabelled: int = 9000, features: int = 2048) -> tuple[dict[str, float], float]:
    """Word weights and bias, from rows whose crc32(doc_id) mod ``fold`` is not 0.

    The sample is bounded: about ``positives`` texts labelled toxic and ``unlabelled`` texts whatever their labels, which
    stand for text at large. Of their words and word beginnings the ``features`` that most tell the two apart have a
    weight, which bounds what is broadcast. The class prior is the toxic share of labelled documents of the same folds, by
    the rule of succession (one more of either kind), so that it is never 0 or 1. A document counts once: labels without
    a document are ignored, and of several texts of one doc_id the smallest is learnt from.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", fold) != 0)
    docs = doc_columns(docs).where(F.col("doc_id").isNotNull()).where(crc_mod("doc_id", fold) != 0)
    taught = scratch.put(taught.join(docs.select("doc_id"), "doc_id", "left_semi"), "taught")
    n = taught.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    total = docs.count()
    if not n["toxic"] or not total:
        return {}, -10.0
    # the chosen ids are about ``positives`` in number, whatever the size of the table
    chosen = F.broadcast(sampled(taught.where("toxic = 1"), positives, n["toxic"]).select("doc_id", F.lit(True).alias("chosen")))
    share = int((1 << 40) * min(1.0, unlabelled / total))
    flags = {"positive": F.coalesce("chosen", F.lit(False)), "plain": F.pmod(F.xxhash64("doc_id", F.lit("u")), F.lit(1 << 40)) < share}
    picked = docs.join(chosen, "doc_id", "left").withColumns(flags).where("positive or plain")
    sample = scratch.put(picked.groupBy("doc_id", "positive", "plain").agg(F.min("text").alias("text")), "sample")
    seen = sample.agg(F.count_if("positive").alias("p"), F.count_if("plain").alias("u")).first()
    if not seen["p"] or not seen["u"]:
        return {}, -10.0
    names = choose(frequencies(sample), seen["p"], seen["u"], features)
    prior = (n["toxic"] + 1) / (n["n"] + 2)
    w, b = train(*matrices(sample, names), prior)
    return dict(zip(names, w.tolist(), strict=True)), b


def scorer(weights: dict[str, float], bias: float):
    """Texts to scores."""
    hits = Hits(weights)
    return lambda rows: sigmoid(np.array([hits.total(t) for t in rows]) + bias)


def score(docs: DataFrame, labels: DataFrame, fold: int = 5, **bounds) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    A text's label is never an input of its score. Null and empty texts have the score of no words, very long ones that
    of all their words; with no toxic example to learn from every score is near 0. Repeated rows each give a row, an empty
    table none; labels of unknown documents and null
    labels are ignored, and of several labels of a document the highest counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold, **bounds))
    held = F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False)).alias("held_out")

    def run(batches):
        judge = scorer(*shared.value)
        for b in bounded(batches):
            s = judge(texts(b))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
    return out.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as they are. Rows are judged where they are read: nothing is shuffled.

    Null and empty texts have the score of no words, very long ones that of all their words; repeated rows each stay or go;
    an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches):
        judge = scorer(*shared.value)
        for b in bounded(batches):
            yield b.filter(pa.array(judge(texts(b)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
