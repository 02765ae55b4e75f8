"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Grades come from labelled rows: 0 without toxic content, then 1 to 3 by how much of a text tells toxic from other
texts. One weight vector serves every threshold: P(grade > k) = sigmoid(w x - t_k) with t_0 < t_1 < t_2.
The output is the expected severity, the sum of these probabilities.

Features are hashed words and word beginnings, which hold through inflection; those that labels say nothing about
are left out before the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, batch_of, binaries, carried, chunks, stored, words

#: Labelled rows to fit on at most; the labels' ids are drawn in the order of their hash.
FIT_ROWS = 8_000
BUCKETS = 1 << 20
MOST_FEATURES = 4096
LEAST_DOCS = 8
#: Likelihood-ratio statistic that a feature must reach to take part.
LEAST_SIGNAL = 25.0
GRADES = 3
#: Lengths, in characters, of the word beginnings that count as features.
PREFIXES = (4, 5)
OWN = ("expected_severity", "p_toxic", "grade", "toxic")


@dataclass
class Model:
    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray


def buckets(word: bytes) -> list[int]:
    """The features of a word: itself and its beginnings."""
    text = word.decode("utf-8", "replace")
    parts = [word, *(b"^" + text[:k].encode() for k in PREFIXES if len(text) >= k)]
    return [xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts]


class _Known(dict):
    """What a function gives for the most recent distinct words."""

    def __init__(self, of: Callable[[bytes], list[int]]):
        self.of = of

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = self.of(word)
        return value


def _features(only: frozenset[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(buckets if only is None else lambda w: [b for b in buckets(w) if b in only])
        for whole in batches:
            for batch in chunks(whole, "text"):
                keys, counts = [], []
                for t in binaries(batch.column("text")):
                    w = words(t)
                    k, n = np.unique(np.fromiter((b for x in w for b in known[x]), np.uint32), return_counts=True)
                    keys.append(k.tobytes())
                    counts.append(n.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    names=["toxic", "keys", "counts"],
                )

    return run


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean): how many of a task's documents of either kind have a feature."""
    have = np.zeros((2, BUCKETS), np.int32)
    for batch in _features()(batches):
        for kind, keys in zip(batch.column("toxic").to_pylist(), batch.column("keys").to_pylist()):
            have[int(kind == 0)][np.frombuffer(keys, np.uint32)] += 1
    any_ = np.flatnonzero(have.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(any_.astype(np.int32)), pa.array(have[0][any_].astype(np.int64)), pa.array(have[1][any_].astype(np.int64))], names=["bucket", "toxic", "clean"])


def telling(few: DataFrame) -> frozenset[int]:
    """The features (twice MOST_FEATURES at most) that tell toxic from clean documents best; counting is Spark's."""
    total = {r["toxic"] > 0: r["n"] for r in few.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    a, b = float(total.get(True, 0)), float(total.get(False, 0))
    if not a or not b:
        return frozenset()
    n = few.mapInArrow(_documents_with, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    both = F.col("t") + F.col("c")
    part = lambda h, share: F.when(F.col(h) > 0, F.col(h) * F.log(F.col(h) / (both * share))).otherwise(0.0)
    signal = 2 * (part("t", a / (a + b)) + part("c", b / (a + b)))
    best = n.filter(both >= min(LEAST_DOCS, max(2, a / 4))).withColumn("signal", signal).filter(F.col("signal") >= 0.99 * LEAST_SIGNAL).orderBy(F.desc("signal"), "bucket").limit(2 * MOST_FEATURES)
    return frozenset(r["bucket"] for r in best.select("bucket").collect())


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, keys, counts) of at most ``rows`` labelled documents: those of their features that tell at all, so a row is
    bounded whatever a text's length; a document with several labels counts as toxic if any says so.

    Null ids and null labels are no labels; rows that repeat one id and text count once; of an id with many texts, as of
    all, those of the least hashes of id and text count; without labels or documents there is no row.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` pairs of numbers are broadcast, twice: the labelled ids, then the rows that are picked of theirs.
    few = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("_key")).join(F.broadcast(chosen), "doc_id")
    picked = few.select("doc_id", "_key").distinct().orderBy("_key", "doc_id").limit(rows)
    few = few.join(F.broadcast(picked), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key"])
    few = stored(few.select("toxic", "text"), "labelled")
    return few.mapInArrow(_features(telling(few)), "toxic int, keys binary, counts binary")


def fit(rows: list, grades: int = GRADES, rounds: int = 600, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Fit to collected training rows. Without both kinds of label nothing counts as toxic."""
    rows = sorted(rows, key=lambda r: (r["toxic"], bytes(r["keys"]), bytes(r["counts"])))
    toxic = np.array([r["toxic"] > 0 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return Model({}, np.zeros(0), np.full(grades, 20.0) + np.arange(grades))
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    counts = [np.frombuffer(r["counts"], np.uint32) for r in rows]
    size = np.array([len(k) for k in keys])
    of = np.repeat(np.arange(len(rows)), size)
    flat, many = np.concatenate(keys).astype(np.int64), np.concatenate(counts).astype(float)

    have = [np.bincount(flat[toxic[of] == side], minlength=BUCKETS).astype(float) for side in (True, False)]
    total = [float(toxic.sum()), float((~toxic).sum())]
    both, share = have[0] + have[1], total[0] / len(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        signal = 2 * sum(np.where(h > 0, h * np.log(h / (both * s)), 0) for h, s in zip(have, (share, 1 - share)))
    odds = np.log((have[0] + 0.5) / (total[0] + 1)) - np.log((have[1] + 0.5) / (total[1] + 1))
    good = np.flatnonzero((both >= min(LEAST_DOCS, max(2, total[0] / 4))) & (signal >= LEAST_SIGNAL))
    good = good[np.argsort(-signal[good], kind="stable")[:MOST_FEATURES]]
    column = np.full(BUCKETS, -1)
    column[good] = np.arange(len(good))

    # Grades of toxic rows: thirds of how much in them speaks for toxicity.
    load = np.bincount(of, np.log1p(many) * (odds[flat] > 1) * (column[flat] >= 0), minlength=len(rows))
    edges = np.quantile(load[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(edges, load, side="left"), 0)

    used = column[flat] >= 0
    at, x, of = column[flat[used]], np.log1p(many[used]), of[used]
    above = (grade[:, None] > np.arange(grades)).astype(float)
    p = np.concatenate((np.zeros(len(good)), [2.0], np.full(grades - 1, 0.0)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, d = p[: len(good)], p[len(good) :]
        t = np.cumsum(np.concatenate((d[:1], np.exp(d[1:]))))
        score = np.bincount(of, x * w[at], minlength=len(rows))
        gap = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -30, 30))) - above
        slope = gap.sum(1)
        g_t = -gap.sum(0)
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate((np.bincount(at, x * slope[of], minlength=len(good)), tail[:1], tail[1:] * np.exp(d[1:]))) / len(rows)
        g[: len(good)] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    d = p[len(good) :]
    return Model(dict(zip(good.tolist(), range(len(good)))), p[: len(good)], np.cumsum(np.concatenate((d[:1], np.exp(d[1:])))))


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """expected_severity (0 to 3), p_toxic = P(grade > 0), grade (the likeliest) and toxic (p_toxic at least a half).

    A null or empty text has no features and gets the value of the thresholds alone; a text of any length is read whole.
    Repeated rows each get their row, an empty table none; an input column with an output's name gives way to it.
    """
    names, ddl = carried(docs, carry, OWN)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        nothing: list[int] = []
        known = _Known(lambda w: [model.features[b] for b in buckets(w) if b in model.features] or nothing)
        for whole in batches:
            for batch in chunks(whole, text):
                n = batch.num_rows
                lists = [words(t) for t in binaries(batch.column(text))]
                found = [(i, c) for i, some in enumerate(lists) for got in map(known.__getitem__, some) if got for c in got]
                of, at = np.array(found, np.int64).reshape(-1, 2).T
                key, many = np.unique(of * max(1, len(model.weights)) + at, return_counts=True)
                of, at = np.divmod(key, max(1, len(model.weights)))
                total = np.bincount(of, np.log1p(many) * model.weights[at], minlength=n)
                p = 1 / (1 + np.exp(-np.clip(total[:, None] - model.thresholds, -500, 500)))
                each = -np.diff(np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), 1), axis=1)
                yield batch_of(
                    batch,
                    names,
                    expected_severity=pa.array(p.sum(1)),
                    p_toxic=pa.array(p[:, 0]),
                    grade=pa.array(each.argmax(1).astype(np.int32)),
                    toxic=pa.array(p[:, 0] >= 0.5),
                )

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, f"{ddl}expected_severity double, p_toxic double, grade int, toxic boolean")


def grade(docs: DataFrame, labels: DataFrame, text: str = "text", carry: list[str] | None = None, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled documents and score all; odd rows are treated as by ``training_rows`` and ``score``."""
    return score(docs, fit(training_rows(docs, labels, text, rows).collect()), text, carry)
