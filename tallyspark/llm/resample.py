"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The target model counts the n-grams of documents labelled good, the raw model those of all documents. A document's
log weight is the mean log ratio of its n-grams times their number, of which LENGTH count at most: beyond that, a longer
document weighs no more, and the noise has its say among documents of any length. With Gumbel noise added, the k
greatest keys are a sample without replacement in proportion to the weights; k is a budget, or the number of documents
whose weight lies on the good side of the labelled ones.

N-grams are of two kinds: words, and word shapes (letter case, digits and the marks around them; a word equal to the
one before has a shape of its own), each alone and with its successor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, apart, batch_of, binaries, carried, chunks, freed, stored, together

BUCKETS = 10_000
#: Labelled good documents that the target model is fit on at most.
FIT_ROWS = 50_000
#: N-grams that a document's weight counts at most.
LENGTH = 100
SEED = 7
NO_NGRAMS = -1.0e9
OWN = ("log_weight", "key")
_RUN = re.compile(rb"([a-zA-Z0-9])\1+|([^a-zA-Z0-9])\2+")


def _shape_table() -> bytes:
    table = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        table[i] = ord("x") if "a" <= c <= "z" or i >= 128 else ord("X") if "A" <= c <= "Z" else ord("9") if c.isdigit() and i < 128 else i
    return bytes(table)


_SHAPES = _shape_table()


def shape(word: bytes) -> bytes:
    """Letters, digits and marks of a word, runs as one; the case of the first letter beyond ASCII is that of the word."""
    if not word.isascii():
        text = word.decode("utf-8", "replace")
        word = "".join("X" if c.isupper() else "x" if not c.isascii() else c for c in text).encode()
    return _RUN.sub(lambda m: m[0][:1], word.translate(_SHAPES))


class _Codes(dict):
    """Word hash in the high, shape hash in the low 32 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = (xxhash.xxh32_intdigest(word) << 32) | xxhash.xxh32_intdigest(shape(word), 1)
        return value


def ngram_buckets(texts: list[bytes | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of some texts."""
    lists = [t.split() if t else [] for t in texts]
    size = np.array([len(w) for w in lists], np.int64)
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.uint64, int(size.sum()))
    of = np.repeat(np.arange(len(texts)), size)
    word, form = flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)
    inner = of[1:] == of[:-1]
    again = np.concatenate(([False], inner & (word[1:] == word[:-1])))[: len(word)]
    form = np.where(again, np.uint64(12345), form)

    def spread(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)

    out, at = [], []
    for values, salt in ((word, 1), (form, 2)):
        out += [spread(values, salt), spread(values[:-1] * np.uint64(31) + values[1:] * np.uint64(0x85EBCA6B), salt + 10)[inner]]
        at += [of, of[1:][inner]]
    return np.concatenate(out), np.concatenate(at)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target, codes = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), _Codes()
    for whole in batches:
        for batch in chunks(whole, "text"):
            bucket, of = ngram_buckets(binaries(batch.column("text")), codes)
            good = np.asarray(batch.column("good").fill_null(False).to_numpy(zero_copy_only=False), bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[of]], minlength=BUCKETS)
    has = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(raw[has]), pa.array(target[has])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> np.ndarray:
    """Log ratio of target to raw for every bucket, each smoothed by one; counts go over all documents."""
    good = (
        labels.filter((F.col("quality") > 0) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .withColumn("good", F.lit(True))
    )
    # At most ``rows`` ids are broadcast.
    marked = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(good), "doc_id", "left").select("text", "good")
    counts = marked.mapInArrow(freed(_counts), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == BUCKETS:  # nothing labelled good: no preference
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(*parts: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the row's own values only, so a lost task draws it again."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", carry: list[str] | None = None, seed: int = SEED, length: int | None = LENGTH) -> DataFrame:
    """Carried columns with log_weight and key (log weight and noise). Without ``length`` the weight is the exact log ratio
    of the two models, the sum over all n-grams.

    A null or empty text, or one without words, weighs NO_NGRAMS. Repeated rows each get their row and share their key;
    an empty table gives none; an input column with an output's name gives way to it, all others stay.
    """
    names, ddl = carried(docs, carry, OWN)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers
    own = "noise"
    while own in docs.columns:
        own += "_"
    rows = docs.select(*dict.fromkeys([*names, text]), gumbel(F.col("doc_id"), F.col(text), seed=seed).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, codes = shared.value, _Codes()
        for whole in batches:
            for batch in chunks(whole, text):
                bucket, of = ngram_buckets(binaries(batch.column(text)), codes)
                n = np.bincount(of, minlength=batch.num_rows)
                total = np.bincount(of, ratio[bucket], minlength=batch.num_rows)
                share = 1.0 if length is None else np.minimum(n, length) / np.maximum(n, 1)
                weight = np.where(n > 0, total * share, NO_NGRAMS)
                noise = batch.column(own).to_numpy(zero_copy_only=False)
                yield batch_of(batch, names, log_weight=pa.array(weight), key=pa.array(weight + noise))

    return rows.mapInArrow(freed(run), f"{ddl}log_weight double, key double")


def kth_greatest(keys: DataFrame, k: int, few: int = 5_000, bins: int = 2048) -> float:
    """The k-th greatest value of column key, exactly: histograms narrow its range until few values are left."""
    if k <= 0:
        return float("inf")
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n is None or k >= n:
        return float("-inf")
    above = 0
    while n > few and lo < hi:
        step = (hi - lo) / bins
        if lo + step == lo:
            break
        place = F.least(F.floor((F.col("key") - lo) / step).cast("int"), F.lit(bins - 1))
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        for r in sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if lo == hi:
        return lo
    counted = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy("key").agg(F.count("*").alias("n")).collect()
    for r in sorted(counted, key=lambda r: -r["key"]):
        above += r["n"]
        if above >= k:
            return r["key"]
    raise AssertionError


def good_side(weighed: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> float | None:
    """The log weight that splits labelled documents with the fewest errors, in the middle of its gap; None without labels."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") > 0).alias("good"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs are broadcast and at most as many come back, but for repeated ids.
    got = weighed.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("log_weight").alias("w")).collect()
    if not got:
        return None
    w, good = np.array([r["w"] for r in got]), np.array([r["good"] for r in got], bool)
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    wrong = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))
    i = int(wrong.argmin())
    return float("-inf") if i == 0 else float("inf") if i == len(w) else float(w[i - 1] + w[i]) / 2


def threshold(weighed: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, budget: int | None = None) -> float:
    """The key that a kept document must reach.

    k is the budget; without one, the number of documents on the good side of the weight that splits the labelled ones
    best, and without labels all. Rows whose keys tie with the k-th are kept, too, so repeated rows share their fate.
    """
    if budget is not None:
        return kth_greatest(weighed, budget)
    cut = good_side(weighed, labels, rows)
    return float("-inf") if cut is None else kth_greatest(weighed, weighed.filter(F.col("log_weight") >= cut).count())


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS, budget: int | None = None, length: int | None = LENGTH) -> DataFrame:
    """doc_id, log_weight, key and kept for every row.

    Null, empty and wordless texts have the least weight; a null id is no one's label; repeated rows each get their
    row; an empty table gives no row; columns but id and text are ignored.
    """
    ratios = log_ratios(docs, labels, text, rows)
    weighed = stored(weigh(docs, ratios, text, ["doc_id"], length=length), "weighed")
    return weighed.withColumn("kept", F.col("key") >= threshold(weighed, labels, rows, budget))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS, budget: int | None = None, length: int | None = LENGTH) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns, whatever their names.

    Weighed rows are stored whole, so texts are hashed for the counts and once more for the weights. Odd rows are
    treated as by ``resample``.
    """
    ratios = log_ratios(docs, labels, text, rows)
    whole = apart(docs, text).withColumn("doc_id", F.col("row.doc_id"))
    weighed = stored(weigh(whole, ratios, "text", ["doc_id", "text", "row"], length=length), "weighed-rows")
    return together(weighed.filter(F.col("key") >= threshold(weighed, labels, rows, budget)), docs.columns, text)
