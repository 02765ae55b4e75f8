"""Filter interaction audit by packed bitmaps: what each filter removes under every order of the filters.

A row becomes one small record: the filters that its text fails, its part and its labels. A task packs the records of
a batch into bitmaps, 64 rows a word: one for each filter and each label, rows of a part in words of their own. Walking
the subsets of filters that can stand before a step, it takes a filter's rows out of what is left (AND-NOT) and counts
bits (popcount) part by part. Counts of batches add up in Spark; the orders are read off these sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binaries, chunks

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
#: Which filters failed, as bits A = 1, B = 2, ...; the copy filter is decided across rows.
_COPY = 1 << FILTERS.index("E")
FORM = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    marks = len(text) != len(text.translate(None, MARKS))
    return (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | marks << 3


def records(docs: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part, digest (of the text), fails (bits A to D) of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        F.col(text).alias("text"),
    )
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                fails = pa.array([failures(t or b"") for t in binaries(batch.column("text"))], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "digest")] + [fails], names=["doc_id", "part", "digest", "fails"])

    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, fails int")


def pack(flags: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Booleans of rows sorted by part as words of 64 bits; each part begins a word. Also the first word of each part."""
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    at = np.arange(len(flags)) - np.repeat(starts, sizes) + np.repeat(first * 64, sizes)
    bits = np.zeros(int(words.sum()) * 64, bool)
    bits[at[flags]] = True
    return np.packbits(bits, bitorder="little").view(np.uint64), first


def subset_counts(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, filters: int) -> np.ndarray:
    """[part, subset, kind]: rows left once the subset's filters ran, of all rows, good ones and toxic ones.

    Rows come sorted by part, ``sizes`` rows each. Each subset's bitmap is that of a smaller subset AND-NOT one filter.
    """
    starts = np.cumsum(sizes) - sizes
    every, first = pack(np.ones(len(fails), bool), starts, sizes)
    failing = [pack((fails >> i & 1).astype(bool), starts, sizes)[0] for i in range(filters)]
    labels = [every, pack(good, starts, sizes)[0], pack(toxic, starts, sizes)[0]]
    left = {0: every}
    out = np.zeros((len(sizes), 1 << filters, 3), np.int64)
    for subset in range(1 << filters):
        if subset:
            last = subset.bit_length() - 1
            left[subset] = left[subset & ~(1 << last)] & ~failing[last]
        for k, label in enumerate(labels):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(left[subset] & label).astype(np.int64), first)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    subsets = 1 << len(FILTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("part").dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(coded.dictionary))
        fails, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("fails", "good", "toxic"))
        counts = subset_counts(fails, good, toxic, sizes, len(FILTERS))
        at, subset = np.nonzero(counts[:, :, 0])
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(at)), pa.array(subset.astype(np.int32) % subsets), *(pa.array(counts[at, subset, k]) for k in range(3))],
            names=["part", "subset", "n", "good", "toxic"],
        )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums for a part becomes its rows for every order and step."""
    m = len(FILTERS)
    every = (1 << m) - 1
    steps = []
    for order in permutations(range(m)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, f, before))
            before |= 1 << f
    names, step = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)
    f, before = (np.array([s[i] for s in steps]) for i in (2, 3))
    after = before | 1 << f
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            left = np.zeros((every + 1, 3), np.int64)
            for s in sums:
                left[s["subset"]] = s["n"], s["good"], s["toxic"]
            lost = left[before] - left[after]
            failing = left[0, 0] - left[1 << f, 0]
            whole = np.bincount(f, weights=lost[:, 0], minlength=m).astype(np.int64)
            values = (left[after, 0], lost[:, 0], failing - lost[:, 0], left[every & ~(1 << f), 0] - left[every, 0], lost[:, 1], lost[:, 2], whole[f])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(steps)), pa.array(names), pa.array(step), *map(pa.array, values)],
                names=[x.split()[0] for x in FORM.split(", ")],
            )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is the empty text, a null part the empty string (and one with it). A row is a copy if a lesser id has
    its text; a null id is no lesser one, never makes its own row a copy and has no label. Rows that repeat one id and
    text share their fate and count each. An id is good or toxic if any of its label rows says 1; nulls say nothing.
    An empty table gives no row. Other columns are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(records(docs, part, text, doc_id), "records")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    said = said.filter("good or toxic")
    flagged = rows.join(least, "digest", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.when(F.col("doc_id") > F.col("least"), _COPY).otherwise(0)).alias("fails"))
    full = flagged.join(said, "doc_id", "left").select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    sums = full.mapInArrow(_counted, "part string, subset int, n long, good long, toxic long")
    sums = sums.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    whole = sums.groupBy("part").agg(F.collect_list(F.struct("subset", "n", "good", "toxic")).alias("sums"))
    return whole.mapInArrow(_orders, FORM)
