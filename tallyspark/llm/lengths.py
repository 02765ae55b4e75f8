"""Token counts from an exact length histogram: totals, quantiles and truncated totals for every context limit.

A text is split into words; the number of tokens of a word is looked up, and encoded where a task hasn't seen it lately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPECIAL, ranked, split
from .common import CACHE_WORDS, chunks, stored

#: Lengths are summed within stretches of this many first, then over stretches.
STRETCH = 256
#: Longer words aren't kept for another time.
LONG_WORD = 256


class _Tokens(dict):
    """How many tokens a word has, kept for the most recent distinct words."""

    def __init__(self, path: str):
        self.encode = ranked(path)._core_bpe.encode_single_piece
        self[SPECIAL] = 1

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word.encode()))
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self[SPECIAL] = 1
            self[word] = n
        return n


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of each task's documents; a null or empty text has length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(path)
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in chunks(whole, text):
                for t in batch.column(text).to_pylist():
                    n = sum(map(tokens.__getitem__, split(t, path))) if t else 0
                    seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.int64()), pa.array([*seen.values()], pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(text).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per length that occurs: n_tokens, n_docs, and by suffix sums docs_longer (documents longer than it),
    tokens_upto (tokens of documents no longer), total_truncated (tokens if every document were cut at it),
    total_tokens, quantile (share of documents no longer).

    A null or empty text has length 0; texts of any length count whole, a repeated row counts each time, documents of
    one length share a row; columns but the text are ignored. No document: no row. The texts are read once: the
    histogram is stored before the sums over it.

    Suffix sums take two levels: within stretches of lengths, then over the stretches, so no task holds more than
    a stretch's lengths or one row for each stretch.
    """
    one = stored(encoded_lengths(docs, path, text).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    one = one.withColumn("stretch", F.floor(F.col("n_tokens") / STRETCH).cast("long"))
    part = one.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    over = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    above = part.select(
        F.col("stretch").alias("s"),
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inner = Window.partitionBy("stretch").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    both = one.join(above, one.stretch == above.s).select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(inner), F.lit(0)) + F.col("docs_above")).alias("docs_longer"),
        (F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner), F.lit(0)) + F.col("tokens_above")).alias("tokens_longer"),
        "docs",
        "total_tokens",
    )
    return both.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        (F.col("total_tokens") - F.col("tokens_longer")).alias("tokens_upto"),
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("total_truncated"),
        "total_tokens",
        (1 - F.col("docs_longer") / F.col("docs")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at any limit, from the histogram alone."""
    return hist.agg(
        F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).cast("long").alias("total_truncated")
    ).withColumn("context_limit", F.lit(limit).cast("long"))
