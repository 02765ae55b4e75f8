"""Quality rules with cross-document line frequency.

Within a text: counts of words, symbols, repeated lines and repeated eight-word windows. Across texts: lines are
normalised (A-Z lower-cased, marks and runs of space as one space) and hashed, the distinct texts that have a line are
counted per host, lines above the host's limit are removed, and a document that lost nearly all its words with them
is rejected. Copies of one text count once, so a document isn't rejected for being copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Hashes, batch_of, binaries, carried, chunks, stored

WINDOW = 8
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: A line is removed where more distinct texts of its host have it than both of these allow, or than the number after them.
LEAST_TEXTS = 20
SHARE_OF_HOST = 0.02
MANY_TEXTS = 1000
#: Lines of fewer words aren't counted; one of no words is no line.
LINE_WORDS = 1
#: A document is depleted when less than this share of its words is left.
LEFT = 0.1
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_CONTINUED = bytes(range(0x80, 0xC0))
_INNER = SPACE + _CONTINUED


def repeat_words(ids: np.ndarray, of: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """For each of n texts, how many of its words lie in a window that its text has twice or more.

    ids: hashes of the words of all texts in order; of: the text of each word. Windows are grouped by hash and those
    of equal hash compared word by word.
    """
    covered = np.zeros(n, np.int64)
    m = len(ids) - window + 1
    if m <= 0:
        return covered
    key = of[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m]
    key ^= key >> np.uint64(29)
    inside = np.flatnonzero(of[:m] == of[window - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    if not len(a):
        return covered
    if not (of[a] == of[b]).all() or any((ids[a + i] != ids[b + i]).any() for i in range(window)):
        seen: dict[tuple, int] = {}
        twice = np.zeros(m, bool)
        for i in inside.tolist():
            k = (int(of[i]), ids[i : i + window].tobytes())
            if k in seen:
                twice[[seen[k], i]] = True
            else:
                seen[k] = i
        hits = np.flatnonzero(twice)
    else:
        hits = np.unique(np.concatenate((a, b)))
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return np.bincount(of[np.cumsum(edge)[:-1] > 0], minlength=n)


def measures(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The counts within each text, base_failed, and the text's lines: hash and number of words (a null text: none)."""
    names, ddl = carried(docs, carry, (*OWN, "text_key", "lines", "line_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for batch in chunks(whole, text):
                texts = [t or b"" for t in binaries(batch.column(text))]
                lists = [t.split() for t in texts]
                n_words = np.array([len(w) for w in lists], np.int64)
                flat = hashes.array([w for some in lists for w in some])
                repeats = repeat_words(flat, np.repeat(np.arange(len(texts)), n_words), len(texts))
                chars, symbols, dups, keys, lines, sizes = [], [], [], [], [], []
                for t in texts:
                    chars.append(len(t.translate(None, _INNER)))
                    symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
                    full = [x for x in t.split(b"\n") if x and not x.isspace()]
                    dups.append(len(full) - len(set(full)))
                    keys.append(xxhash.xxh3_64_intdigest(t) - (1 << 63))
                    own = {}
                    total = []
                    for x in full:
                        w = x.translate(WORD_TABLE).split()
                        if len(w) >= LINE_WORDS:
                            h = xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63)
                            own[h] = own.get(h, 0) + len(x.split())
                    lines.append([*own])
                    sizes.append([*own.values()])
                failed = (n_words < 20) | (100 * repeats > 30 * n_words)
                yield batch_of(
                    batch,
                    names,
                    n_words=pa.array(n_words),
                    word_chars=pa.array(chars, pa.int64()),
                    n_symbols=pa.array(symbols, pa.int64()),
                    n_dup_lines=pa.array(dups, pa.int64()),
                    n_repeat_words=pa.array(repeats, pa.int64()),
                    base_failed=pa.array(failed),
                    text_key=pa.array(keys, pa.int64()),
                    lines=pa.array(lines, pa.list_(pa.int64())),
                    line_words=pa.array(sizes, pa.list_(pa.int32())),
                )

    form = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, text_key long, lines array<long>, line_words array<int>"
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, f"{ddl}{form}")


def judge(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", least_texts: int = LEAST_TEXTS, share: float = SHARE_OF_HOST, left: float = LEFT, many_texts: int = MANY_TEXTS) -> DataFrame:
    """doc_id, the counts, base_failed, removed_words (words in lines above their host's limit) and kept.

    A null host is a host of its own. Empty and null texts have no words and fail. Repeated rows each get their row
    and count as one text. An empty table gives no row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    rows = stored(measures(rows, "text", ["doc_id", "host"]).withColumn("row", F.monotonically_increasing_id()), "measures")
    texts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    line = rows.select("host", "text_key", F.explode("lines").alias("line")).distinct()
    often = line.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least_texts)
    often = often.join(texts, "host").filter(F.col("n") > F.least(share * F.col("texts"), F.lit(float(many_texts)))).select("host", "line")
    placed = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    removed = placed.join(often, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = rows.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    depleted = (F.col("n_words") - F.col("removed_words")) < left * F.col("n_words")
    return out.select("doc_id", *OWN, "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))
