"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside one task. Its words become symbols: a word that no benchmark text
has can be in no occurrence of a window, so it ends a segment, and segments shorter than the shortest window
are left out; this loses nothing. Over the remaining symbols stand a suffix array, its Burrows-Wheeler
transform in a wavelet matrix, and sampled suffix positions. All windows are searched backwards at once;
occurrences are located by walking to a sampled position, and their word ranges merge into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_FORM, batch_of, binaries, carried, chunks, freed, stored, words

WINDOW = 13
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 32 << 20
SAMPLE = 32
#: Bytes of benchmark text that one pass searches for; a larger benchmark takes several passes, one after another.
PASS_BYTES = 4 << 20
OWN = ("n_words", "n_hit", "items", "spans")


class Windows:
    """The windows of benchmark items as symbols, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)), np.int32) for _, text in items]
        rows, of = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for i, ids in enumerate(found):
            if len(ids) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            elif len(ids):
                rows.append(np.pad(ids, (0, window - len(ids)))[None])
            of.append(np.full(len(rows[-1]) if len(ids) else 0, i, np.int64))
        self.symbol, place = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.symbol > 0).sum(1)
        self.symbol = self.symbol.astype(np.int64)
        # Window by window, the items that have it.
        order = np.argsort(place.ravel(), kind="stable")
        self.owners = np.concatenate(of)[order]
        self.first = np.searchsorted(place.ravel()[order], np.arange(len(self.symbol) + 1))
        self.names = [name for name, _ in items]

    def items(self, window: int) -> set[str]:
        return {self.names[i] for i in self.owners[self.first[window] : self.first[window + 1]].tolist()}


class FMIndex:
    """Backward search over symbols 1..most in segments that each end with a 0."""

    def __init__(self, text: np.ndarray, most: int, sample: int = SAMPLE):
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        step = 1
        order = np.argsort(rank, kind="stable")
        while True:
            key = rank * (n + most + 2)
            key[:-step] += rank[step:] + 1
            del order, rank
            order = np.argsort(key, kind="stable")
            key = key[order]
            fresh = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            rank = key
            rank[order] = fresh
            del key, fresh
            step *= 2
            if step >= n or rank[order[-1]] == n - 1:
                break
        del rank
        # A shard has fewer than 2**31 symbols, so what stays of it takes four bytes a symbol.
        bwt = text[order - 1].astype(np.int32)
        bwt[order == 0] = 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most + 1))))
        self.bwt = bwt
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = bwt
        for bit in reversed(range(max(1, int(most).bit_length()))):
            ones = (row >> bit) & 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, n - int(count[n])))
            row = np.concatenate((row[ones == 0], row[ones == 1]))
        del row, ones
        self.start = self._descend(np.arange(most + 1), np.zeros(most + 1, np.int64))
        # Walks stop at sampled positions and at the first symbol of a segment, so they never cross a 0.
        self.sampled = (order % sample == 0) | (bwt == 0)
        self.position = order[self.sampled]
        self.place = np.cumsum(self.sampled, dtype=np.int32) - 1
        self.n = n

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, count, zeros in self.levels:
            ones = count[i]
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.start[symbol]

    def search(self, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of every window."""
        live = np.arange(len(length))
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for t in range(symbol.shape[1]):
            more = live[length[live] > t]
            if not len(more):
                break
            c = symbol[more, length[more] - 1 - t]
            low[more] = self.first[c] + self.rank(c, low[more])
            high[more] = self.first[c] + self.rank(c, high[more])
            live = live[low[live] < high[live]]
        many = high[live] - low[live]
        which = np.repeat(live, many)
        row = np.repeat(low[live], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return which, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        walked = np.zeros(len(row), np.int64)
        left = np.flatnonzero(~self.sampled[row])
        while len(left):
            c = self.bwt[row[left]]
            row[left] = self.first[c] + self.rank(c, row[left])
            walked[left] += 1
            left = left[~self.sampled[row[left]]]
        return self.position[self.place[row]] + walked


def occurrences(symbols: list[np.ndarray], bench: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, word, offsets): occurrences in the documents' words laid end to end; offsets: each document's first."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in symbols]))).astype(np.int64)
    text = np.concatenate([*symbols, np.zeros(1, np.int32)]) if symbols else np.zeros(1, np.int32)
    none = np.zeros(0, np.int64)
    if not len(bench.length):
        return none, none, offsets
    # Segments: maximal runs of known words within one document.
    known = text > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    begin[offsets[:-1]] |= known[offsets[:-1]]
    starts = np.flatnonzero(begin)
    stop = ~known
    after = np.flatnonzero(stop)
    ends = after[np.searchsorted(after, starts)] if len(starts) else starts
    ends = np.minimum(ends, np.append(starts[1:], len(text)))
    ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, side="right")])
    long = ends - starts >= int(bench.length.min())
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, offsets
    size = ends - starts + 1
    place = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    reduced = text[np.minimum(place, len(text) - 1)].astype(np.int64)
    reduced[np.cumsum(size) - 1] = 0
    which, at = FMIndex(reduced, len(bench.vocabulary)).search(bench.symbol, bench.length)
    return which, place[at], offsets


def _char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as ranges of code points, from the first word's start to the last word's end."""
    found = [m.span() for m in re.finditer(WORD_FORM, re.sub("[A-Z]", lambda m: m[0].lower(), text.decode()))]
    return [{"start": found[a][0], "end": found[b - 1][1]} for a, b in ranges]


def _shard(batches: list[pa.RecordBatch], symbols: list[np.ndarray], text: str, bench: Windows, carry: list[str]):
    which, at, offsets = occurrences(symbols, bench)
    total, count = int(offsets[-1]), len(symbols)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + bench.length[which], -1)
    hit = np.cumsum(edge)[:total] > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[offsets[1:]] - sums[offsets[:-1]]
    doc = np.searchsorted(offsets, at, side="right") - 1
    items: dict[int, set[str]] = {}
    for d, w in {*zip(doc.tolist(), which.tolist())}:
        items.setdefault(d, set()).update(bench.items(w))
    n = 0
    for batch in batches:
        texts, spans = batch.column(text), []
        for i in range(batch.num_rows):
            if not n_hit[n + i]:
                spans.append([])
                continue
            a, b = offsets[n + i], offsets[n + i + 1]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0])))).reshape(-1, 2)
            spans.append(_char_spans(texts[i].as_py().encode(), turn.tolist()))
        rows = range(n, n + batch.num_rows)
        yield batch_of(
            batch,
            carry,
            n_words=pa.array([len(symbols[i]) for i in rows], pa.int64()),
            n_hit=pa.array(n_hit[n : n + batch.num_rows], pa.int64()),
            items=pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())),
            spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        )
        n += batch.num_rows
    assert n == count


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit (words in occurrences), items (ids as sorted strings), spans (code points, merged).

    A null or empty text has no words, hits or items; a null item id counts as the empty string; repeated
    documents each get their row, repeated items count once; an empty benchmark hits nothing, an empty table gives no
    row; texts of any length are searched whole. Of the columns, ``carry`` (all by default) stay, save those that have an
    output's name.
    """
    names, ddl = carried(docs, carry, OWN)
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(item_text)).filter(F.col(item_text).isNotNull())
    parts = _parts(rows.toLocalIterator())
    part, after = next(parts, []), next(parts, None)
    out = docs.select(*dict.fromkeys([*names, text]))
    if after is None:
        return _pass(out, spark.sparkContext.broadcast(Windows(part, window)), text, names, ddl)
    # A larger benchmark takes a pass over the documents for each part. Passes are stored and hold one part at a time, in
    # the driver, too; each adds its hits to those found so far.
    out = docs.select(F.struct(*names).alias("row") if names else F.lit(None).cast("int").alias("row"), F.col(text).alias("text"))
    seen = None
    while part is not None:
        sent = spark.sparkContext.broadcast(Windows(part, window))
        carry_on, kept = carried(out, None, OWN)
        found = _pass(out, sent, "text", carry_on, kept)
        if seen is not None:
            found = found.withColumns({"items": F.array_union("items_so_far", "items"), "spans": F.concat("spans_so_far", "spans")})
        seen = stored(found.select("row", "text", "n_words", "items", "spans"), "hits")
        sent.destroy()
        out = seen.select("row", "text", F.col("items").alias("items_so_far"), F.col("spans").alias("spans_so_far"))
        part, after = after, next(parts, None)
    done = _merged(seen, "text", ["row"])
    return done.select(*(["row.*"] if names else []), *OWN)


def _parts(items: Iterator[tuple[str, str]]) -> Iterator[list[tuple[str, bytes]]]:
    """The items in runs of about PASS_BYTES, one item at least; only one run is held."""
    part, room = [], PASS_BYTES
    for k, t in items:
        if part and room < len(t):
            yield part
            part, room = [], PASS_BYTES
        part.append((k, t.encode()))
        room -= len(t)
    yield part


def _pass(docs: DataFrame, bench, text: str, names: list[str], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = bench.value
        get = windows.vocabulary.get
        held, symbols, n_symbols, n_bytes = [], [], 0, 0
        for whole in batches:
            for batch in chunks(whole, text):
                for t in binaries(batch.column(text)):
                    w = words(t)
                    ids = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
                    symbols.append(ids)
                    n_symbols += int(np.count_nonzero(ids))
                    n_bytes += len(t or b"")
                held.append(batch)
                if n_symbols >= 4 * SHARD_SYMBOLS or n_bytes >= SHARD_BYTES:
                    yield from _shard(held, symbols, text, windows, names)
                    held, symbols, n_symbols, n_bytes = [], [], 0, 0
        if held:
            yield from _shard(held, symbols, text, windows, names)

    return docs.mapInArrow(freed(run), f"{ddl}n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>")


def _merged(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Spans of several passes over one text, merged; hits counted anew from them."""
    first = F.array_sort("spans")
    joined = F.aggregate(
        first,
        F.array().cast("array<struct<start: int, end: int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] + 1 >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    df = df.withColumn("spans", joined)
    pieces = F.transform("spans", lambda s: F.size(F.regexp_extract_all(F.lower(F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])), F.lit(WORD_FORM), F.lit(0))))
    n_hit = F.aggregate(pieces, F.lit(0), lambda a, b: a + b).cast("long")
    return df.select(*names, "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def contaminated() -> F.Column:
    """The contamination rule: some hit, and hits make a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "spans",
    )
