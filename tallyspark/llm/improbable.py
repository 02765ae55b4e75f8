"""Document fingerprints from improbable byte windows, kept in chained Bloom filters.

1. Every window of 64 bytes has an entropy, told in 128ths of a bit. Counted over all windows of
   all documents, the rarer a level, the more improbable its windows; windows of little entropy (runs of one sign,
   blank space) say nothing and rank behind all others.
2. In every 64 neighbouring windows the rarest one (the first on ties) scores. Windows that score 16 times or more are
   the text's features: about what stands out within its surroundings, wherever in a text these lie.
3. Features go into a Bloom filter of 2,048 bits, five bits each; after 160 features the next filter of the chain begins.
4. Two chains compare by the bits their filters share, as a share of what they can have in common beyond chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, chunks

WINDOW = 64
NEIGHBOURS = 64
LEAST_SCORE = 16
#: Levels of a window's entropy: 128 for each of its six bits.
LEVELS = 768
#: Windows below this level, 1.8 bits, rank behind all others.
FLAT = 230
BITS = 2048
HASHES = 5
FEATURES = 160
#: Windows looked at in one go, so that a text's length doesn't decide about memory.
STRETCH = 1 << 21
#: Text that a range of neighbouring documents holds about.
RANGE_BYTES = 64 << 20
#: Keys looked at, for each range and in all, to tell where ranges begin.
SEEN = 60
SEEN_MOST = 1 << 20
#: What documents are ordered by.
ORDER = ("doc_id", "hash", "at")
#: A window's rank and its place in a stretch, with its margins, share a 32-bit key.
_PLACE_BITS = np.uint32(22)
_NEVER = np.uint32(0xFFFFFFFF)


def _parts() -> np.ndarray:
    """c * log2(c) for the counts of a window, in whole steps of 2**-16, so that sums don't depend on their order."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    return np.rint(c * np.log2(np.maximum(c, 1)) * 65536).astype(np.int32)


PARTS = _parts()
_LEVEL_SHIFT = 15  # PARTS[WINDOW] is LEVELS << 15
_GROW = np.append(np.diff(PARTS), 0).astype(np.int32)  # what a count adds when it grows by one
_SHRINK = np.append(0, -np.diff(PARTS)).astype(np.int32)


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS - 1, of every window of ``data``: one for each place where one begins.

    The data is cut into lanes of equal length, and the windows of all lanes slide on together, a byte a step.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    lanes = max(1, n // 1024)
    steps = -(-n // lanes)
    padded = np.zeros(lanes * steps + WINDOW, np.uint8)
    padded[: len(data)] = data
    # [step, lane]: the count, among its lane's, of the byte that the lane's window takes in at a step
    cells = np.lib.stride_tricks.as_strided(padded, (steps + WINDOW - 1, lanes), (1, steps)) + np.arange(lanes, dtype=np.int64) * 256
    counts = np.zeros(lanes * 256, np.uint8)
    total = np.zeros(lanes, np.int32)
    out = np.empty((steps, lanes), np.int32)
    for step in range(steps + WINDOW - 1):
        if step >= WINDOW:
            cell = cells[step - WINDOW]
            c = counts[cell]
            total += _SHRINK[c]
            counts[cell] = c - 1
        cell = cells[step]
        c = counts[cell]
        total += _GROW[c]
        counts[cell] = c + 1
        if step >= WINDOW - 1:
            out[step - WINDOW + 1] = total
    return np.minimum((PARTS[WINDOW] - out) >> _LEVEL_SHIFT, LEVELS - 1).astype(np.int16).T.reshape(-1)[:n]


def _fitting(ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which of the windows from a to b lie within one of the joined texts that end at ``ends``."""
    fits = np.ones(b - a, bool)
    first, last = np.searchsorted(ends, (a, b + WINDOW), "right")
    for e in ends[first:last].tolist():
        fits[max(0, e - WINDOW + 1 - a) : max(0, e - a)] = False
    return fits


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbouring keys."""
    width = 1
    while width < n:
        step = min(width, n - width)
        keys = np.minimum(keys[:-step], keys[step:])
        width += step
    return keys


def chosen(data: bytes, ends: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the features of joined texts, which end at ``ends``, begin. Neighbourhoods may stick out at a text's ends.

    63 windows between two texts cross their border and rank last, so no neighbourhood sees windows of two texts.
    """
    found, margin = [], NEIGHBOURS - 1
    whole = np.frombuffer(data, np.uint8)
    windows = len(whole) - WINDOW + 1
    for at in range(0, max(windows, 0), STRETCH):
        a, b = max(0, at - margin), min(windows, at + STRETCH + margin)
        own = ranks[levels(whole[a : b + WINDOW - 1])] << _PLACE_BITS | np.arange(b - a, dtype=np.uint32)
        keys = np.full(b - a + 2 * margin, _NEVER)
        keys[margin : margin + b - a] = np.where(_fitting(ends, a, b), own, _NEVER)
        best = _least(keys, NEIGHBOURS)
        # The rarest window's place never moves back from one neighbourhood to the next, so a window's wins are a run.
        cuts = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]))
        won = best[cuts[:-1]]
        won = won[(np.diff(cuts) >= LEAST_SCORE) & (won != _NEVER)]
        hits = a + (won & np.uint32((1 << _PLACE_BITS) - 1)).astype(np.int64)
        found.append(hits[(hits >= at) & (hits < at + STRETCH)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _chains(hashes: list[list[int]]) -> list[bytes]:
    """A chain for each text: for every filter its number of features, two bytes, and its bits."""
    n = np.array([len(h) for h in hashes], np.int64)
    filters = -(-n // FEATURES)
    flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(n.sum()))
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.cumsum(filters) - filters, n) + nth // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, (flat >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    sizes = np.bincount(row, minlength=len(bits)).astype("<u2")
    packed = np.concatenate((sizes[:, None].view(np.uint8), np.packbits(bits, axis=1, bitorder="little")), axis=1).tobytes()
    each, cuts = 2 + BITS // 8, np.append(0, np.cumsum(filters))
    return [packed[each * a : each * b] for a, b in zip(cuts, cuts[1:])]


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """The chain of each text. A text shorter than a window is one feature, an empty one has an empty chain.

    A feature that a text has again is one feature; features go in by where they are first.
    """
    data = b"".join(texts)
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    at = chosen(data, ends, ranks)
    owner = np.searchsorted(ends, at, "right")
    hashes: list[dict[int, None]] = [{} for _ in texts]
    for i, p in zip(owner.tolist(), at.tolist()):
        hashes[i][xxhash.xxh3_64_intdigest(data[p : p + WINDOW])] = None
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            hashes[i][xxhash.xxh3_64_intdigest(t)] = None
    return _chains([list(h) for h in hashes])


def _bits(chain: bytes) -> np.ndarray:
    return np.frombuffer(chain, np.uint8).reshape(-1, 2 + BITS // 8)[:, 2:].copy().view(np.uint64)


def _best(a: np.ndarray, b: np.ndarray) -> float:
    """The mean, over the filters of ``a``, of the greatest normalised overlap with a filter of ``b``."""
    n_a, n_b = np.bitwise_count(a).sum(1).astype(np.float64), np.bitwise_count(b).sum(1).astype(np.float64)
    top = np.zeros(len(a))
    step = max(1, (1 << 13) // len(b))
    for at in range(0, len(a), step):  # so many filters at a time that their overlaps stay small
        some, n = a[at : at + step], n_a[at : at + step, None]
        common = np.bitwise_count(some[:, None] & b[None]).sum(2, dtype=np.int64)
        chance = n * n_b / BITS
        room = np.minimum(n, n_b) - chance
        top[at : at + step] = np.where(room > 0, (common - chance) / np.where(room > 0, room, 1), 1.0).max(1)
    return float(np.clip(top, 0.0, 1.0).mean())


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the shorter chain's filters in the longer one's; of chains of one length the mean of both ways.

    Equal chains, two empty ones among them, are 1; an empty chain and another one 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _bits(a), _bits(b)
    if len(x) == len(y):
        return (_best(x, y) + _best(y, x)) / 2
    return _best(x, y) if len(x) < len(y) else _best(y, x)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy level, the rarest first, from all windows of all texts; without windows by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(LEVELS, np.int64)
        for whole in batches:
            for batch in chunks(whole, text):
                texts = [t for t in binaries(batch.column(text)) if t]
                data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.array([len(t) for t in texts], np.int64))
                windows = len(data) - WINDOW + 1
                for at in range(0, max(windows, 0), STRETCH):
                    fits = _fitting(ends, at, min(windows, at + STRETCH))
                    count += np.bincount(levels(data[at : at + STRETCH + WINDOW - 1])[fits], minlength=LEVELS)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full])], names=["level", "n"])

    # LEVELS rows at most
    sums = docs.select(text).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(LEVELS, np.int64)
    for r in sums:
        count[r["level"]] = r["n"]
    every = np.arange(LEVELS)
    ranks = np.empty(LEVELS, np.uint32)
    ranks[np.lexsort((every, count, every < FLAT))] = every
    return ranks


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the chain of its text as bytes, in place of any column of that name.

    A null text counts as empty and has an empty chain. Chains compare where they come of the same ``ranks``, by default
    those of ``docs``.
    """
    ranks = rarity(docs, text) if ranks is None else ranks
    names = [c for c in docs.columns if c != "fingerprint"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                made = fingerprints([t or b"" for t in binaries(batch.column(text))], ranks)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], names=[*names, "fingerprint"])

    return docs.select(*names).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in names) + "fingerprint binary")


def edited(text: str, after: str) -> str:
    """``text`` whose last half is replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class _Compared:
    """The result's columns, filled row by row."""

    def __init__(self, ranks: np.ndarray):
        self.ranks = ranks

    def rows(self, ids: list, texts: list[str], chains: list[bytes], after: list[str], after_chains: list[bytes]) -> list:
        new = [edited(t, x).encode() for t, x in zip(texts, after)]
        made = fingerprints(new, self.ranks)
        near = [likeness(a, b) for a, b in zip(chains, made)]
        following = [likeness(a, b) for a, b in zip(chains, after_chains)]
        return [ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in new], chains, made, near, following]


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_OWN = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _arrays(kind: pa.DataType, rows: list) -> list[pa.Array]:
    kinds = (kind, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    return [pa.array(column, k) for column, k in zip(rows, kinds)]


def _key() -> Column:
    return F.struct(*ORDER).alias("key")


def _cuts(rows: DataFrame, parts: int, count: int) -> DataFrame:
    """One row with ``cuts``: the keys that all ranges but the first begin with, picked by samples. It goes through the
    driver, so every plan that uses it has the same ranges."""
    share = min(1.0, min(SEEN * parts, SEEN_MOST) / max(count, 1))
    seen = rows.select(_key()).sample(share, 1).agg(F.sort_array(F.collect_list("key")).alias("s"))
    nth = f"cast(cast(i AS long) * size(s) div {parts} AS int)"
    picked = seen.select(F.expr(f"transform(filter(sequence(0, {parts - 1}), i -> i > 0), i -> get(s, {nth}))").alias("cuts"))
    return rows.sparkSession.createDataFrame(picked.collect(), picked.schema)


def _in_ranges(rows: DataFrame, parts: int, count: int) -> DataFrame:
    """``rows`` with ``part``, the number of their range: how many of the cuts aren't beyond their key, by binary search."""
    mid = "cast((s.lo + s.hi) div 2 AS int)"
    narrowed = f"if(cuts[{mid}] <= key, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid}))"
    part = f"aggregate(array_repeat(0, {parts.bit_length()}), named_struct('lo', 0, 'hi', {parts - 1}), (s, x) -> if(s.lo < s.hi, {narrowed}, s), s -> s.lo)"
    return rows.withColumn("key", _key()).crossJoin(F.broadcast(_cuts(rows, parts, count))).withColumn("part", F.expr(part)).drop("key", "cuts")


def neighbours(docs: DataFrame, ranks: np.ndarray | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the one that follows by id, then by text hash, nulls first; the first one follows the last. So
    a single document follows itself. Repeated rows each get their row and follow each other. A null text is empty.
    An empty table gives no row. Other columns are left out, whatever their names.

    Texts are dealt once, into ranges of the order, each with a copy of the document that the next range begins with,
    which is looked up beforehand. So a task has all its documents' neighbours, and nothing is stored on the way.
    ``docs`` is read several times and has to give the same rows, in the same partitions, each time.
    """
    spark: SparkSession = docs.sparkSession
    # Taken apart by where they lie, rows of one id and text don't have to meet in one task.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ranks = rarity(rows) if ranks is None else ranks
    kind = dict(rows.dtypes)["doc_id"]
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # As many ranges as the text needs, and enough for all tasks to have one.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = _in_ranges(rows, parts, count)
    # A number, id and hash for each range that holds documents; texts stay in Spark.
    first = dealt.groupBy("part").agg(F.min(_key()).alias("key")).select("part", "key.doc_id", "key.hash").orderBy("part").collect()
    before = [r["part"] for r in first[-1:] + first[:-1]]
    heads = spark.createDataFrame([(p, r["doc_id"], r["hash"]) for p, r in zip(before, first)], f"part int, head_id {kind}, head_hash long")
    own = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    after = rows.join(F.broadcast(heads), own).groupBy("part").agg(F.any_value("text").alias("text"), F.lit(True).alias("after"))
    both = dealt.withColumn("after", F.lit(False)).unionByName(after, allowMissingColumns=True)
    ranges = both.repartitionById(parts, "part").sortWithinPartitions("after", *ORDER).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared, held = _Compared(ranks), None
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                chains = fingerprints([t.encode() for t in texts], ranks)
                if held is not None:
                    ids, texts, chains = [held[0], *ids], [held[1], *texts], [held[2], *chains]
                # What a range holds last is the copy, which gets no row.
                held = (ids[-1], texts[-1], chains[-1])
                if len(ids) > 1:
                    made = compared.rows(ids[:-1], texts[:-1], chains[:-1], texts[1:], chains[1:])
                    yield pa.RecordBatch.from_arrays(_arrays(batch.column("doc_id").type, made), names=list(_NAMES))

    return ranges.mapInArrow(run, f"doc_id {kind}, {_OWN}")


def digests(found: DataFrame) -> DataFrame:
    """``neighbours`` with the chains as lower-case hex strings."""
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
