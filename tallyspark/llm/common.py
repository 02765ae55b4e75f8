"""What several operators of this subpackage share: words, bounded chunks, shared storage, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored  # noqa: F401

WORD_FORM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 2 << 20
CACHE_WORDS = 250_000
#: Rounds of ``components`` of which one is stored.
HELD_ROUNDS = 3


def _word_table() -> bytes:
    table = bytearray(range(256))
    for i in range(128):
        if 65 <= i <= 90:
            table[i] = i + 32
        elif not (48 <= i <= 57 or 97 <= i <= 122):
            table[i] = 32
    return bytes(table)


WORD_TABLE = _word_table()


def words(text: bytes | None) -> list[bytes]:
    """The maximal runs of WORD_FORM in a UTF-8 text whose A-Z are lower-cased; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


class Hashes(dict):
    """64-bit hash of a byte string, kept for the most recent distinct ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which Arrow gives back what it holds no batches in. Spark keeps a task's Python worker for the next
    one, and Arrow keeps its most until then, beside what that task takes."""

    @wraps(run)
    def then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return then_free


def batch_of(like: pa.RecordBatch | None, carry: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The carried columns of a batch, then new ones; strings keep Spark's Arrow types."""
    arrays = {name: like.column(name) for name in carry} | new
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def carried(df: DataFrame, carry: list[str] | None, own: tuple[str, ...]) -> tuple[list[str], str]:
    """Names to carry through an operator and their DDL; a column that has an output's name gives way to it."""
    names = [c for c in (df.columns if carry is None else carry) if c not in own]
    kinds = dict(df.dtypes)
    return names, "".join(f"`{c}` {kinds[c]}, " for c in names)


def apart(docs: DataFrame, text: str) -> DataFrame:
    """``text``, and ``row`` with all other columns, so that an operator can carry them whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.col(f"`{text}`").alias("text"), (F.struct(*others) if others else F.struct(F.lit(None).alias("none"))).alias("row"))


def together(parted: DataFrame, columns: list[str], text: str, new: dict[str, F.Column] | None = None) -> DataFrame:
    """The columns that ``apart`` took apart, in their order; those in ``new`` have these values."""
    new = new or {}
    return parted.select(*(new[c].alias(c) if c in new else F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in columns))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python workers import it; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    # The driver serves the file from where it lies, so it stays until the driver ends.
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tallyspark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b): comp is the least id of its connected component.

    First each id keeps its edge to the least of its lesser neighbours and hands its other edges to that one, which
    leaves far fewer in dense places. Then, until nothing changes, least labels move along edges, are proposed to the
    label an id had so far, so that whole trees hang themselves on lesser ones, and jump to their label's label. In a
    simulation of these steps chains of 200, 1,000, 4,000 and 100,000 ids in random order took 9, 11, 15 and 20 rounds.
    Each round is joins and aggregates over (id, comp) rows, which the executors hold, as they do edges; every
    HELD_ROUNDS-th is stored in the shared folder, as plans grow threefold a round until then. The last one's table, and what it is made of, belong to
    ``scratch`` where one is given.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    hub = down.groupBy("a").agg(F.min("b").alias("hub"))
    over = down.join(hub, "a").filter("b <> hub").select(F.col("hub").alias("a"), "b")
    few = hub.select("a", F.col("hub").alias("b")).union(over).distinct()
    own = Scratch(edges.sparkSession)
    both = own.held(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # Labels since the last stored one, which they could be made of again.
    kept = Scratch(edges.sparkSession)
    label = kept.held(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    for number in count(2):
        near = (
            both.join(label.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("comp").alias("near"))
        )
        moved = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("via"))
        stay, hook = F.struct("id", "was", "via"), F.struct(F.col("was").alias("id"), F.lit(None).alias("was"), "via")
        sent = moved.select(F.inline(F.when(F.col("via") < F.col("was"), F.array(stay, hook)).otherwise(F.array(stay))))
        hung = sent.groupBy("id").agg(F.max("was").alias("was"), F.min("via").alias("via"))
        jump = label.select(F.col("id").alias("via"), F.col("comp").alias("root"))
        new = hung.join(jump, "via", "left").select("id", F.least("via", F.coalesce("root", "via")).alias("comp"), "was")
        new = new.select("id", "comp", (F.col("comp") != F.col("was")).alias("moved"))
        if number % HELD_ROUNDS:
            found = kept.held(new)
        else:
            past, kept = kept, Scratch(edges.sparkSession)
            found = kept.stored(new, "label")
            past.clear()
        label = found.select("id", "comp")
        if found.filter("moved").isEmpty():
            if scratch is not None:
                scratch.take(own)
                scratch.take(kept)
            return label
