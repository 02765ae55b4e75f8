"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of five-word shingles, MinHash signatures and bands; rows and bands follow from the
   similarity and the recall wanted. Equal sets are one class from here on, whatever the number of copies.
2. Classes are shuffled on their band hashes. Within a bucket, each two classes are compared by a byte of every
   MinHash value; a pair belongs to the first band it agrees in, so it is looked at once. Classes without a
   promising partner drop out here. A large bucket is cut into blocks, and a task takes one pair of blocks.
3. The full sets of the classes that are left go to those buckets, again in pairs of blocks of bounded size. A task
   verifies its pairs by counting common shingles, and gives back each class's links and a spanning forest of the
   linked classes, not the pairs. Groups are formed of verified links only.
4. Links add up for each class, forests join into the final classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_FORM, Hashes, Scratch, batch_of, binaries, carried, chunks, components, freed, stored, words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Classes, and shingles, that a block of full sets holds about.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
#: Classes that a block of signatures holds about.
SKETCH_BLOCK = 4096
#: Standard deviations below the mean that the agreement of two signatures may lie for a pair to be promising.
SPARE = 5.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band can have, and so the fewest false candidates, for the recall at the similarity."""
    for r in range(most, 0, -1):
        agree = similarity**r
        b = 1 if agree == 1 else math.ceil(math.log(1 - recall) / math.log1p(-agree)) if agree > 1e-9 else most + 1
        if b * r <= most:
            return b, r
    raise ValueError("no banding reaches this recall with so few hashes")


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], hashes: Hashes, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words than a shingle is one shingle, none has none."""
    lists = [words(t) for t in texts]
    flat = hashes.array([w for some in lists for w in some])
    n = np.array([len(w) for w in lists], np.int64)
    out, total = [], len(flat)
    rolled = np.zeros(max(0, total - size + 1), np.uint64)
    for i in range(size):
        rolled = rolled * _MIX + flat[i : i + len(rolled)]
    rolled = _mixed(rolled)
    start = 0
    for k in n.tolist():
        if k >= size:
            out.append(np.unique(rolled[start : start + k - size + 1]))
        elif k:
            short = np.uint64(k)
            with np.errstate(over="ignore"):
                for x in flat[start : start + k]:
                    short = short * _MIX + x
            out.append(_mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += k
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, text: str, carry: list[str], bands: int, rows: int, size: int) -> DataFrame:
    """Carried columns with the digest of the shingle set (null for a text without words), the band hashes, and a
    sketch: four bytes of every band hash, then one of every MinHash value."""
    names, ddl = carried(docs, carry, ("digest", "n_shingles", "bands", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = Hashes(), _multipliers(bands * rows)
        for whole in batches:
            for batch in chunks(whole, text):
                sets = shingle_sets(binaries(batch.column(text)), hashes, size)
                full = [s for s in sets if len(s)]
                band = np.zeros((len(full), bands), np.uint64)
                low = np.zeros((len(full), bands * rows), np.uint8)
                if full:
                    flat = np.concatenate(full)
                    starts = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                    for b in range(bands):
                        for k in range(b * rows, (b + 1) * rows):
                            least = np.minimum.reduceat(flat * by[k], starts)
                            low[:, k] = least >> np.uint64(24)
                            band[:, b] = _mixed(band[:, b] * _MIX + least)
                sketch = np.concatenate((band.astype("<u4").view(np.uint8).reshape(len(full), 4 * bands), low), 1)
                each = iter(zip(band.view(np.int64).tolist(), sketch))
                got = [next(each) if len(s) else ([], None) for s in sets]
                yield batch_of(
                    batch,
                    names,
                    digest=pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                    bands=pa.array([b for b, _ in got], pa.list_(pa.int64())),
                    sketch=pa.array([None if k is None else k.tobytes() for _, k in got], pa.binary()),
                )

    form = "digest binary, n_shingles long, bands array<long>, sketch binary"
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(freed(run), f"{ddl}{form}")


def _with_sets(docs: DataFrame, text: str, carry: list[str], size: int) -> DataFrame:
    names, ddl = carried(docs, carry, ("shingles",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for batch in chunks(whole, text):
                sets = shingle_sets(binaries(batch.column(text)), hashes, size)
                yield batch_of(batch, names, shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.mapInArrow(freed(run), f"{ddl}shingles binary")


def common_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many shingles each two sets have in common, by products of blocks of the membership matrix."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    of, column = of[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(sets), width), np.float32)
        part[of[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of batches that come ordered by ``key``, in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in key]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in key):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where the groups of a table start, and its end."""
    columns = [table.column(c).to_numpy() for c in key]
    return np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [len(columns[0])]))


def _fewest(values: int, similarity: float) -> int:
    """The fewest agreeing MinHash values of a promising pair."""
    return math.ceil(values * similarity - SPARE * math.sqrt(values * similarity * (1 - similarity)))


def _promising(bands: int, rows: int, similarity: float, tile: int = 256, small: int = 64):
    """The classes of each pair of blocks of a bucket that have a promising partner there whose first common band this is."""
    fewest, num = _fewest(bands * rows, similarity), round(similarity * 1000)
    key = ["bucket", "i", "j"]

    def partners(of: np.ndarray, low: np.ndarray, n: np.ndarray, band: int, block: np.ndarray, two: bool) -> np.ndarray:
        """Whether each class of a large group has a partner; tile by tile."""
        has = np.zeros(len(n), bool)
        for a in range(0, len(n), tile):
            some = slice(a, a + tile)
            fit = np.minimum(n[some, None], n) * 1000 >= np.maximum(n[some, None], n) * num
            for b in range(band):
                fit &= of[some, b, None] != of[:, b]
            if two:
                fit &= block[some, None] != block
            same = np.zeros(fit.shape, np.uint16)
            for k in range(low.shape[1]):
                same += low[some, k, None] == low[:, k]
            fit &= same >= fewest
            fit[np.arange(fit.shape[0]), np.arange(a, a + fit.shape[0])] = False
            has[some] |= fit.any(1)
        return has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, key):
            at = _starts(table, key)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            of, low = np.ascontiguousarray(sketch[:, : 4 * bands]).view("<u4"), np.ascontiguousarray(sketch[:, 4 * bands :])
            n, band, block = (table.column(c).to_numpy() for c in ("n_shingles", "band", "block"))
            two = table.column("i").to_numpy() != table.column("j").to_numpy()
            has = np.zeros(table.num_rows, bool)
            size = np.diff(at)
            for g in np.flatnonzero(size > small).tolist():
                some = slice(at[g], at[g + 1])
                has[some] = partners(of[some], low[some], n[some], int(band[at[g]]), block[some], bool(two[at[g]]))
            # The pairs of all small groups at once.
            rest = np.repeat(np.where(size > small, 0, at[1:]), size) - np.arange(table.num_rows) - 1
            rest = np.maximum(rest, 0)
            left = np.repeat(np.arange(table.num_rows), rest)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
            for a in range(0, len(left), 1 << 16):
                x, y = left[a : a + (1 << 16)], right[a : a + (1 << 16)]
                fit = np.minimum(n[x], n[y]) * 1000 >= np.maximum(n[x], n[y]) * num
                fit &= ~(two[x] & (block[x] == block[y]))
                x, y = x[fit], y[fit]
                fit = ~((of[x] == of[y]) & (np.arange(bands) < band[x][:, None])).any(1) & ((low[x] == low[y]).sum(1) >= fewest)
                has[x[fit]] = has[y[fit]] = True
            yield from table.filter(pa.array(has)).select(["bucket", "band", "digest"]).to_batches()

    return run


def _verified(similarity: float, bands: int):
    """Verifies the pairs of each pair of blocks of a bucket whose first common band this is; rows come ordered by them."""
    num, den = round(similarity * 1000), 1000
    key = ["bucket", "i", "j"]

    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes | None, int]]:
        seen, members = set(), []
        for row in rows:  # a class that several equal rows stand for counts once
            if row[0] not in seen:
                seen.add(row[0])
                members.append(row)
        if len(members) < 2:
            return
        sets = [np.frombuffer(r[1], np.uint64) for r in members]
        many = np.array([r[2] for r in members], np.int64)
        block = np.array([r[3] for r in members], np.int64)
        of = np.frombuffer(b"".join(r[4][: 4 * bands] for r in members), "<u4").reshape(len(members), bands)
        size = np.array([len(s) for s in sets], np.int64)
        common = common_counts(sets).astype(np.int64)
        near = common * den >= (size[:, None] + size - common) * num
        np.fill_diagonal(near, False)
        for b in range(rows[0][5]):
            near &= of[:, b, None] != of[:, b]
        if rows[0][6] != rows[0][7]:  # two blocks: pairs within one belong to that block's own task
            near &= block[:, None] != block
        total = near @ many
        for i in np.flatnonzero(total).tolist():
            yield members[i][0], None, int(total[i])
        parent = list(range(len(members)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, j in np.argwhere(np.triu(near)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
        trees: dict[int, list[int]] = {}
        for i in np.flatnonzero(total).tolist():
            trees.setdefault(root(i), []).append(i)
        for tree in trees.values():  # few edges at each class, and short ways
            for k in range(1, len(tree)):
                yield members[tree[(k - 1) // 4]][0], members[tree[k]][0], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["digest", "shingles", "copies", "block", "sketch", "band", "i", "j"]
        for table in _groups(batches, key):
            at = _starts(table, key).tolist()
            rows = list(zip(*(table.column(c).to_pylist() for c in columns)))
            out = [x for a, b in zip(at, at[1:]) for x in links(rows[a:b])]
            a, b, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its bucket that its block is in, dealt and ordered by these pairs."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return pairs.drop("other", blocks).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "digest")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE, recall: float = RECALL, block: int = BLOCK, sketch_block: int = SKETCH_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's doc_id, text hash and shingle digest; every digest's class and number of links.

    ``key`` names the class: its least digest. The class id is the least doc_id of the class, so classes that share
    that id, or whose rows all have none, have one class id but keys of their own. A link is another row whose
    similarity reaches the bound, copies with the same set included. Rows without words have no digest, link to
    nothing and stand alone. Repeated rows are copies of each other. An empty table has no rows and no classes; columns
    but id and text are ignored. Ids may have any type that can be ordered.
    """
    bands, rows = bands_and_rows(similarity, recall)
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    small = stored(signed(keyed, "text", ["doc_id", "text_hash"], bands, rows, size), "signed")
    one = scratch.stored(
        small.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.count("*").alias("copies"),
            F.min("doc_id").alias("least"),
            F.min("n_shingles").alias("n_shingles"),
            F.min(F.struct("text_hash", "doc_id")).alias("at"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "one",
    )
    # A bucket's name has its band in it.
    bucket = one.select("digest", F.posexplode("bands").alias("band", "value")).select("digest", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = bucket.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).filter("m > 1")
    sketches = shared.join(one.select("digest", "n_shingles", "sketch"), "digest").withColumn("blocks", F.ceil(F.col("m") / sketch_block).cast("int")).drop("m")
    found = _dealt(sketches, "blocks").mapInArrow(freed(_promising(bands, rows, similarity)), "bucket long, band int, digest binary")
    wanted = scratch.stored(found.distinct().join(one.select("digest", "n_shingles"), "digest"), "promising")
    # Blocks of long texts hold fewer, so what a task holds is bounded whatever the lengths.
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    placed = wanted.join(wanted.groupBy("bucket").agg(parts.cast("int").alias("blocks")), "bucket")
    # One row for each class: its text is found by hash and id, and its set made once, for all its buckets.
    places = placed.groupBy("digest").agg(F.collect_list(F.struct("bucket", "band", "blocks")).alias("places"))
    want = places.join(one, "digest").select(F.col("at.text_hash").alias("text_hash"), F.col("at.doc_id").alias("at_id"), "digest", "copies", "sketch", "places")
    # This join moves texts, so it shuffles at every size; its key has the id, so copies of a text don't meet.
    texts = keyed.join(want.hint("merge"), (keyed.text_hash == want.text_hash) & keyed.doc_id.eqNullSafe(want.at_id)).select("text", "digest", "copies", "sketch", "places")
    sets = _with_sets(texts, "text", ["digest", "copies", "sketch", "places"], size).select("digest", "shingles", "copies", "sketch", F.inline("places"))
    links = scratch.stored(_dealt(sets, "blocks").mapInArrow(freed(_verified(similarity, bands)), "a binary, b binary, n long"), "links")
    linked = links.filter("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    final = components(links.filter("b is not null").select("a", "b"), scratch).withColumnRenamed("id", "digest")
    named = final.join(one.select("digest", "least"), "digest").groupBy("comp").agg(F.min("least").alias("class_id"))
    member = final.join(named, "comp").select("digest", "comp", "class_id")
    info = (
        one.join(member, "digest", "left")
        .join(linked, "digest", "left")
        .select("digest", F.coalesce("comp", "digest").alias("key"), F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    info = stored(info, "classes")
    scratch.clear()
    return small.select("doc_id", "text_hash", "digest"), info


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its near-duplicate class, null where no row of
    it has one) and n_links. Where ids are null or repeat, the class is told by the key that ``classes`` gives.

    Null, empty and wordless texts link to nothing; repeated rows link to each other; an empty table gives no row;
    columns but id and text are ignored.
    """
    rows, info = classes(docs, text, doc_id, **options)
    return rows.join(info, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one of least doc_id, then least text hash, stays.

    Rows without words (null and empty texts among them) all stay. Of rows that repeat with the same id and text one
    stays. A null id comes last. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    rows, info = classes(docs, text, doc_id, **options)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # The first row of each set, then of each class: rows of one class never meet before they are aggregated.
    first = rows.filter("digest is not null").groupBy("digest").agg(F.min(row).alias("first"))
    best = first.join(info.select("digest", "key"), "digest").groupBy("key").agg(F.min("first").alias("best")).select("best.doc_id", "best.text_hash")
    again = rows.filter("digest is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")).filter("times > 1")
    same = best.doc_id.eqNullSafe(again.doc_id) & (best.text_hash == again.text_hash)
    # Held until the session's cache is cleared, as the rows that are returned still need it.
    best = Scratch(docs.sparkSession).held(best.join(again, same, "left").select(best.doc_id, best.text_hash, F.coalesce("times", F.lit(1)).alias("times")))
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(_lowered(F.col(text)).rlike(WORD_FORM), F.lit(False)).alias("words"), F.struct(*docs.columns).alias("row"))
    bare = whole.filter(~F.col("words")).select("row.*")
    few = whole.filter("words").join(best.hint("merge"), whole.doc_id.eqNullSafe(best.doc_id) & (whole.text_hash == best.text_hash)).select(whole.doc_id, whole.text_hash, "row", "times")
    # Only rows that repeat are dealt anew; each task first leaves one of its own, so copies of a row don't meet.
    once = few.filter("times > 1").groupBy("text_hash", "doc_id").agg(F.first("row").alias("row"))
    return bare.unionByName(few.filter("times = 1").select("row.*")).unionByName(once.select("row.*"))


def _lowered(text):
    """A-Z in lower case, for WORD_FORM."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())
