"""BPE encoding and decoding over a table of distinct words, and the splitting of texts into words.

Splitting happens inside the tasks that read the documents. A block of documents becomes word numbers by
position, and its distinct words go, packed by word hash, to the task that owns their hash; there each distinct
word of the whole corpus is encoded once and its ids go back to every block that has it. A block then lays the
ids out by position. What is shuffled is a block's distinct words and its word numbers, never a row per word
occurrence, so a word that is everywhere costs one entry per block.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, freed

SPECIAL = "<|endoftext|>"
BLOCK_BYTES = 24 << 20
#: Encoded words that a task keeps at most; beyond, some are encoded again.
KNOWN_WORDS = 2_000_000
OWN = ("n_tokens", "ids", "decoded")

#: The vocabulary's own pattern, for texts whose characters all lie in PLAIN: there Python's classes agree with it.
_SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNSURE = re.compile("[^\x00-\x1b\x20-\x7f¡-©«-±´¶-¸»¿-ɏΑ-ΡΣ-ωЀ-ҁҊ-ԯ‐-‧‰-‾€ぁ-ゖァ-ヺ一-龥가-힣]")


@cache
def library(path: str):
    """The tokenizer of the tokenizers library, with truncation and padding off."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def ranked(path: str):
    """The same vocabulary for tiktoken, which takes it as byte strings with ranks; the special token keeps its id."""
    import tiktoken

    t = library(path)
    text_of = _byte_letters()
    ranks = {bytes(text_of[c] for c in piece): i for piece, i in t.get_vocab(with_added_tokens=False).items() if piece != SPECIAL}
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={SPECIAL: t.token_to_id(SPECIAL)})


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def split(text: str, path: str) -> list[str]:
    """The vocabulary's words of a text, in order; the special token is a word of its own."""
    if not text:
        return []
    if SPECIAL in text:
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(SPECIAL)
            out += split(part, path)
        return out
    if _UNSURE.search(text) is None:
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]


def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes end to end, each id's start and length."""
    t = library(path)
    letters = _byte_letters()
    size = t.get_vocab_size(with_added_tokens=True)
    table = [b""] * size
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        table[i] = piece.encode() if piece == SPECIAL else bytes(letters[c] for c in piece)
    length = np.array([len(p) for p in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length, length


def join_pieces(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Bytes of a sequence of ids, by a join of each id with its piece."""
    data, start, length = table
    size = length[ids]
    at = np.repeat(start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return data[at].tobytes()


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _strings(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return _pack(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items))


def _unstrings(blob: bytes) -> list[bytes]:
    data = _unpack(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4).astype(np.int64)) + 4 + 4 * n
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _arrays(parts: list[np.ndarray]) -> bytes:
    """Sequences of non-negative numbers in as few bytes a number as their largest needs, with their lengths."""
    lengths = np.array([len(p) for p in parts], np.uint32)
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    wide = int(whole.max(initial=0))
    kind = 1 if wide < 1 << 8 else 2 if wide < 1 << 16 else 4
    planes = np.ascontiguousarray(whole.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :kind].T)
    return _pack(np.array([len(parts), kind], np.uint32).tobytes() + lengths.tobytes() + planes.tobytes())


def _unarrays(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _unpack(blob)
    n, kind = np.frombuffer(data, np.uint32, 2).tolist()
    lengths = np.frombuffer(data, np.uint32, n, 8).astype(np.int64)
    planes = np.frombuffer(data, np.uint8, offset=8 + 4 * n).reshape(kind, -1)
    whole = np.zeros((planes.shape[1], 4), np.uint8)
    whole[:, :kind] = planes.T
    return whole.view("<u4").ravel(), lengths


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return _pack(sink.getvalue().to_pybytes())


def _row_batch(keys: list[int], parts: list[int], at: list[bytes], body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(at, pa.binary()), pa.array(body, pa.binary())],
        names=["block", "part", "at", "body"],
    )


def _blocks(text: str, names: list[str], path: str, spread: int, most: int, give_words: bool):
    """Each block of documents: a row for each part of its distinct words, or one row with its word numbers.

    The key of a block is a digest of its words and their numbers, so both forms of a block find each other, and
    blocks of equal words may share their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number: dict[str, int] = defaultdict(count().__next__)
        rows: list[np.ndarray] = []
        size = 0

        def out():
            items = [w.encode() for w in number]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
            digest = hashlib.blake2b(flat.tobytes(), digest_size=8)
            digest.update(np.array([len(r) for r in rows], np.uint32).tobytes())
            for w in items:
                digest.update(w)
            key = int.from_bytes(digest.digest(), "little", signed=True)
            if not give_words:
                table = pa.Table.from_batches(held).select(names).combine_chunks() if names else None
                carry = _ipc(table) if names else b""
                yield _row_batch([key], [-1], [_arrays(rows)], [carry])
                return
            owner = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items)) % np.uint64(spread)
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[order], prepend=np.uint64(spread)))
            parts, at, words = [], [], []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                parts.append(int(owner[own[0]]))
                at.append(_arrays([np.diff(own, prepend=0)]))
                words.append(_strings([items[i] for i in own.tolist()]))
            yield _row_batch([key] * len(parts), parts, at, words)

        for whole in batches:
            column = whole.column(text)
            start = 0
            for i in range(whole.num_rows):
                t = column[i].as_py()
                w = split(t, path) if t else []
                rows.append(np.fromiter(map(number.__getitem__, w), np.uint32, len(w)))
                size += len(t) if t else 0
                if size >= most:
                    held.append(whole.slice(start, i + 1 - start))
                    start = i + 1
                    yield from out()
                    held, number, rows, size = [], defaultdict(count().__next__), [], 0
            if start < whole.num_rows:
                held.append(whole.slice(start))
        if held:
            yield from out()

    return run


def _encoded(path: str):
    """Every distinct word of a part is encoded once, however many blocks have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ranked(path)
        special = SPECIAL.encode()
        encode = code._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        last = (None, None)
        for batch in batches:
            for key, part, at, words in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "body"))):
                if (key, part) == last:  # blocks of equal words share one answer
                    continue
                if part != last[1] or len(known) > KNOWN_WORDS:
                    known = {}
                last = (key, part)
                ids = []
                for w in _unstrings(words):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = [code.encode_single_token(w)] if w == special else encode(w)
                    ids.append(got)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                whole = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
                yield _row_batch([key], [part], [at], [_arrays([lengths, whole])])

    return run


def _laid_out(names: list[str], finish):
    """The ids of a block's words, laid out by position; ``finish`` makes the output columns from each document's ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = 0
        got = []
        for at, ids in zip(right.column("at").to_pylist(), right.column("body").to_pylist()):
            index = np.cumsum(_unarrays(at)[0].astype(np.int64))
            both, sizes = _unarrays(ids)
            got.append((index, both[: sizes[0]].astype(np.int64), both[sizes[0] :]))
            n += len(index)
        length = np.zeros(n, np.int64)
        for index, sizes, _ in got:
            length[index] = sizes
        start = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.uint32)
        for index, sizes, ids in got:
            flat[np.repeat(start[index] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))] = ids
        tables = []
        # Several blocks may have equal words; each keeps its own documents.
        for numbers, body in zip(left.column("at").to_pylist(), left.column("body").to_pylist()):
            order, docs = _unarrays(numbers)

            def each():
                a = 0
                for size in docs.tolist():
                    w = order[a : a + size]
                    a += size
                    s = length[w]
                    yield flat[np.repeat(start[w] - np.cumsum(s) + s, s) + np.arange(int(s.sum()))]

            new = finish(each())
            held = pa.ipc.open_stream(_unpack(body)).read_all() if names else None
            tables.append(pa.table(({c: held.column(c) for c in names} if names else {}) | new))
        return pa.concat_tables(tables) if tables else pa.table({})

    return run


def encode(docs: DataFrame, path: str, finish, ddl: str, own: tuple[str, ...], text: str = "text", carry: list[str] | None = None, spread: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Carried columns of ``docs`` with what ``finish`` makes of every document's ids.

    ``finish`` takes an iterator over uint32 arrays, one for each document of a block, and returns Arrow arrays by
    name. A null or empty text has no ids; a text of any length is encoded whole. Repeated rows each get their row, an
    empty table none. An input column that has an output's name gives way to it. Splitting runs once for the words and once for the word numbers, which moves far less than
    keeping the texts; ``docs`` must give equal rows both times, as stored tables do, else the job fails.
    """
    names, kept = carried(docs, carry, own)
    spread = spread or min(max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 4096)
    rows = docs.select(*dict.fromkeys([*names, text]))
    form = "block long, part int, at binary, body binary"
    words = rows.mapInArrow(freed(_blocks(text, names, path, spread, block_bytes, True)), form)
    ids = words.repartition(spread, "part").sortWithinPartitions("part", "block").mapInArrow(freed(_encoded(path)), form)
    whole = rows.mapInArrow(freed(_blocks(text, names, path, spread, block_bytes, False)), form)
    return whole.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_laid_out(names, finish), f"{kept}{ddl}")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_decode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, digest: bool = False, **sizes: int) -> DataFrame:
    """n_tokens, ids (array<int>) and the decoded text of every document; with ``digest`` also ids_sha256 and
    decoded_sha256. Odd rows are treated as by ``encode``."""
    made: list = []

    def finish(docs_ids):
        table = made[0] if made else made.append(pieces(path)) or made[0]
        ids, decoded = [], []
        for x in docs_ids:
            ids.append(x.astype(np.int32))
            decoded.append(join_pieces(x, table).decode("utf-8", "replace"))
        out = {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.list_(pa.int32())),
            "decoded": pa.array(decoded, pa.string()),
        }
        if digest:
            out |= {"ids_sha256": pa.array([_sha(x.astype("<u4").tobytes()) for x in ids]), "decoded_sha256": pa.array([_sha(t.encode()) for t in decoded])}
        return out

    more = ("ids_sha256", "decoded_sha256") * digest
    ddl = "n_tokens long, ids array<int>, decoded string" + "".join(f", {c} string" for c in more)
    return encode(docs, path, finish, ddl, OWN + more, text, carry, **sizes)


def digests(docs: DataFrame, path: str, text: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text: what `encode_decode` gives, digested block by block."""
    made: list = []

    def finish(docs_ids):
        table = made[0] if made else made.append(pieces(path)) or made[0]
        n, a, b = [], [], []
        for x in docs_ids:
            n.append(len(x))
            a.append(_sha(x.astype("<u4").tobytes()))
            b.append(_sha(join_pieces(x, table).decode("utf-8", "replace").encode()))
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", own, text, ["doc_id"], **sizes)
