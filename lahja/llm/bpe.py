"""Byte-level BPE encoding and decoding.

Encoding: texts are split into pre-tokens with their positions; every distinct pre-token is encoded once in the
whole job, after a shuffle on the word; ids are joined back and reassembled by position.

Words are told apart by their characters; hashes only propose equal ones and choose the bucket.

The positions of a block's pre-tokens (some dozen MB of text of one input partition) are kept as an array of
indexes into the block's own list of words, so that only a block's distinct words travel, once each way, and
hot words cost one row part per block. Words are sent in packed parts by hash bucket; a bucket's task keeps one
dictionary of ids, bounded by the number of shuffle partitions. A block's ids and its position arrays meet in a
co-group on the block.

Both sides of that co-group scan the input: to write words and positions once instead would take more disk than it
saves time. Their blocks carry a fingerprint of the words, so a source that
yields other rows when it is read again fails loudly instead of giving wrong ids; give a written table (the
pipeline and the queries do).

Decoding: ids are looked up in the token-byte table, which has the fixed size of the vocabulary and is broadcast
(a map-side join), and the bytes are joined by position.

Defined results: a null text has null ids, an empty one none. Rows that repeat stay. Null ids of documents are
kept. Other columns don't matter. Decoding gives back the text exactly; unknown or negative token ids fail, and
bytes that are not UTF-8 become the replacement character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions, small_batches
from ._text import batches, distinct, flat, pretokens, spelled

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block; its words and index arrays are held by one task.
BLOCK_CHARS = 16 << 20
#: Pre-tokens of a part of a block; a longer document is a part of its own.
PART_TOKENS = 1 << 19
#: Words of which a task keeps the ids, so that no memory grows with the vocabulary.
KNOWN = 1 << 18
#: Buckets for each shuffle partition.
BUCKETS = 4


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Block:
    """Documents in order, as indexes into the list of their distinct words."""

    def __init__(self, places: bool = True) -> None:
        self.places = places  # whether the positions are wanted, or the words only
        self.ids: list = []
        self.sizes: list[int] = []  # pre-tokens of each document, -1: null text
        self.index: list[np.ndarray] = []
        self.word_of: dict[bytes, int] = {}
        self.hashes: list[np.ndarray] = []
        self.chars = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        for a, b in batches(texts):
            part = texts[a:b]
            cp, start, end, first = pretokens([t or "" for t in part])
            codes, at, h = distinct(cp, start, end)
            get, place, fresh = self.word_of, np.empty(len(at), np.uint32), []
            for k, word in enumerate(spelled(cp, start[at], end[at])):
                n = len(get)
                place[k] = own = get.setdefault(word, n)
                if own == n:
                    fresh.append(k)
            self.hashes.append(h[fresh])
            if self.places:
                self.index.append(place[codes])
                self.sizes += [-1 if t is None else n for t, n in zip(part, np.diff(first).tolist())]
                self.ids += ids[a:b]
            self.chars += len(cp)

    def all_hashes(self) -> np.ndarray:
        return np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)

    def name(self, number: int) -> str:
        h = self.all_hashes()
        return f"{TaskContext.get().partitionId()}-{number}-{int(np.bitwise_xor.reduce(h)) if len(h) else 0:x}-{len(h)}"


def _blocks(source: Iterator[pa.RecordBatch], block_chars: int, places: bool) -> Iterator[tuple[str, Block]]:
    block, number = Block(places), 0
    for batch in source:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        size = pc.utf8_length(texts).fill_null(0).to_numpy()
        cut = np.unique(np.cumsum(size) // max(block_chars // 4, 1), return_index=True)[1].tolist() if len(size) else []
        for a, b in zip(cut, [*cut[1:], len(ids)]):
            block.add(ids[a:b], texts.slice(a, b - a).to_pylist())
            if block.chars >= block_chars:
                yield block.name(number), block
                block, number = Block(places), number + 1
    if block.chars or block.ids:
        yield block.name(number), block


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _planes(x: np.ndarray) -> bytes:
    """uint32 as byte planes, which compress better."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


WORDS = "bucket int, block string, place binary, sizes binary, words binary"
IDS = "block string, place binary, sizes binary, ids binary"
DOCS = "block string, part int, docs binary, sizes binary, places binary"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[bytes, int] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, token_ids, n_tokens), a row for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    buckets = n * BUCKETS
    table = spark.sparkContext.broadcast(ranks if ranks is not None else load_ranks())
    kind = docs.schema[id_col].dataType
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = pa.int64() if kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    own = own.select(F.col("id").cast("bigint" if id_type == pa.int64() else "string").alias("id"), "text")

    def words(source):
        for name, block in _blocks(source, block_chars, False):
            h = block.all_hashes()
            bucket, spelling = (h % np.uint64(buckets)).astype(np.int64), list(block.word_of)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edge)):
                place = order[edge[k] : edge[k + 1]]
                found = [spelling[p] for p in place.tolist()]
                rows.append((int(k), name, pack(np.diff(place, prepend=0).astype("<u4")), pack(np.array([len(w) for w in found], "<u4")), zstandard.compress(b"".join(found), 3)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "place", "sizes", "words"])

    def to_ids(source):
        enc = encoding(table.value)
        known: dict[bytes, list[int]] = {}
        for batch in source:
            rows = []
            if len(known) > KNOWN:
                known.clear()
            for r in batch.to_pylist():
                body, at, out, sizes = zstandard.decompress(r["words"]), 0, [], []
                for size in unpack(r["sizes"], "<u4").tolist():
                    word = body[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = enc._encode_single_piece(word)
                    out += ids
                    sizes.append(len(ids))
                rows.append((r["block"], r["place"], pack(np.array(sizes, "<u4")), _planes(np.array(out, np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["block", "place", "sizes", "ids"])

    def index(source):
        for name, block in _blocks(source, block_chars, True):
            # a part is what the co-group assembles at a time
            places = np.concatenate(block.index) if block.index else np.zeros(0, np.uint32)
            sizes = np.array(block.sizes, np.int64)
            ends = np.cumsum(np.maximum(sizes, 0))
            cut = np.unique(ends // PART_TOKENS, return_index=True)[1].tolist()
            for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(sizes)])):
                lo = int(ends[a - 1]) if a else 0
                names = pa.array(block.ids[a:b], id_type)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", id_type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([names], ["id"]))
                row = (name, k, zstandard.compress(sink.getvalue().to_pybytes(), 3), pack(sizes[a:b]), _planes(places[lo : int(ends[b - 1])]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "part", "docs", "sizes", "places"])

    names = [id_col, "token_ids", "n_tokens"]

    def reassemble(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]):
        place, size, ids, total = [], [], [], 0
        for batch in left:
            for r in batch.to_pylist():
                p = np.cumsum(unpack(r["place"], "<u4"))
                s = unpack(r["sizes"], "<u4")
                place.append(p)
                size.append(s)
                ids.append(_from_planes(r["ids"]))
                total += len(p)
        start, count = np.zeros(total, np.int64), np.zeros(total, np.int64)
        own_ids = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        if total:
            where, sizes = np.concatenate(place), np.concatenate(size).astype(np.int64)
            if where.max() != total - 1:
                raise ValueError("a block's words are not those of its documents: the input changed between two reads")
            start[where] = np.cumsum(sizes) - sizes
            count[where] = sizes
        for batch in right:
            for r in batch.to_pylist():
                spot = _from_planes(r["places"])
                doc_size = unpack(r["sizes"], np.int64)
                if len(spot) and int(spot.max()) >= total:
                    raise ValueError("a block's words are missing: the input changed between two reads")
                n_ids = count[spot]
                out = own_ids[flat(start[spot], n_ids)]
                ends = np.cumsum(np.maximum(doc_size, 0))
                acc = np.concatenate([[0], np.cumsum(n_ids)])
                offsets = np.concatenate([[0], acc[ends]]).astype(np.int32)
                null = doc_size < 0
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(null, False)), pa.array(out, pa.int32()))
                n_tokens = pa.array(np.diff(offsets).astype(np.int32), mask=null)
                doc_ids = pa.ipc.open_stream(zstandard.decompress(r["docs"])).read_all().column(0).combine_chunks()
                yield pa.RecordBatch.from_arrays([doc_ids, lists, n_tokens], names)

    sent = own.mapInArrow(words, WORDS).repartition(n, "bucket").mapInArrow(to_ids, IDS)
    placed = own.mapInArrow(index, DOCS)
    schema = f"`{id_col}` {'bigint' if id_type == pa.int64() else 'string'}, token_ids array<int>, n_tokens int"
    out = sent.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(lambda a, b: _stream(reassemble, a, b), schema)
    return out.withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def _stream(f, a, b):
    """Co-grouped applyInArrow takes iterators or tables, as Spark's version has it."""
    if isinstance(a, pa.Table):
        found = list(f(a.to_batches(), b.to_batches()))
        return pa.Table.from_batches(found)
    return f(a, b)


class Known:
    """Ids of words seen before, in flat arrays."""

    def __init__(self, enc, most: int):
        self.enc, self.most = enc, most
        self._reset()

    def _reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another, number of ids of each piece)."""
        codes, first, _ = distinct(cp, start, end)
        if len(self.place) > self.most:
            self._reset()
        get, encode, found = self.place, self.enc._encode_single_piece, []
        at = np.empty(len(first), np.int64)
        for k, word in enumerate(spelled(cp, start[first], end[first])):
            n = len(get)
            at[k] = own = get.setdefault(word, n)
            if own == n:
                found.append(encode(word))
        if found:
            size = np.fromiter(map(len, found), np.int32, len(found))
            self.start = np.concatenate([self.start, np.cumsum(size, dtype=np.int64) - size + len(self.flat)])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))])
        n = self.size[at][codes].astype(np.int64)
        return self.flat[flat(self.start[at][codes], n)], n


def encode_local(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[bytes, int] | None = None, words: int = 1 << 18, packed: bool = False) -> DataFrame:
    """(doc_id, token_ids) in one scan without a shuffle, for operators that need ids as input; a task keeps the ids of
    about ``words`` distinct words. ``packed``: the ids of a document as one binary, little-endian, 4 bytes each."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ranks if ranks is not None else load_ranks())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]):
        known = Known(encoding(table.value), words)
        for batch in source:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                cp, start, end, first = pretokens([t or "" for t in texts[a:b]])
                out, n = known.ids(cp, start, end)
                offsets = np.concatenate([[0], np.cumsum(n)])[first].astype(np.int32)
                null = pa.array([t is None for t in texts[a:b]] + [False]).to_numpy(zero_copy_only=False)
                if packed:
                    lists = pa.Array.from_buffers(pa.binary(), b - a, [pa.array(~null[:-1]).buffers()[1], pa.py_buffer(offsets * 4), pa.py_buffer(out.astype("<i4"))])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=null), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_col, "token_ids"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, token_ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "text", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """The frame with the texts of its token ids."""
    own = ranks if ranks is not None else load_ranks()
    table: list[bytes | None] = [None] * (max(own.values(), default=-1) + 1)
    for token, k in own.items():
        table[k] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def join(ids: pd.Series) -> pd.Series:
        get = shared.value.__getitem__
        rows = []
        for x in ids:
            if x is None:
                rows.append(None)
                continue
            if len(x) and int(np.min(x)) < 0:
                raise ValueError("negative token id")
            rows.append(b"".join(map(get, np.asarray(x).tolist())).decode("utf-8", "replace"))
        return pd.Series(rows, dtype=object)

    return encoded.withColumn(out_col, join(F.col(f"`{ids_col}`")))
