"""Token ids as canonical length-limited Huffman codes.

Counts of all ids of the table are one aggregation; their number is that of the vocabulary, whatever the corpus. The
driver turns them into code lengths by package-merge (no code is longer than MAX_BITS) and broadcasts the lengths;
codes are canonical, ascending by (length, id), so the lengths are the whole dictionary.

A document is written in independent blocks of BLOCK_TOKENS ids. A block's payload begins at a byte, and the bit
offset of every STRIDE-th id is kept, so that any stretch is decoded without what precedes it. Decoding looks a
MAX_BITS window up in one table that gives id and length; the stretches of a batch advance together.

Encoding and decoding are scans without a shuffle; the count is a map-side combined aggregation.

Defined results: a null list has one row with null payload, an empty one a row with no ids; null elements fail.
Rows that repeat stay; null document ids are kept. Ids without a count can't be encoded (the counts of the table
itself have them all). A single id has a one-bit code. An empty table gives an empty code and no rows. Other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

MAX_BITS, BLOCK_TOKENS, STRIDE = 20, 1 << 16, 128
#: Ids that are decoded together.
BATCH_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code by package-merge; counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = np.asarray(counts, np.float64)[order]
    # at each level the leaves and the pairs of the level below, by weight; is_leaf says which
    levels, below = [], np.zeros(0)
    for _ in range(limit):
        weight = np.concatenate([leaf, below])
        rank = np.argsort(weight, kind="stable")
        levels.append(rank < n)
        merged = weight[rank]
        below = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1  # the lightest leaves, which come first
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical code: ascending ids, the length of each."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        self.bits = int(self.lengths.max(initial=1))
        self._tables = self._direct = None

    def __getstate__(self):
        return self.ids, self.lengths, self.bits

    def __setstate__(self, state):
        self.ids, self.lengths, self.bits = state
        self._tables = self._direct = None

    @classmethod
    def of(cls, counts: dict[int, int], limit: int = MAX_BITS) -> Code:
        ids = np.array(sorted(k for k, v in counts.items() if v > 0), np.int64)
        return cls(ids, code_lengths(np.array([counts[i] for i in ids.tolist()], np.float64), limit))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each place in ids, place by window, length by window)."""
        if self._tables is None:
            order = np.lexsort((self.ids, self.lengths))
            span = 1 << (self.bits - self.lengths[order])
            first = np.cumsum(span) - span
            codes = np.empty(len(order), np.uint64)
            codes[order] = (first >> (self.bits - self.lengths[order])).astype(np.uint64)
            place = np.full(1 << self.bits, -1, np.int32)
            place[: int(span.sum())] = np.repeat(order, span)
            size = np.zeros(1 << self.bits, np.uint8)
            size[: int(span.sum())] = np.repeat(self.lengths[order], span)
            self._tables = codes, place, size
        return self._tables

    def _places(self, ids: np.ndarray) -> np.ndarray:
        """Index of each id in self.ids; from a table, if ids are small."""
        if self._direct is None and len(self.ids) and self.ids[0] >= 0 and self.ids[-1] < 1 << 22:
            self._direct = np.full(int(self.ids[-1]) + 1, -1, np.int32)
            self._direct[self.ids] = np.arange(len(self.ids))
        if not len(ids):
            return np.zeros(0, np.int64)
        if self._direct is not None:
            inside = ids.min() >= 0 and ids.max() < len(self._direct)
            at = self._direct[ids] if inside else np.array([-1])
            if at.min() >= 0:
                return at
        else:
            at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
            if len(self.ids) and (self.ids[at] == ids).all():
                return at
        raise ValueError("an id has no code")

    def encode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(payloads, bits of each, bit offset of every id in its block) of blocks ids[cuts[i]:cuts[i + 1]]."""
        codes = self.tables()[0]
        at = self._places(ids)
        size = self.lengths[at] if len(ids) else np.zeros(0, np.int64)
        end = np.concatenate([[0], np.cumsum(size)])
        n_bits = end[cuts[1:]] - end[cuts[:-1]]
        room = -(-n_bits // 32)  # whole words, so that blocks don't meet
        word = np.cumsum(room) - room
        block = np.repeat(np.arange(len(n_bits)), np.diff(cuts))
        offset = end[:-1] - end[cuts[:-1]][block]
        spot = offset + 32 * word[block]
        shift = (64 - (spot & 31) - size).astype(np.uint64)
        value = codes[at] << shift if len(ids) else np.zeros(0, np.uint64)
        total = int(room.sum()) + 1
        words = np.bincount(spot >> 5, (value >> np.uint64(32)).astype(np.float64), total) + np.bincount((spot >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total + 1)[:total]
        body = words.astype(">u4").tobytes()
        return [body[4 * w : 4 * w + -(-b // 8)] for w, b in zip(word.tolist(), n_bits.tolist())], n_bits, offset

    def decode(self, payloads: list[bytes], counts: np.ndarray, checkpoints: np.ndarray, stride: int) -> np.ndarray:
        """Ids of all blocks, one after another; checkpoints likewise, each from its block's first bit."""
        _, place, size = self.tables()
        total = int(counts.sum())
        if not total:
            return np.zeros(0, np.int64)
        body = np.frombuffer(b"".join(payloads) + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (body[:-3] << np.uint32(24)) | (body[1:-2] << np.uint32(16)) | (body[2:-1] << np.uint32(8)) | body[3:]
        begin = np.cumsum([0] + [len(p) for p in payloads[:-1]])
        stretches = -(-counts // stride)
        pos = np.repeat(8 * np.asarray(begin, np.int64), stretches) + np.asarray(checkpoints, np.int64)
        which = np.repeat(np.arange(len(counts)), stretches)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * stride
        left = np.minimum(stride, counts[which] - step)
        out = np.empty(total, np.int32)
        to = np.cumsum(left) - left
        drop, live = np.uint32(32 - self.bits), np.argsort(-left, kind="stable")
        left, pos, to = left[live], pos[live], to[live]
        for k in range(int(left[0])):
            if left[len(pos) - 1] <= k:
                n = int(np.searchsorted(-left[: len(pos)], -k, "left"))
                pos, to = pos[:n], to[:n]
            found = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> drop
            out[to + k] = place[found]
            pos = pos + size[found]
        if (out < 0).any():
            raise ValueError("bits that are no code")
        return self.ids[out]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rows, number of ids of each, whether it is null) of lists or of packed binaries."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_binary(column.type):
        size = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        flat = np.frombuffer(body, "<i4", (int(offsets[-1]) - int(offsets[0])) // 4, int(offsets[0])) if body is not None and len(column) else np.zeros(0, np.int32)
        return flat, size, null
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null token id")
    return flat.to_numpy(zero_copy_only=False), np.where(null, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64), null


def count_ids(df: DataFrame, ids_col: str = "token_ids") -> dict[int, int]:
    """How often each id occurs in the whole table; ids as lists, or packed as ``bpe.encode_local`` does."""

    def run(source: Iterator[pa.RecordBatch]):
        total = np.zeros(0, np.int64)
        rest: dict[int, int] = {}
        for batch in source:
            ids, _, _ = _lists(batch.column(0))
            if not len(ids):
                continue
            if ids.min() >= 0 and ids.max() < 1 << 20:
                own = np.bincount(ids)
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
            else:
                for i, n in zip(*(x.tolist() for x in np.unique(ids, return_counts=True))):
                    rest[i] = rest.get(i, 0) + n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), *rest], pa.int64()), pa.array([*total[some].tolist(), *rest.values()], pa.int64())], ["id", "n"])

    own = df.select(F.col(f"`{ids_col}`").alias("ids")).where("ids is not null").mapInArrow(run, "id bigint, n bigint")
    return {r["id"]: r["n"] for r in own.groupBy("id").agg(F.sum("n").alias("n")).collect()}


BLOCK = "block int, n_tokens int, n_bits bigint, payload binary, checkpoints array<int>"


def encode(df: DataFrame, code: Code, id_col: str = "doc_id", ids_col: str = "token_ids", block_tokens: int = BLOCK_TOKENS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, block, n_tokens, n_bits, payload, checkpoints), a row for each block."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(code)

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            ids, size, null = _lists(batch.column(1))
            blocks = np.maximum(-(-size // block_tokens), 1)
            doc = np.repeat(np.arange(len(size)), blocks)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            n = np.minimum(block_tokens, size[doc] - number * block_tokens)
            lo = 0
            for a, b in _runs(n):
                cuts = np.concatenate([[0], np.cumsum(n[a:b])])
                payloads, n_bits, offset = shared.value.encode(ids[lo : lo + int(cuts[-1])], cuts)
                lo += int(cuts[-1])
                # places of the checkpoints: every stride-th id of each block
                marks = -(-n[a:b] // stride)
                spot = np.repeat(cuts[:-1], marks) + (np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)) * stride
                mask = null[doc[a:b]]
                ends = np.concatenate([[0], np.cumsum(marks)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc[a:b])), pa.array(number[a:b].astype(np.int32)), pa.array(n[a:b].astype(np.int32), mask=mask), pa.array(n_bits, pa.int64(), mask=mask),
                    pa.array([None if m else p for p, m in zip(payloads, mask)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(mask, False)), pa.array(offset[spot].astype(np.int32))),
                ], [id_col, "block", "n_tokens", "n_bits", "payload", "checkpoints"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, {BLOCK}")


def _runs(n: np.ndarray):
    """(first, stop) of runs that hold about BATCH_TOKENS."""
    acc, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(acc, (acc[a - 1] if a else 0) + BATCH_TOKENS, "right")))
        yield a, b
        a = b


def decode(blocks: DataFrame, code: Code, out_col: str = "token_ids", stride: int = STRIDE) -> DataFrame:
    """The blocks with the ids that they hold."""
    shared = blocks.sparkSession.sparkContext.broadcast(code)
    names = [*blocks.columns, out_col]
    at = [blocks.columns.index(c) for c in ("n_tokens", "payload", "checkpoints")]

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            n = batch.column(at[0]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _runs(n):
                own = batch.slice(a, b - a)
                null = own.column(at[1]).is_null().to_numpy(zero_copy_only=False)
                marks = own.column(at[2]).flatten().to_numpy(zero_copy_only=False)
                ids = shared.value.decode([p or b"" for p in own.column(at[1]).to_pylist()], n[a:b], marks, stride)
                ends = np.concatenate([[0], np.cumsum(n[a:b])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(null, False)), pa.array(ids.astype(np.int32)))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{schema}, `{out_col}` array<int>")
