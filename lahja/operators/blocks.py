"""Greedy blocks of lines of about ``target`` words.

A block ends with the line that reaches the target; a rest of at least half the target is a block too. Within a
document this is a fold over its lines. Over the lines of a whole source it is a finite automaton (its state is the
number of words held, 0 to target - 1): every partition of the ordered lines computes in parallel what it makes of each
entering state of its first and last group, the driver composes these tables (two a partition, whatever the number of groups), and a
second pass writes the blocks. Only blocks across partitions are put together by another shuffle. A source may so be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch
from ..functions.normalize import count_words, squeeze
from ..storage import materialize

TARGET = 60
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_ENDS)


def document_blocks(text: Column, target: int = TARGET) -> Column:
    """array<string>: the blocks of one document, as written; words are counted without NFKC. Lines of more than ``target`` words are cut every ``target`` words."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([["\n".join(lines) for lines, _ in batch.block_words(t or "", target)] for t in own], pa.list_(pa.string())) for own in batch.slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(text)


def _table(n: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(words held at the end, blocks ended) for every entering state.

    From each line on at which a block may begin, the next such line follows from running sums; walks that meet go on together."""
    acc = np.concatenate([[0], np.cumsum(n)])
    after = np.minimum(np.searchsorted(acc, acc + target, "left"), len(acc))  # line at which a block that begins at i has ended
    start = np.searchsorted(acc, target - np.arange(target), "left")  # the same for the block that is open on entry
    end, ended = np.empty(target, np.int64), np.zeros(target, np.int64)
    known: dict[int, tuple[int, int]] = {}  # line: (held at the end, blocks ended from there)
    for s in range(target):
        if start[s] >= len(acc):  # no block ends
            end[s] = s + acc[-1]
            continue
        path, at = [], int(start[s])
        while at not in known and after[at] < len(acc):
            path.append(at)
            at = int(after[at])
        held, count = known.setdefault(at, (int(acc[-1] - acc[at]), 0))
        for p in reversed(path):
            count += 1
            known[p] = held, count
        end[s], ended[s] = held, count + 1
    return end, ended


def _runs(column: pa.Array) -> np.ndarray:
    """Begins of the runs of equal values, nulls being equal."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def _edges(target: int):
    """Of each part: its first group and its last one, what they make of every state, and whether they are one."""

    def run(source: Iterator[pa.RecordBatch]):
        held: dict[int, list[pa.RecordBatch]] = {}
        for rows in source:
            parts = rows.column(0).to_numpy()
            for p in np.unique(parts).tolist():
                own = np.flatnonzero(parts == p)
                held.setdefault(p, []).append(rows.slice(int(own[0]), len(own)))
        for p, batches in held.items():
            table = pa.Table.from_batches(batches).combine_chunks()
            group, n = table.column(2).chunk(0), table.column(3).to_numpy()
            begin = _runs(group)
            last = int(begin[-1])
            first_end = int(begin[1]) if len(begin) > 1 else len(n)
            a, b = _table(n[:first_end], target), _table(n[last:], target)
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (*a, *b)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), group.slice(0, 1), group.slice(last, 1), pa.array([len(begin) == 1]), *lists], ["part", "g0", "g1", "one", "end0", "ended0", "end1", "ended1"])

    return run


def _compose(edges: list) -> tuple[dict, dict]:
    """({part: (words held on entry, block on entry)}, {(part, whether of its last group): (words held, block) at the group's end})."""
    entry: dict[int, tuple[int, int]] = {}
    ends: dict[tuple[int, bool], tuple[int, int]] = {}
    open_: list[tuple[int, bool]] = []  # where the running group is seen
    held, block, group = 0, 0, None

    def close() -> None:
        for k in open_:
            ends[k] = held, block
        open_.clear()

    for k, r in enumerate(edges):
        if not (k and r["g0"] == group):
            close()
            held, block = 0, 0
        entry[r["part"]] = held, block
        open_.append((r["part"], False))
        held, block = r["end0"][held], block + r["ended0"][held]
        if not r["one"]:
            close()
            held, block = r["end1"][0], r["ended1"][0]
        open_.append((r["part"], True))
        group = r["g1"]
    close()
    return entry, ends


PIECE = "block bigint, part int, whole boolean, n_lines bigint, n_words bigint"


def _pieces(entry: dict, ends: dict, target: int, names: list[str]):
    """(group, block, part, whole, n_lines, n_words, first, text) of rows (part, pos, group, n, first, text) in order."""

    def run(source: Iterator[pa.RecordBatch]):
        part, group, state = None, None, None  # state: held, block
        texts: list[str] = []
        first, words, held_before, runs, out = None, 0, 0, 0, []

        def emit(ended: bool, over: bool) -> None:
            """The open piece. ended: by reaching the target; over: the group has no more lines here."""
            nonlocal texts, words, held_before
            if not texts:
                return
            last_run = over and last_of_part
            end = ends[part, True] if last_run else ends[part, False] if runs == 1 else state
            goes_on = last_run and not ended and end != tuple(state)
            counts = ended or state[1] < end[1] or end[0] >= target // 2
            if counts:
                out.append((group, state[1], part, not goes_on and not held_before, len(texts), words, first, "\n".join(texts)))
            texts, words, held_before = [], 0, 0

        def flush():
            nonlocal out
            rows, out = out, []
            columns = list(zip(*rows))
            kinds = [group_type, pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), first_type, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        last_of_part = False
        for batch in source:
            group_type, first_type = batch.schema.field(2).type, batch.schema.field(4).type
            parts, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            begins = np.union1d(_runs(batch.column(2)), np.flatnonzero(np.append(True, parts[1:] != parts[:-1])))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(n)]):
                p, g = int(parts[a]), batch.column(2)[a].as_py()
                if p != part or g != group:
                    last_of_part = p != part
                    if state is not None:
                        emit(False, True)
                    runs = 1 if p != part else runs + 1
                    part, group = p, g
                    state = list(entry[p]) if runs == 1 else [0, 0]
                    held_before = state[0]
                acc = np.concatenate([[0], np.cumsum(n[a:b])])
                lines, keys = batch.column(5).slice(a, b - a).to_pylist(), batch.column(4)
                i = 0
                while i < b - a:
                    j = min(int(np.searchsorted(acc, acc[i] + target - state[0], "left")), b - a)
                    if not texts:
                        first = keys[a + i].as_py()
                    texts += lines[i:j]
                    words += int(acc[j] - acc[i])
                    state[0] += int(acc[j] - acc[i])
                    if state[0] >= target:
                        emit(True, False)
                        state = [0, state[1] + 1]
                    i = j
            if out:
                yield flush()
        if state is not None:
            last_of_part = True
            emit(False, True)
        if out:
            yield flush()

    return run


def chunk_lines(lines: DataFrame, group: str, order: list[str], text: str, target: int = TARGET, words: Column | None = None) -> DataFrame:
    """(group, block, n_lines, n_words, first, text): blocks of each group's lines in order; lines without words are skipped.

    A null group is a group; lines that share the order key keep some order among themselves; ``first`` is the order key of a block's first line."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = (words if words is not None else count_words(F.col(text))).cast("bigint")
    # words are counted behind the shuffle, which samples what lies before it; lines are numbered as they are written, so that the
    # order stays what it is, whatever key they share
    own = lines.select("*", F.col(group).alias("__g"), F.struct(*[F.col(c).alias(c) for c in order]).alias("__first")).repartitionByRange(parts, "__g", "__first").sortWithinPartitions("__g", "__first")
    placed = own.select(F.col("__g").alias("g"), F.col("__first").alias("first"), F.col(text).alias("t"), n.alias("n"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    rows = materialize(placed, "lines").where("n > 0")
    kind, key = rows.schema["g"].dataType.simpleString(), rows.schema["first"].dataType.simpleString()
    ordered = lambda df: df.repartition(parts, "part").sortWithinPartitions("part", "pos")
    lists = ", ".join(f"{c} array<bigint>" for c in ("end0", "ended0", "end1", "ended1"))
    edges = ordered(rows.select("part", "pos", "g", "n")).mapInArrow(_edges(target), f"part int, g0 {kind}, g1 {kind}, one boolean, {lists}").collect()
    entry, ends = _compose(sorted(edges, key=lambda r: r["part"]))
    names = [group, "block", "part", "whole", "n_lines", "n_words", "first", "text"]
    schema = f"`{group}` {kind}, {PIECE}, first {key}, text string"
    found = materialize(ordered(rows.select("part", "pos", "g", "n", "first", "t")).mapInArrow(_pieces(entry, ends, target, names), schema), "pieces")
    across = found.where("not whole").groupBy(group, "block").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_words").alias("n_words"), F.min_by("first", "part").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return found.where("whole").select(*across.columns).union(across)


def group_documents(docs: DataFrame, group: str, order: str, text: str, target: int = TARGET) -> DataFrame:
    """(group, block, unit, n_words, text): consecutive fragments as units named first+count, by raw word counts; empty texts are no documents."""
    raw = F.size(F.filter(F.split(squeeze(F.col(text)), " "), lambda w: w != ""))
    units = chunk_lines(docs.where(F.length(text) > 0), group, [order], text, target, raw)
    unit = F.concat(F.col(f"first.{order}").cast("string"), F.lit("+"), F.col("n_lines").cast("string"))
    return units.select(group, "block", unit.alias("unit"), "n_words", "text")
