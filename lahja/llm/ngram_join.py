"""N-gram Jaccard join with token-combination prefixes.

Tokens are the distinct word n-grams of a text (lower-cased words; a text of fewer than n words is one gram).
Texts with the same set of grams are one class; the join runs on classes, which are named by a fingerprint of
their set, so that hot copies cost one row. Two classes are near if |x & y| / |x | y| >= threshold.

1. Document frequencies of all grams over all classes: one shuffle on the gram, in packed sorted blocks. Only
   grams of two or more classes go back to their classes; a class keeps them with its full size. Classes whose
   shared grams are too few for the threshold end here, exactly.
2. Prefixes, in the order of frequency. x may miss e = |x| - ceil(t|x|) of its grams; those that nobody shares
   use that allowance up first. Rare grams (frequency <= RARE) are indexed alone. Frequent grams are split by
   hash into token classes, and the two-token combinations of each class are indexed; a class of n frequent
   grams in the prefix then withstands n - 2 misses instead of n - 1, so the prefix is extended until
   rare + sum(n_c - 1) exceeds what may be missed. Two sets within the threshold share a rare gram or a
   combination of their prefixes (pigeonhole), so recall is 1. The number of token classes follows the size
   level (powers of 1/t); a set is indexed under its own level and the next, where sizes within the threshold meet.
   Sets too small for token classes index every gram alone.
3. Every signature that several sets have makes them members of its leader, the lowest of them (an aggregation with
   map-side combine and a merge join, which AQE splits where a signature is hot). The members of a leader meet in one
   cell; more than CHUNK are cut by hash into chunks of which every two meet in a cell. Each set is sent once to each of
   its cells. There the overlaps of all pairs are counted at once, rare grams by their lists of members, frequent ones by
   products of 0/1 matrices, so a group of near copies costs a few matrix products. A pair that shares several leaders is
   counted under the lowest one, which either side's list of leaders tells without another shuffle.

A cell gives only, for each class, the number of rows that it is near to and the lowest class that it is connected with:
what is written is linear in the number of classes however many pairs there are, and no link is lost.

``near_docs``: (id, class_id, n_links), a row for each row. n_links counts the other rows within the threshold, copies
included; class_id is the lowest id of all rows that are connected by links. ``near_pairs``: (id_a, id_b, jaccard),
id_a < id_b: members of a class with its lowest id with 1.0, classes by their lowest ids; ``expand=True`` gives all pairs.

A class is named by 64 bits of its set and told apart by 64 others: where sets that differ have the same name (some in
10**11), those are named by the others. Grams are compared by 64-bit hashes, so a pair of sets is misjudged with a
probability below |x| |y| / 2**63.

Defined results: null texts and texts without words are near nothing: class_id is their own id, n_links 0. Every row is
a document, rows that repeat an id too; a null id is never lowest, so the class of null ids alone is null. In
``near_pairs`` null ids are left out and rows that repeat an id within a class are one. Very long texts and extra columns
are as others. An empty table gives an empty result.
``drop_near`` keeps of each connected group the row of the lowest id (null last); rows equal in id and grams
count as one; columns as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, partitions
from ._text import Words, batches, flat, grams, mix

N, THRESHOLD, RARE = 3, 0.5, 16
BLOCK_CHARS = 4 << 20
#: Classes of a cell's chunk; a cell has two at most.
CHUNK = 512
#: Grams that a task counts at a time, and members from which a gram is counted by matrices.
AT_ONCE, OFTEN = 1 << 21, 24
#: Names that stand for several sets: about one in 10**11 classes.
MAX_CLASHES = 1 << 16
_U = np.uint64


def pack(x: np.ndarray, kind: str) -> bytes:
    """Byte planes, compressed."""
    raw = np.ascontiguousarray(x.astype(kind))
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def sets(texts: list[str | None], n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, gram) distinct and sorted; size, name and second hash of each text's set. ``bits`` of the name are kept (fewer in tests)."""
    doc, g = grams(Words(texts), n)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])) if len(doc) else np.zeros(0, bool)
    doc, g = doc[new], g[new]
    size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(size)

    def named(salt: int) -> np.ndarray:
        acc = np.concatenate([[_U(0)], np.cumsum(mix(g + _U(salt)))])
        return mix(acc[ends] - acc[ends - size] + size.astype(_U))

    return doc, g, size, named(0x632BE59BD9B4E019) >> _U(64 - bits), named(0x8EBC6AF09C88C6E3)


def class_of(text: Column, n: int, bits: int = 64) -> Column:
    """Column struct<fp, check>: null for a text without words."""

    @F.pandas_udf("struct<fp:bigint,check:bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, fps, checks, sizes = texts.tolist(), [], [], []
        for a, b in batches(own):
            _, _, size, fp, check = sets(own[a:b], n, bits)
            fps.append(fp.view(np.int64))
            checks.append(check.view(np.int64))
            sizes.append(size)
        none = np.concatenate(sizes) == 0 if sizes else np.zeros(0, bool)
        out = pd.DataFrame({k: pd.array(np.concatenate(v) if v else np.zeros(0, np.int64), dtype="Int64") for k, v in (("fp", fps), ("check", checks))})
        out[none] = pd.NA
        return out

    return run(text)


BLOCKS = "part int, grams binary, owner binary, fps binary, sizes binary"
SHARED = "part int, source int, fps binary, sizes binary, counts binary, grams binary, dfs binary"
REDUCED = "fp bigint, size int, grams binary, sigs array<bigint>"
LINKS = "fp bigint, root bigint, links bigint"
PAIRS = "a bigint, b bigint, jaccard double"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


def _part(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(n)).astype(np.int64)


def _blocks(n: int, parts: int, block_chars: int, bits: int, clashes: np.ndarray):
    def run(source: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        chars, base = 0, 0

        def flush():
            g, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            fp, size = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            # one copy of each class
            first = np.zeros(len(fp), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            keep = first[owner]
            g, owner = g[keep], owner[keep]
            part = _part(g, parts)
            order = np.lexsort((g, part))
            g, owner = g[order], owner[order]
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[k], edge[k + 1])
                classes, local = np.unique(owner[own], return_inverse=True)
                yield _batch([(k, pack(np.diff(g[own], prepend=_U(0)), "<u8"), pack(local, "<u4"), fp[classes].astype("<u8").tobytes(), pack(size[classes], "<u4"))], BLOCKS)

        for batch in source:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                doc, g, size, fp, check = sets(texts[a:b], n, bits)
                if len(clashes):
                    fp = np.where(np.isin(fp, clashes), check, fp)
                held.append((g, doc + base, fp, size))
                base += b - a
                chars += sum(len(t) for t in texts[a:b] if t)
                if chars >= block_chars:
                    yield from flush()
                    held, chars, base = [], 0, 0
        if held:
            yield from flush()

    return run


def _frequencies(parts: int):
    """Of one partition of the grams: those of two classes or more, by class."""

    def run(source: Iterator[pa.RecordBatch]):
        gs, fs, ss, here = [], [], [], 0
        for batch in source:
            for r in batch.to_pylist():
                here = r["part"]
                local = unpack(r["owner"], "<u4")
                gs.append(np.cumsum(unpack(r["grams"], "<u8")))
                fs.append(np.frombuffer(r["fps"], "<u8")[local])
                ss.append(unpack(r["sizes"], "<u4")[local])
        if not gs:
            return
        g, f, s = np.concatenate(gs), np.concatenate(fs), np.concatenate(ss)
        del gs, fs, ss
        order = np.lexsort((f, g))
        g, f, s = g[order], f[order], s[order]
        new = np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]))
        g, f, s = g[new], f[new], s[new]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        df = np.diff(np.append(begin, len(g)))
        df = np.repeat(df, df)
        keep = df > 1
        # from here on a gram is its number among those of this partition that are shared: half the bytes
        g, f, s, df = (np.cumsum(np.append(True, g[keep][1:] != g[keep][:-1])) - 1 if keep.any() else g[keep]), f[keep], s[keep], df[keep]
        part = _part(f, parts)
        order = np.lexsort((g, f, part))
        g, f, s, df, part = g[order], f[order], s[order], df[order], part[order]
        edge = np.searchsorted(part, np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[k], edge[k + 1])
            at = np.flatnonzero(np.append(True, f[own][1:] != f[own][:-1]))
            yield _batch([(k, here, f[own][at].astype("<u8").tobytes(), pack(s[own][at], "<u4"), pack(np.diff(np.append(at, len(f[own]))), "<u4"), pack(g[own], "<u4"), pack(df[own], "<u4"))], SHARED)

    return run


def level_of(size: int, t: float) -> int:
    return int(math.floor(math.log(size) / math.log(1 / t) + 1e-9)) if t < 1 else size


def token_classes(level: int, t: float) -> int:
    """Classes of the frequent tokens at a level; 0: every token alone."""
    return int(t * (1 / t) ** level / 4) if t < 1 else 0


def signatures(g: np.ndarray, df: np.ndarray, size: int, t: float, rare: int) -> np.ndarray:
    """Of a set's shared grams in order of (df, gram); size counts all its grams."""
    spare = len(g) - math.ceil(t * size - 1e-9)  # shared grams that may be missed
    out = []
    for level in (level_of(size, t), level_of(size, t) + 1):
        m = token_classes(level, t)
        if m == 0:
            out.append(mix(g[: spare + 1] + _U(1)))
            # the other level may use classes: sets of both kinds meet alone or there
            continue
        often = df > rare
        kind = np.where(often, (g % _U(m)).astype(np.int64), -1)
        first = np.zeros(len(g), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        gain = np.cumsum(~(first & often))
        end = int(np.searchsorted(gain, spare + 1)) + 1
        if end > len(g):
            raise AssertionError("prefix cannot be extended")
        own, kind = g[:end], kind[:end]
        out.append(mix(own[kind < 0] + _U(2)))
        own, kind = own[kind >= 0], kind[kind >= 0]
        order = np.lexsort((own, kind))
        own, kind = own[order], kind[order]
        for d in range(1, len(own)):
            same = kind[d:] == kind[:-d]
            if not same.any():
                break
            a, b = own[:-d][same], own[d:][same]
            out.append(mix(mix(a) * _U(3) + b + _U(level)))
    return np.unique(np.concatenate(out))


def _reduce(t: float, rare: int):
    def run(source: Iterator[pa.RecordBatch]):
        parts = []
        for batch in source:
            for r in batch.to_pylist():
                count = unpack(r["counts"], "<u4").astype(np.int64)
                parts.append((np.repeat(np.frombuffer(r["fps"], "<u8"), count), np.repeat(unpack(r["sizes"], "<u4").astype(np.int64), count), unpack(r["grams"], "<u4").astype(_U) + (_U(r["source"]) << _U(32)), unpack(r["dfs"], "<u4").astype(np.int64)))
        if not parts:
            return
        f, s, g, df = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((g, df, f))
        f, s, g, df = f[order], s[order], g[order], df[order]
        begin = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        rows = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(f)]):
            size = int(s[a])
            if b - a < math.ceil(t * size - 1e-9):
                continue
            sigs = signatures(g[a:b], df[a:b], size, t, rare)
            rows.append((int(f[a : a + 1].view(np.int64)[0]), size, np.sort(g[a:b]).astype("<u8").tobytes(), sigs.view(np.int64)))
            if len(rows) == 256:
                yield _batch(rows, REDUCED)
                rows = []
        if rows:
            yield _batch(rows, REDUCED)

    return run


def _chunk_of(fp: Column, k: Column) -> Column:
    return F.pmod(F.xxhash64(fp), k)


SENT = ["cell", "leader", "side", "fp", "size", "weight", "grams", "leaders"]


class Cells:
    """Sets of several cells; counts the overlaps of all pairs within a cell."""

    def __init__(self, rows: list[tuple], t: float):
        self.t = t
        cell, leader, side, fp, size, weight, grams, leaders = zip(*rows)
        cell = np.array(cell, np.int64)
        self.cell = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
        self.side, self.fp = np.array(side, np.int8), np.array(fp, np.int64)
        self.size, self.weight = np.array(size, np.int64), np.array(weight, np.int64)
        own = [np.frombuffer(g, "<u8") for g in grams]
        self.gram = np.concatenate(own), np.repeat(np.arange(len(own)), [len(g) for g in own])
        # the leaders lower than the cell's: a pair that shares one of them is counted there
        lower = [[x for x in xs if x < y] for xs, y in zip(leaders, leader)]
        self.lower = np.array([x for xs in lower for x in xs], np.int64).view(_U), np.repeat(np.arange(len(lower)), [len(x) for x in lower])

    def _pairs(self, item: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, items shared) of the rows of one cell that share an item; a pair is a * rows + b, a < b."""
        n = len(self.fp)
        order = np.lexsort((owner, item, self.cell[owner]))
        item, owner = item[order], owner[order]
        new = np.append(True, (item[1:] != item[:-1]) | (self.cell[owner[1:]] != self.cell[owner[:-1]])) if len(item) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(item)))
        found = []
        # frequent items: products of 0/1 matrices, a cell at a time
        often = np.flatnonzero(count >= OFTEN)
        for c in np.unique(self.cell[owner[first[often]]]).tolist():
            lo, hi = np.searchsorted(self.cell, [c, c + 1])
            lists, total = often[self.cell[owner[first[often]]] == c], np.zeros((hi - lo, hi - lo), np.float32)
            for k in range(0, len(lists), 1024):
                some = lists[k : k + 1024]
                own = flat(first[some], count[some])
                m = np.zeros((hi - lo, len(some)), np.float32)
                m[owner[own] - lo, np.repeat(np.arange(len(some)), count[some])] = 1
                total += m @ m.T
            a, b = np.nonzero(np.triu(total, 1))
            found.append(((a + lo) * n + b + lo, total[a, b].astype(np.int64)))
        # others: every two members of a list
        rare = np.flatnonzero((count > 1) & (count < OFTEN))
        for d in range(1, OFTEN - 1):
            rare = rare[count[rare] > d]
            if not len(rare):
                break
            own = flat(first[rare], count[rare] - d)
            a, b = owner[own], owner[own + d]
            lo, hi = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
            ok = lo >= self.t * hi - 1e-9
            found.append(np.unique(a[ok] * n + b[ok], return_counts=True))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, inverse = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        return pair, np.bincount(inverse, weights=np.concatenate([k for _, k in found]), minlength=len(pair)).astype(np.int64)

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, jaccard) of the near pairs that count here, by row."""
        n = len(self.fp)
        pair, both = self._pairs(*self.gram)
        a, b = pair // n, pair % n
        j = both / (self.size[a] + self.size[b] - both)
        ok = (j >= self.t) & ((self.side[a] < 0) | (self.side[a] != self.side[b]))
        if ok.any() and len(self.lower[0]):
            ok &= ~np.isin(pair, self._pairs(*self.lower)[0])
        return a[ok], b[ok], j[ok]

    def links(self) -> pa.RecordBatch:
        a, b, _ = self.near()
        root, before = np.arange(len(self.fp)), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
        links = np.bincount(a, weights=self.weight[b], minlength=len(root)) + np.bincount(b, weights=self.weight[a], minlength=len(root))
        own = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.fp[own]), pa.array(self.fp[root[own]]), pa.array(links[own].astype(np.int64))], ["fp", "root", "links"])

    def pairs(self) -> pa.RecordBatch:
        a, b, j = self.near()
        x, y = self.fp[a], self.fp[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(j)], ["a", "b", "jaccard"])


def _verify(t: float, want: str):
    """Rows come sorted by cell; as many cells as make up AT_ONCE grams are counted together."""

    def run(source: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        begin, grams = 0, 0
        for batch in source:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(SENT)))):
                if held and row[0] != held[-1][0]:
                    if len(held) - begin == 1:  # alone in its cell
                        grams -= len(held.pop()[6]) // 8
                    if grams >= AT_ONCE:
                        yield getattr(Cells(held, t), want)()
                        held, grams = [], 0
                    begin = len(held)
                held.append(row)
                grams += len(row[6]) // 8
        if held:
            yield getattr(Cells(held, t), want)()

    return run


def _clashes(classes: DataFrame) -> np.ndarray:
    rows = classes.where("first <> last").select("fp").limit(MAX_CLASHES + 1).collect()
    if len(rows) > MAX_CLASHES:
        raise ValueError("too many sets share their names")
    return np.array([r["fp"] for r in rows], np.int64).view(_U)


def _named(docs: DataFrame, io: Scratch, keep: list[Column], text_col: str, n: int, bits: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows with ``keep`` and fp; classes of fp, weight and lowest ``id``; names that stood for several sets)."""
    rows = io.write(docs.select(*keep, class_of(F.col(f"`{text_col}`"), n, bits).alias("c")).select("*", "c.*").drop("c"))
    group = lambda df: df.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"), F.min("check").alias("first"), F.max("check").alias("last"))
    classes = io.write(group(rows))
    clashes = _clashes(classes)
    if len(clashes):
        rows = rows.withColumn("fp", F.when(F.col("fp").isin(clashes.view(np.int64).tolist()), F.col("check")).otherwise(F.col("fp")))
        classes = io.write(group(rows))
    return rows.drop("check"), classes.select("fp", "weight", "low"), clashes


def near_classes(docs: DataFrame, io: Scratch, classes: DataFrame, clashes: np.ndarray, text_col: str = "text", n: int = N, threshold: float = THRESHOLD, rare: int = RARE, block_chars: int = BLOCK_CHARS, chunk: int = CHUNK, bits: int = 64, want: str = "links") -> DataFrame:
    """Links (fp, root, links) as each cell counts them, or pairs (a, b, jaccard) of classes."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold is from 0.5 to 1")
    parts = partitions(docs.sparkSession)
    blocks = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_blocks(n, parts, block_chars, bits, clashes), BLOCKS)
    shared = blocks.repartitionById(parts, F.col("part")).mapInArrow(_frequencies(parts), SHARED)
    reduced = io.write(shared.repartitionById(parts, F.col("part")).mapInArrow(_reduce(threshold, rare), REDUCED))
    sigs = reduced.select(F.explode("sigs").alias("sig"), "fp")
    leads = sigs.groupBy("sig").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = io.write(sigs.join(leads.hint("merge"), "sig").select("leader", "fp").distinct())
    big = stars.groupBy("leader").count().where(F.col("count") > chunk).select("leader", F.ceil(F.col("count") / chunk).alias("k"))
    placed = stars.join(big.hint("merge"), "leader", "left").select("fp", F.struct("leader", F.coalesce("k", F.lit(1)).alias("k")).alias("home"))
    homes = placed.groupBy("fp").agg(F.collect_list("home").alias("homes"))
    sets_ = homes.join(reduced.select("fp", "size", "grams").hint("merge"), "fp").join(classes.select("fp", "weight").hint("merge"), "fp")
    each = sets_.select("fp", "size", "weight", "grams", F.col("homes.leader").alias("leaders"), F.inline("homes")).withColumn("own", _chunk_of(F.col("fp"), F.col("k")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sent = each.select(F.xxhash64("leader", low, high).alias("cell"), "leader", F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1).cast("tinyint").alias("side"), "fp", "size", "weight", "grams", "leaders")
    return sent.repartition(parts, "cell").sortWithinPartitions("cell", "leader", "fp").select(*SENT).mapInArrow(_verify(threshold, want), LINKS if want == "links" else PAIRS)


def near_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, rare: int = RARE, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """(id, class_id, n_links), a row for each row."""
    io = Scratch(docs.sparkSession, "ngram")
    rows, classes, clashes = _named(docs, io, [F.col(f"`{id_col}`").alias("id")], text_col, n, bits)
    kept = list(io.tables.values())
    near = io.write(near_classes(docs, io, classes, clashes, text_col, n, threshold, rare, chunk=chunk, bits=bits))
    io.keep(*kept, near)
    roots = components(near.select(F.col("fp").alias("a"), F.col("root").alias("b")), io)
    degree = near.groupBy("fp").agg(F.sum("links").alias("links"))
    # classes that are linked or have copies; the others are their own
    linked = classes.join(degree.hint("merge"), "fp", "left").where("weight > 1 or links is not null").join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
    info = io.write(linked.select("fp", F.coalesce("root", "fp").alias("root"), "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    tops = info.groupBy("root").agg(F.min("low").alias("top"))
    known = info.join(tops.hint("merge"), "root").select("fp", "top", "links")
    out = rows.join(known.hint("merge"), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("top")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, rare: int = RARE, expand: bool = False, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """(id_a, id_b, jaccard)."""
    io = Scratch(docs.sparkSession, "ngram")
    rows, classes, clashes = _named(docs, io, [F.col(f"`{id_col}`").alias("id")], text_col, n, bits)
    near = near_classes(docs, io, classes, clashes, text_col, n, threshold, rare, chunk=chunk, bits=bits, want="pairs")
    members = io.write(rows.where("fp is not null and id is not null").distinct())
    if expand:
        left = members.select(F.col("fp").alias("a"), F.col("id").alias("x"))
        right = members.select(F.col("fp").alias("b"), F.col("id").alias("y"))
        pairs = near.join(left, "a").join(right, "b").select("x", "y", "jaccard").union(left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0)))
    else:
        lowest = members.groupBy("fp").agg(F.min("id").alias("low"))
        star = members.join(lowest, "fp").where("id <> low").select(F.col("low").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("jaccard"))
        left, right = lowest.select(F.col("fp").alias("a"), F.col("low").alias("x")), lowest.select(F.col("fp").alias("b"), F.col("low").alias("y"))
        pairs = star.union(near.join(left, "a").join(right, "b").select("x", "y", "jaccard"))
    # ids that several classes share may repeat a pair
    return pairs.where("x <> y").groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def components(edges: DataFrame, io: Scratch) -> DataFrame:
    """(node, root): the lowest node of each connected group of edges (a, b), by alternating large and small stars."""
    now = io.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # large star: greater neighbours join the lowest
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: lower neighbours and the node itself join the lowest
        large = io.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        after = io.write(small)
        same = after.count() == now.count() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        io.drop(large, now)
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, rare: int = RARE, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """The documents with one of each group; columns as given. Rows whose id is their own are told by it, so texts are not read again;
    only those of null or repeated ids in a group are named by their sets once more."""
    io = Scratch(docs.sparkSession, "near")
    rows, classes, clashes = _named(docs, io, [F.col(f"`{id_col}`").alias("id")], text_col, n, bits)
    kept = list(io.tables.values())
    near = io.write(near_classes(docs, io, classes, clashes, text_col, n, threshold, rare, chunk=chunk, bits=bits))
    io.keep(*kept, near)
    roots = components(near.select(F.col("fp").alias("a"), F.col("root").alias("b")), io)
    members = rows.where("fp is not null").groupBy("fp", "id").agg(F.count(F.lit(1)).alias("rows"))
    rooted = io.write(members.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "id", "rows", F.coalesce("root", "fp").alias("root")))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("fp").alias("fp"))).alias("best"), F.sum("rows").alias("all")).where("all > 1")
    wins = (F.col("fp") == F.col("best.fp")) & F.col("id").eqNullSafe(F.col("best.id"))
    groups = io.write(rooted.join(best.select("root", "best").hint("merge"), "root").select("fp", "id", "rows", wins.alias("wins")).where("not wins or rows > 1"))
    own = F.col(f"`{id_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), own.alias("id"), F.col(f"`{text_col}`").alias("text"))
    touched = groups.where("id is not null").select("id").distinct()
    kept = packed.where("id is not null").join(touched.hint("merge"), "id", "left_anti").select("row")
    twice = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    hard = io.write(touched.join(twice.hint("merge"), "id", "left_semi"))
    nulls = packed.where("id is null")
    again = nulls if hard.isEmpty() else nulls.union(packed.join(hard.hint("merge"), "id", "left_semi").select(*packed.columns))
    fp = class_of(F.col("text"), n, bits).alias("c")
    named = F.when(F.col("c.fp").isin(clashes.view(np.int64).tolist()), F.col("c.check")).otherwise(F.col("c.fp")) if len(clashes) else F.col("c.fp")
    again = again.select("row", "id", fp).select("row", "id", named.alias("fp"))
    if not (hard.isEmpty() and nulls.isEmpty()):
        losers, many = groups.where("not wins").select("fp", "id"), groups.where("wins").select("fp", "id")
        same = lambda x: again.fp.eqNullSafe(x.fp) & again.id.eqNullSafe(x.id)
        once = again.join(many.hint("merge"), same(many), "left_semi").groupBy("fp", "id").agg(F.first("row").alias("row")).select("row")
        both = losers.union(many)
        kept = kept.union(again.join(both.hint("merge"), same(both), "left_anti").select("row")).union(once)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
