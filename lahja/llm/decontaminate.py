"""Benchmark decontamination by spaced-seed hashing.

A document leaks a benchmark item if, on one alignment of their words (lower-cased runs of letters and
numbers), at least ``span - subs`` words agree within ``span`` consecutive words. An item of n < SPAN words
has span n and SUBS * n // SPAN substitutions. An item of fewer than LINE_WORDS words, which prose would hold by chance,
is leaked by a line that has its words and no others.

Search: fixed masks, each choosing 6 of 8 or 11 word positions, are hashed at every position of both sides.
The two masks are lossless: however 3 of 16 words are replaced (2 of 15, 1 of 14, 0 of 13), one of them has
a place that misses all replaced words; a test enumerates every case. Shorter items use a contiguous mask that
is lossless by the pigeonhole principle, whole lines a hash of the line.

Plan, the same for benchmarks of any size: documents are scanned once; a bitmap of the benchmark's hashes (16 MB at most, built
in parts) drops the seeds that cannot match. Those left, with the SPAN - 1 words on either side, are joined with the
benchmark's seeds by a merge join on the hash, which AQE splits where it is hot. A stretch that agrees well enough lies within these words
around one of its seeds, so hits are verified on them alone; no text is shuffled and none read again.

Defined results: null or empty texts leak nothing; null items and items without words are leaked by nothing. Rows that repeat an id, and
items that do, are merged in ``leaks`` (the most words that agree); in ``decontaminate`` every row has its own verdict, which its text
decides. Null ids are kept as null. An empty benchmark cleans nothing. Very long texts are searched whole; other columns, whatever
their names, are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, fresh, partitions
from ._text import Words, batches, mix

SPAN, SUBS, LINE_WORDS = 16, 3, 8
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 6, 9, 10))
#: log2 of the bits of the prefilter at most, and of its bits for each seed.
BITMAP, SPARSE = 27, 14
#: Words around a seed's first one, and what stands for those beyond the text.
AROUND = 2 * SPAN - 1
NO_DOC, NO_ITEM = 1, 2


def limits(n_words: int) -> tuple[int, int]:
    """(span, matches needed) for an item of so many words."""
    span = min(SPAN, n_words)
    return span, span - SUBS * span // SPAN


def masks_for(n_words: int) -> tuple[tuple[int, ...], ...]:
    if n_words >= SPAN:
        return MASKS
    return (tuple(range(n_words // (SUBS * n_words // SPAN + 1))),)


ALL_MASKS = sorted({m for n in range(LINE_WORDS, SPAN + 1) for m in masks_for(n)})
LINE = len(ALL_MASKS)  # the number of the whole-line "mask"


def seeds(h: np.ndarray, group: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the mask at every position where it lies within one group."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(n, sum((o + 1) * 131**k for k, o in enumerate(mask)), np.uint64)
    for o in mask:
        acc = acc * np.uint64(0x9FB21C651E98DF25) + h[o : o + n]
    at = np.flatnonzero(group[:n] == group[mask[-1] :])
    return at, mix(acc[at])


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, hash) of the lines of fewer than LINE_WORDS words."""
    line = np.cumsum(words.cp == 10)[words.start] if len(words.start) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(line)))
    first, n = first[n < LINE_WORDS], n[n < LINE_WORDS]
    acc = n.astype(np.uint64)
    for k in range(LINE_WORDS - 1):
        own = n > k
        acc[own] = mix(acc[own] * np.uint64(0x9FB21C651E98DF25) + words.hash[first[own] + k])
    return first, n, acc


def _around(words: Words, at: np.ndarray, nothing: int) -> np.ndarray:
    """[seeds, AROUND] hashes of the words from SPAN - 1 before the seed to as many after it, within its text."""
    spot = at[:, None] + np.arange(1 - SPAN, SPAN)
    lo, hi = words.first[words.doc[at]], words.first[words.doc[at] + 1]
    inside = (spot >= lo[:, None]) & (spot < hi[:, None])
    return np.where(inside, words.hash[np.where(inside, spot, 0)], np.uint64(nothing))


def _of_line(words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    spot = first[:, None] + np.arange(AROUND)
    inside = np.arange(AROUND) < n[:, None]
    return np.where(inside, words.hash[np.where(inside, spot, 0)], np.uint64(NO_ITEM))


SEEDS = "array<struct<hash:bigint,around:binary>>"


def _rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], texts: int, more: list[np.ndarray] | None = None) -> list[list]:
    out: list[list] = [[] for _ in range(texts)]
    for k, (doc, h, around) in enumerate(found):
        body = np.ascontiguousarray(around.astype("<u8"))
        extra = [x.tolist() for x in more[k]] if more else []
        for i, (d, x) in enumerate(zip(doc.tolist(), h.view(np.int64).tolist())):
            out[d].append((x, body[i].tobytes(), *(e[i] for e in extra)))
    return out


def doc_seeds(texts: list[str | None], masks: list[int], bits: np.ndarray, log2: int) -> list[list[tuple[int, bytes]]]:
    """(hash, words around) of the seeds that the bitmap lets through."""
    words, found = Words(texts), []

    def may(h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - log2)
        return np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)

    for k in masks:
        if k == LINE:
            first, n, h = lines(words)
            own = may(h)
            found.append((words.doc[first[own]], h[own], _of_line(words, first[own], n[own])))
        else:
            at, h = seeds(words.hash, words.doc, ALL_MASKS[k])
            own = may(h)
            found.append((words.doc[at[own]], h[own], _around(words, at[own], NO_DOC)))
    return _rows(found, len(texts))


BENCH = "array<struct<hash:bigint,around:binary,mask:int,words:int>>"


def bench_seeds(texts: list[str | None]) -> list[list[tuple[int, bytes, int, int]]]:
    """(hash, words around, mask, words of the item): an item is sought with its own masks only."""
    words = Words(texts)
    n_words = np.diff(words.first)
    found, more = [], []
    for k, m in enumerate(ALL_MASKS):
        at, h = seeds(words.hash, words.doc, m)
        with_it = np.array([n >= LINE_WORDS and m in masks_for(int(n)) for n in n_words], bool)
        own = with_it[words.doc[at]] if len(at) else np.zeros(0, bool)
        at, h = at[own], h[own]
        found.append((words.doc[at], h, _around(words, at, NO_ITEM)))
        more.append([np.full(len(at), k), n_words[words.doc[at]]])
    short = np.flatnonzero((n_words > 0) & (n_words < LINE_WORDS))
    # an item's words are a line, however they were written
    first, n = words.first[short], n_words[short]
    acc = n.astype(np.uint64)
    for k in range(LINE_WORDS - 1):
        own = n > k
        acc[own] = mix(acc[own] * np.uint64(0x9FB21C651E98DF25) + words.hash[first[own] + k])
    found.append((short, acc, _of_line(words, first, n)))
    more.append([np.full(len(short), LINE), n])
    return _rows(found, len(texts), more)


def agreeing(doc: np.ndarray, item: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Most words that agree within the span around a seed, of rows [seeds, AROUND]; 0 if they are too few."""
    same = doc == item
    acc = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, 1)], 1)
    span = np.minimum(n_words, SPAN)
    begin = np.arange(SPAN)
    rows = np.arange(len(same))[:, None]
    most = (acc[rows, begin + span[:, None]] - acc[rows, begin]).max(1, initial=0)
    whole = n_words < LINE_WORDS
    return np.where(whole, np.where(same.all(1), n_words, 0), np.where(most >= span - SUBS * span // SPAN, most, 0))


def _udf(kind: str, f):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        own, rows = texts.tolist(), []
        names = [x.split(":")[0] for x in kind[len("array<struct<") : -2].split(",")]
        for a, b in batches(own):
            rows += [[dict(zip(names, r)) for r in x] for x in f(own[a:b])]
        return pd.Series(rows, dtype=object)

    return run


def _bitmap(items: DataFrame, log2: int) -> np.ndarray:
    """Packed bits of the seeds' slots; segments of 2**16 bits are built by the executors."""
    slots = items.select(F.shiftrightunsigned("hash", 64 - log2).alias("slot")).withColumn("segment", F.shiftright("slot", 16))

    def build(source: Iterator[pa.RecordBatch]):
        own: dict[int, np.ndarray] = {}
        for batch in source:
            slot, segment = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(segment).tolist():
                own.setdefault(s, np.zeros(1 << 16, bool))[slot[segment == s] & 0xFFFF] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in own.values()], pa.binary())], ["segment", "bits"])

    out = np.zeros(max(1 << (log2 - 3), 1 << 13), np.uint8)
    for r in slots.repartition(partitions(items.sparkSession), "segment").mapInArrow(build, "segment bigint, bits binary").toLocalIterator():
        out[r["segment"] << 13 : (r["segment"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hits(docs: DataFrame, bench: DataFrame, key, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(key, item_id, matched) of seeds around which enough words agree. key: a column of docs."""
    spark = docs.sparkSession
    io = Scratch(spark, "leaks")
    read = bench.select(F.col(f"`{item_col}`").alias("item_id"), F.inline(_udf(BENCH, bench_seeds)(F.col(f"`{item_text}`"))))
    items = io.write(read)
    use = {r["mask"]: r["count"] for r in items.groupBy("mask").count().collect()}
    log2 = int(np.clip(np.ceil(np.log2(max(sum(use.values()), 1))) + SPARSE, 16, BITMAP))
    shared = spark.sparkContext.broadcast(_bitmap(items, log2))
    masks = sorted(use)
    search = _udf(SEEDS, lambda texts: doc_seeds(texts, masks, shared.value, log2))
    found = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")).withColumn("seeds", search("text")).where(F.size("seeds") > 0)
    found = found.select("key", F.inline("seeds"))

    @F.pandas_udf("int")
    def verify(doc: pd.Series, item: pd.Series, words: pd.Series) -> pd.Series:
        rows = lambda x: np.frombuffer(b"".join(x.tolist()), "<u8").reshape(-1, AROUND)
        return pd.Series(agreeing(rows(doc), rows(item), words.to_numpy(np.int64)).astype(np.int32))

    both = found.join(items.select("hash", "item_id", F.col("around").alias("item"), "words").hint("merge"), "hash")
    return both.select("key", "item_id", verify("around", "item", "words").alias("matched")).where("matched > 0")


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched): the most words that agree within the span."""
    return _hits(docs, bench, F.col(f"`{id_col}`"), text_col, item_col, item_text).groupBy(F.col("key").alias(id_col), "item_id").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no item; columns as given. Texts are named by SHA-256 for the verdict to find them."""
    name = fresh(docs, "key")
    key = F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)
    bad = _hits(docs, bench, key, text_col, item_col, item_text).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").drop(name)
