"""Line dedup by a segment-partition edit join.

Equal lines are gathered by a 128-bit fingerprint with map-side combine, so that a hot line is one row per task.
Distinct lines are joined within an edit distance that follows the length of the shorter one, one edit for every ``per``
characters and ``tau`` at most (lines of fewer than ``per`` characters so have to be equal). For each distance the line that is indexed is
split into one more even segments, of which an edit script leaves one whole (pigeonhole), so a partner holds it
as a substring. The substrings that a partner of each length has to probe are chosen by position: segment i may
have moved by no more than i edits to its left and tau - i to its right. Keys name length, segment number and
substring and travel in packed sorted parts, by hash; the pairs found are verified with a banded bit-parallel edit
distance, a word operation for each column, all pairs of a batch at once, after common ends are cut off.
Recall is 1: every row is a query and nothing is capped. All sides of the joins grow with the corpus, so they are merge joins at
every size.

A line is removed if an earlier line is equal to it or within their distance; it names the earliest such line. Lines are ordered by (document id, line number), null ids last.

Defined results: lines end at "\\n"; a line of white space only is never removed; a null text has no lines.
Lines that repeat within a document count. In ``near_lines`` documents that share an id are told apart by
nothing, so equal lines at the same place of such documents are one. Chains are followed one step: a line may name one that is
removed itself. ``dedup_lines`` tells all rows apart; a text of which all lines go is empty. An empty table gives an
empty result; other columns, whatever their names, are carried as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, partitions
from ._text import CHUNK_CHARS, batches, codes, mix
from .ngram_join import _batch, pack, unpack

TAU, PER = 2, 12
_U = np.uint64
PACKED = "part int, keys binary, owners binary, sides binary"


def segments(n: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) [lines, tau + 1] of the segments of lines of n characters; the last ones take the remainder."""
    base, more = n // (tau + 1), n % (tau + 1)
    i = np.arange(tau + 1)
    size = base[:, None] + (i >= tau + 1 - more[:, None])
    return np.cumsum(size, 1) - size, size


_P = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _P, _U), np.full(size, pow(_P, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _spans(cp: np.ndarray):
    """Hash function of spans of cp by one running sum of a polynomial. Equal spans have equal hashes; others that meet cost a verification."""
    up, down = _powers(CHUNK_CHARS + 1 if len(cp) <= CHUNK_CHARS else len(cp) + 1)
    acc = np.zeros(len(cp) + 1, _U)
    np.cumsum((cp.astype(_U) + _U(1)) * up[: len(cp)], out=acc[1:])
    return lambda s, e: mix((acc[e] - acc[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))


def allowed(n: np.ndarray, tau: int, per: int) -> np.ndarray:
    """Edits allowed where the shorter line has n characters."""
    return np.minimum(n // per, tau)


def keys_of(lines: list[str], tau: int, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, whether it probes) of the lines that may differ from others."""
    cp = codes("".join(lines))
    n = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(n) - n
    h = _spans(cp)
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for edits in range(1, tau + 1):
        for delta in range(edits + 1):
            own = np.flatnonzero(allowed(n - delta, tau, per) == edits)
            size_of = n[own] - delta  # of the line that is indexed
            start, size = segments(size_of, edits)
            for i in range(edits + 1):
                name = (size_of * (tau + 1) + i).astype(_U) * _U(0x9FB21C651E98DF25)
                if delta == 0:
                    s = begin[own] + start[:, i]
                    out.append((mix(h(s, s + size[:, i]) + name), own, False))
                for shift in range(max(-i, delta - (edits - i)), min(i, delta + edits - i) + 1):
                    p = start[:, i] + shift
                    ok = (p >= 0) & (p + size[:, i] <= n[own])
                    s = (begin[own] + p)[ok]
                    out.append((mix(h(s, s + size[ok, i]) + name[ok]), own[ok], True))
    return np.concatenate([k for k, _, _ in out]), np.concatenate([o for _, o, _ in out]), np.concatenate([np.full(len(o), s) for _, o, s in out])


def _keys(tau: int, per: int, parts: int):
    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            uid, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in batches(lines, CHUNK_CHARS):
                key, owner, side = keys_of(lines[a:b], tau, per)
                part = ((key >> _U(32)) % _U(parts)).astype(np.int64)
                order = np.lexsort((key, part))
                key, owner, side = key[order], owner[order], side[order]
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    own = slice(edge[k], edge[k + 1])
                    base = uid[a]  # numbers of a batch lie close together
                    rows.append((k, pack(np.diff(key[own], prepend=_U(0)), "<u8"), np.int64(base).tobytes() + pack(uid[a + owner[own]] - base, "<i8"), pack(side[own], "<u1")))
                yield _batch(rows, PACKED)

    return run


def _matches(source: Iterator[pa.RecordBatch]):
    """Pairs of lines that meet at a key, each once or so in a partition."""
    keys, owners, sides = [], [], []
    for batch in source:
        for r in batch.to_pylist():
            keys.append(np.cumsum(unpack(r["keys"], "<u8")))
            owners.append(unpack(r["owners"][8:], "<i8") + np.frombuffer(r["owners"][:8], "<i8")[0])
            sides.append(unpack(r["sides"], "<u1"))
    if not keys:
        return
    key, owner, side = np.concatenate(keys), np.concatenate(owners), np.concatenate(sides)
    del keys, owners, sides
    order = np.lexsort((owner, side, key))
    key, owner, side = key[order], owner[order], side[order]
    names, local = np.unique(owner, return_inverse=True)
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    group = np.cumsum(new) - 1
    indexed = np.bincount(group, weights=side == 0, minlength=len(first)).astype(np.int64)
    # every probe of a group meets its indexed lines, which come first
    probe = np.flatnonzero((side == 1) & (indexed[group] > 0) & (count[group] > 1))
    at, found, held = probe, [], 0
    for d in range(int(indexed.max(initial=0))):
        at = at[indexed[group[at]] > d]
        if not len(at):
            break
        a, b = local[first[group[at]] + d], local[at]
        ok = a != b
        a, b = a[ok], b[ok]
        found.append(np.unique((np.minimum(a, b).astype(_U) << _U(32)) | np.maximum(a, b).astype(_U)))
        held += len(found[-1])
        if held > 1 << 22:
            yield _pairs(names, np.unique(np.concatenate(found)))
            found, held = [], 0
    if held:
        yield _pairs(names, np.unique(np.concatenate(found)))


def _pairs(names: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[(pair >> _U(32)).astype(np.int64)]), pa.array(names[(pair & _U(0xFFFFFFFF)).astype(np.int64)])], ["a", "b"])


def distances(xs: list[str], ys: list[str], tau: int) -> np.ndarray:
    """Edit distance of each pair; tau + 1 if it is more."""
    out = np.full(len(xs), tau + 1, np.int64)
    rest: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, (x, y) in enumerate(zip(xs, ys)):
        p, t = (codes(x), codes(y)) if len(x) >= len(y) else (codes(y), codes(x))
        if len(p) - len(t) > tau:
            continue
        n = len(t)
        apart = np.flatnonzero(p[:n] != t)
        head = int(apart[0]) if len(apart) else n
        p, t = p[head:], t[head:]
        n = len(t)
        apart = np.flatnonzero(p[len(p) - n :][::-1] != t[::-1])
        tail = int(apart[0]) if len(apart) else n
        p, t = p[: len(p) - tail], t[: n - tail]
        if not len(t):
            out[k] = len(p)
        elif len(p) < tau:
            out[k] = _plain(p.tolist(), t.tolist())
        else:
            rest.append((k, p, t))
    rest.sort(key=lambda r: len(r[2]))
    a = 0
    while a < len(rest):
        b, width = a, 0
        while b < len(rest) and (b - a) * (width := len(rest[b][2])) < 1 << 20:
            b += 1
        b = max(b, a + 1)
        out[[k for k, _, _ in rest[a:b]]] = _banded([p for _, p, _ in rest[a:b]], [t for _, _, t in rest[a:b]], tau)
        a = b
    return out


def _plain(p: list[int], t: list[int]) -> int:
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _banded(ps: list[np.ndarray], ts: list[np.ndarray], tau: int) -> np.ndarray:
    """Banded bit-parallel distance of patterns (tau or longer) and texts (no longer than them by more than tau less).

    Bit b of column j is row j - tau + b. The distance runs along the band's lower edge to the last row, then along that.
    """
    m, n = np.array([len(p) for p in ps]), np.array([len(t) for t in ts])
    width = int(n.max())
    pattern = np.full((len(ps), max(width, int(m.max())) + 3 * tau + 1), 0xFFFFFFFF, np.uint32)
    text = np.full((len(ts), width), 0xFFFFFFFE, np.uint32)
    for k, (p, t) in enumerate(zip(ps, ts)):
        pattern[k, tau : tau + len(p)] = p
        text[k, : len(t)] = t
    bits, one = _U((1 << (2 * tau + 1)) - 1), _U(1)
    vp = np.full(len(ps), ((1 << (tau + 1)) - 1) << tau, _U)
    vn = np.zeros(len(ps), _U)
    dist = np.full(len(ps), tau, np.int64)
    for j in range(1, width + 1):
        pm = np.zeros(len(ps), _U)
        for b in range(2 * tau + 1):
            pm |= (pattern[:, j - 1 + b] == text[:, j - 1]).astype(_U) << _U(b)
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & bits
        hp = (vn | ~(d0 | vp)) & bits
        hn = d0 & vp
        live, edge = j <= n, j + tau <= m
        dist += np.where(live & edge, 1 - ((d0 >> _U(2 * tau)) & one).astype(np.int64), 0)
        row = np.clip(m - j + tau, 0, 63).astype(_U)
        dist += np.where(live & ~edge, ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64), 0)
        vp = (hn | ~((d0 >> one) | hp)) & bits
        vn = (d0 >> one) & hp
    return np.minimum(dist, tau + 1)


def _instances(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    lines = docs.select(key.alias("k"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("no", "line")).where("line rlike '\\\\S'")
    return lines.select(F.struct("k", "no").alias("at"), "line", F.unhex(F.md5("line")).alias("fp"))


def _removed(docs: DataFrame, key: Column, text_col: str, tau: int, per: int, io: Scratch) -> DataFrame:
    """(at, keep, distance) of every line that goes; at and keep are (k, no)."""
    if tau < 1 or per < 5:
        raise ValueError("tau is 1 or more, and an edit needs 5 characters or more")
    parts = partitions(docs.sparkSession)
    own = _instances(docs, key, text_col)
    lines = own.groupBy("fp").agg(F.min("at").alias("first"), F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    # written once: the numbers stay what they are when an executor is lost
    lines = io.write(lines.withColumn("uid", F.monotonically_increasing_id()))
    packed = lines.select("uid", "line").where(F.length("line") >= per).mapInArrow(_keys(tau, per, parts), PACKED)
    pairs = io.write(packed.repartitionById(parts, F.col("part")).mapInArrow(_matches, "a bigint, b bigint").distinct())
    wanted = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    texts = io.write(lines.select("uid", "line", "first").join(wanted.hint("merge"), "uid"))

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances(x.tolist(), y.tolist(), tau).astype(np.int32))

    x, y = (texts.select(F.col("uid").alias(c), F.col("line").alias(f"l{c}"), F.col("first").alias(f"f{c}")) for c in "ab")
    near = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").withColumn("distance", distance("la", "lb")).where(F.col("distance") <= F.least(F.lit(tau), F.floor(F.least(F.length("la"), F.length("lb")) / per)))
    late = F.col("fa") > F.col("fb")
    best = near.select(F.when(late, F.col("a")).otherwise(F.col("b")).alias("uid"), F.struct(F.least("fa", "fb").alias("first"), "distance").alias("near")).groupBy("uid").agg(F.min("near").alias("near"))
    goal = lines.select("fp", "first", "n", "uid").join(io.write(best).hint("merge"), "uid", "left").where("n > 1 or near is not null")
    goal = goal.select("fp", F.coalesce("near.first", "first").alias("keep"), F.coalesce("near.distance", F.lit(0)).alias("distance"))
    return own.select("fp", "at").join(goal.hint("merge"), "fp").where("at <> keep").select("at", "keep", "distance")


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, per: int = PER) -> DataFrame:
    """(doc_id, line_no, keep_id, keep_line_no, distance) of every line that goes."""
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("last"), F.col(f"`{id_col}`").alias("id"))
    out = _removed(docs, key, text_col, tau, per, Scratch(docs.sparkSession, "lines"))
    return out.select(F.col("at.k.id").alias(id_col), F.col("at.no").alias("line_no"), F.col("keep.k.id").alias("keep_id"), F.col("keep.no").alias("keep_line_no"), "distance")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, per: int = PER) -> DataFrame:
    """The documents without the lines that go; columns as given."""
    io = Scratch(docs.sparkSession, "lines")
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    rows = io.write(packed.withColumn("uid", F.monotonically_increasing_id()))
    id_, text = f"row.c{docs.columns.index(id_col)}", f"row.c{docs.columns.index(text_col)}"
    own = rows.select("uid", F.col(id_).alias("id"), F.col(text).alias("text"))
    out = _removed(own, F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("uid")), "text", tau, per, io)
    gone = out.groupBy(F.col("at.k.uid").alias("uid")).agg(F.collect_set("at.no").alias("gone"))
    both = rows.join(gone, "uid", "left").withColumn("lines", F.split(F.col(text), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return both.select(*[(kept if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
