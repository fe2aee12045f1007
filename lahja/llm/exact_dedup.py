"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive blocks of bytes (a wide radix digit), most significant first. Each
round groups what is still together by the next block; a document alone in its group is settled, and so
are documents that have all ended, which are then equal. Only the others go on, with the bytes that are
left. The first digit needs 64 bytes of every document; a usual corpus is mostly settled by it, so most
text never moves. Digits grow eightfold, so that rounds grow with the logarithm of the longest text.
Bytes are compared, never digests.

Every round is an aggregation with map-side combine and a join with the groups that are not settled:
a group of a million copies is one row per task, and the join's hot keys are split by AQE. The groups grow
with the corpus, so they are never broadcast: every size runs the same merge joins.

Defined results: a null text equals nothing, itself included. Empty texts are equal. The lowest id stays,
null ids come last; among rows that share both id and text any one stays. An empty table gives an empty
result. Other columns, whatever their names, are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch

#: Bytes of the first digit, and how much longer each next one is.
FIRST_BYTES, GROWTH = 64, 8


def _digit(col, width: int):
    return F.substring(col, 1, width), F.octet_length(col) <= width


def _settle(docs: DataFrame, id_col: str, text_col: str, first_bytes: int, growth: int) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(heads that several rows share, rows under them with a number, removed: row number, id, id kept)."""
    io = Scratch(docs.sparkSession, "exact")
    body = F.col(f"`{text_col}`").cast("binary")
    digit, ended = _digit(body, first_bytes)
    heads = io.write(docs.where(body.isNotNull()).groupBy(digit.alias("digit"), ended.alias("ended")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    at = docs.columns.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    text = F.col(f"row.c{at}").cast("binary")
    digit, ended = _digit(text, first_bytes)
    found = packed.where(text.isNotNull()).withColumns({"digit": digit, "ended": ended}).join(heads.hint("merge"), ["digit", "ended"])
    # written once: the numbers stay what they are when an executor is lost
    together = io.write(found.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "row", "digit", "ended"))
    state = together.select("uid", "id", F.lit(0).cast("bigint").alias("gid"), "digit", "ended", F.substring(text, first_bytes + 1, (1 << 31) - 1).alias("rest"))
    width, done, before = first_bytes, [], None
    while True:
        groups = io.write(state.groupBy("gid", "digit", "ended").agg(F.min("uid").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        table = io.write(state.join(groups.hint("merge"), ["gid", "digit", "ended"]).select("uid", "id", F.col("next").alias("gid"), "ended", F.when(~F.col("ended"), F.col("rest")).alias("rest")))
        io.drop(groups, *([before] if before is not None else []))
        done.append(io.write(table.where("ended").select("uid", "id", "gid")))
        if table.where("not ended").isEmpty():
            io.drop(table)
            break
        width *= growth
        digit, ended = _digit(F.col("rest"), width)
        before = table
        state = table.where("not ended").select("uid", "id", "gid", digit.alias("digit"), ended.alias("ended"), F.substring("rest", width + 1, (1 << 31) - 1).alias("rest"))
    same = done[0]
    for t in done[1:]:
        same = same.union(t)
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))
    best = same.groupBy("gid").agg(F.min(rank).alias("best"))
    removed = io.write(same.join(best.hint("merge"), "gid").where(F.col("uid") != F.col("best.uid")).select("uid", F.col("id").alias("id"), F.col("best.id").alias("keep")))
    return heads, together, removed, io


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """(id, keep_id) of every row that goes: its text is, byte for byte, that of the row kept."""
    _, together, removed, io = _settle(docs.select(f"`{id_col}`", f"`{text_col}`") if id_col != text_col else docs, id_col, text_col, first_bytes, growth)
    return removed.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """The documents without the copies; columns as given."""
    heads, together, removed, _ = _settle(docs, id_col, text_col, first_bytes, growth)
    body = F.col(f"`{text_col}`").cast("binary")
    digit, ended = _digit(body, first_bytes)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.coalesce(digit, F.lit(b"")).alias("digit"), ended.alias("ended"))
    alone = packed.join(heads.hint("merge"), (packed.digit == heads.digit) & (packed.ended == heads.ended), "left_anti").select("row")
    kept = alone.union(together.join(removed.select("uid"), "uid", "left_anti").select("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
