"""Samples, splits and caps. Random orders are those of a hash of the key and a seed: the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .classifier import running

MAX_SHARE = 0.5


def hash_order(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_sample(rows: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows (top-k by hash)."""
    return rows.withColumn("__h", hash_order(F.col(key), seed)).orderBy("__h", key).limit(k).drop("__h")


def holdout_split(rows: DataFrame, key: str, holdout: float = 0.25, seed: int = 0, by: str | None = None) -> DataFrame:
    """The rows with ``split``: int(n * (1 - holdout)) rows of each group in hash order train, the others test.

    Ranks are running counts over range partitions, so a group may be of any size."""
    group = F.col(by) if by else F.lit(0)
    own = rows.withColumn("__g", group).withColumn("__h", hash_order(F.col(key), seed)).withColumn("__one", F.lit(1))
    ranked = running(own, ["__g", "__h", key], {"__before": "__one"})
    total = ranked.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__before").alias("__first"))
    out = ranked.join(total, ranked["__g"].eqNullSafe(total["__g"]))
    split = F.when(F.col("__before") - F.col("__first") < F.floor(F.col("__n") * (1 - holdout)), "train").otherwise("test")
    return out.select(*rows.columns, (F.col("__before") - F.col("__first") + 1).alias("rank"), split.alias("split"))


def balance(split: DataFrame, cls: str) -> DataFrame:
    """Train rows of both classes cut to the smaller class, in rank order; test rows stay."""
    least = split.where("split = 'train'").groupBy(cls).count().agg(F.min("count").alias("__k"))
    return split.crossJoin(F.broadcast(least)).where((F.col("split") == "test") | (F.col("rank") <= F.col("__k"))).drop("__k")


def cap_total(counts: dict[str, int], shares: dict[str, float] | None = None) -> int:
    """The largest T of sum(min(n, int(share * T))) = T, by the usual fixed point; counts of a registry's sources."""
    part = {k: (shares or {}).get(k, MAX_SHARE) for k in counts}
    if sum(part.values()) < 1.0:
        raise ValueError(f"the shares add up to {sum(part.values()):.2f}: no class can be filled")
    total = sum(counts.values())
    for _ in range(64):
        after = sum(min(n, int(part[k] * total)) for k, n in counts.items())
        if after == total:
            break
        total = after
    return total


def cap_sources(blocks: DataFrame, source: str, key: str, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """No source has more than its share of the class; what goes is chosen by hash. A single source stays whole."""
    counts = {r[source]: r["count"] for r in blocks.groupBy(source).count().collect()}
    if len(counts) < 2:
        return blocks
    total = cap_total(counts, shares)
    caps = blocks.sparkSession.createDataFrame([(k, int((shares or {}).get(k, MAX_SHARE) * total)) for k in counts], f"`{source}` {blocks.schema[source].dataType.simpleString()}, __cap bigint")
    own = blocks.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__one", F.lit(1))
    ranked = running(own, [source, "__h", key], {"__before": "__one"})
    first = ranked.groupBy(source).agg(F.min("__before").alias("__first"))
    return ranked.join(first, source).join(caps, source).where(F.col("__before") - F.col("__first") < F.col("__cap")).select(*blocks.columns)


def stratified(prompts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n prompts, by script in proportion and one at least; a surplus goes from the end of the largest script."""
    if n <= 0:
        raise ValueError(f"no sample of size {n}")
    sizes = {r["script"]: r["count"] for r in prompts.groupBy("script").count().collect()}
    total = sum(sizes.values())
    if n >= total:
        return prompts
    quota = {s: min(k, max(1, round(n * k / total))) for s, k in sizes.items()}
    order = W.partitionBy("script").orderBy(hash_order(F.col("id"), seed), "id")
    limit = F.create_map(*[F.lit(x) for s, q in quota.items() for x in (s, q)])
    chosen = prompts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit[F.col("script")]).drop("__r")
    surplus = sum(quota.values()) - n
    if surplus <= 0:
        return chosen
    majority = max(sorted(sizes), key=lambda s: sizes[s])
    last = W.partitionBy("script").orderBy(F.desc("id"))
    return chosen.withColumn("__r", F.row_number().over(last)).where((F.col("script") != majority) | (F.col("__r") > surplus)).drop("__r")


def split_by_prompt(rows: DataFrame, prompt: str, words: Column, min_words: int = 20, part: float = 0.25, seed: int = 0) -> DataFrame:
    """The rows long enough, with ``side``: int(prompts * part) whole prompts validate, the others train."""
    own = rows.where(words >= min_words)
    keys = own.select(prompt).distinct()
    ranked = running(keys.withColumn("__h", hash_order(F.col(prompt), seed)).withColumn("__one", F.lit(1)), ["__h", prompt], {"__before": "__one"})
    total = ranked.agg(F.count(F.lit(1)).alias("__n"))
    side = ranked.crossJoin(F.broadcast(total)).select(prompt, F.when(F.col("__before") < F.floor(F.col("__n") * part), "validation").otherwise("train").alias("side"))
    return own.join(side, prompt)


def contamination(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key is also on the held-out side."""
    return rows.join(held.select(key).distinct(), key, "left_semi")
