"""Reports over replies and their verdicts: cells, paired shifts, registers, work lists, abandoned models, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BORDERLINE, ABANDON = 0.02, 3
CELL = ["model", "condition", "script"]


def _failed() -> Column:
    return F.coalesce("error", F.lit("")) != ""


def cells(replies: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """By model, condition and script: calls, errors, unscorable, scored, median, share within BORDERLINE of the threshold, coverage."""
    from ..functions.parsing import position

    calls = replies.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum(_failed().cast("int")).cast("bigint").alias("n_errors"))
    scored = F.col("scorable") & F.col("score").isNotNull()
    s = F.when(scored, F.col("score"))
    own = verdicts.groupBy(*CELL).agg(F.sum((~scored).cast("int")).alias("bad"), F.count(s).alias("good"), F.median(s).alias("m"), F.avg((F.abs(s - threshold) < BORDERLINE).cast("double")).alias("b"))
    out = calls.join(own, CELL, "left")
    good = F.coalesce("good", F.lit(0))
    return out.select(*CELL, "n", "n_errors", F.coalesce("bad", F.lit(0)).alias("n_unscorable"), good.alias("n_scored"), F.round("m", 3).alias("median"), F.round("b", 3).alias("borderline_rate"), F.round(position(F.round("m", 3)), 6).alias("position"), F.round(good / F.col("n"), 6).alias("coverage"))


def paired_shifts(verdicts: DataFrame, order: str | None = None) -> DataFrame:
    """(model, n_pairs, n_up, median_delta, rate_up) over prompts measured under both conditions; of several measures the last counts, in ``order`` or as they come."""
    own = verdicts.withColumn("__at", F.col(order) if order else F.monotonically_increasing_id()).where(F.col("scorable") & F.col("score").isNotNull())
    pick = lambda c: F.max_by(F.when(c, F.col("score")), F.when(c, F.col("__at")))
    by = own.groupBy("model", "prompt_id").agg(pick(F.col("condition") == "implicite").alias("i"), pick(F.col("condition") == "explicite").alias("e"))
    delta = F.col("e") - F.col("i")
    out = by.where("i is not null and e is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum((delta > 0).cast("int")).cast("bigint").alias("n_up"), F.round(F.median(delta), 4).alias("median_delta"))
    return out.withColumn("rate_up", F.round(F.col("n_up") / F.col("n_pairs"), 6))


def by_register(verdicts: DataFrame, prompts: DataFrame) -> DataFrame:
    """(model, condition, category, n, median); prompts that aren't known are left out."""
    own = verdicts.where(F.col("scorable") & F.col("score").isNotNull())
    return own.join(prompts.select(F.col("id").alias("prompt_id"), "category"), "prompt_id").groupBy("model", "condition", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("score"), 3).alias("median"))


def work_list(prompts: DataFrame, models: DataFrame, conditions: list[str], done: DataFrame | None = None) -> DataFrame:
    """(prompt_id, model, condition, script) still to call: every combination that has no reply. An error counts as a reply."""
    spark = prompts.sparkSession
    every = prompts.select(F.col("id").alias("prompt_id"), "script").crossJoin(models.select("model")).crossJoin(spark.createDataFrame([(c,) for c in conditions], "condition string"))
    out = every if done is None else every.join(done.select("prompt_id", "model", "condition").distinct(), ["prompt_id", "model", "condition"], "left_anti")
    return out.select("prompt_id", "model", "condition", "script")


def abandoned(replies: DataFrame, order: str, limit: int = ABANDON) -> DataFrame:
    """(model, calls, succeeded, abandoned, abandoned_at): when the log is replayed, a model is given up at ``limit`` failures without one success before."""
    own = W.partitionBy("model").orderBy(order)
    ok = (~_failed()).cast("int")
    run = replies.withColumn("ok", F.sum(ok).over(own)).withColumn("bad", F.sum(1 - ok).over(own))
    at = F.min(F.when((F.col("ok") == 0) & (F.col("bad") >= limit), F.col(order)))
    return run.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(ok).cast("bigint").alias("succeeded"), at.alias("abandoned_at")).withColumn("abandoned", F.col("abandoned_at").isNotNull())


def score_by_source(scores: DataFrame, threshold: float, limit: int | None = 4000) -> DataFrame:
    """(source, n, median, above_threshold) over the first ``limit`` blocks of each source (the report's own bound; None: all). scores: (source, block, score)."""
    own = scores if limit is None else scores.where(F.col("block") < limit)
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("score"), 4).alias("median"), F.round(F.avg((F.col("score") >= threshold).cast("double")), 4).alias("above_threshold"))


def worst_source(by_source: DataFrame, positive: list[str] | DataFrame, gate: float = 0.9) -> DataFrame:
    """(worst, above_threshold, passes): the positive source that is recognised least. ``positive``: their names, or a frame with a column source."""
    own = by_source.where(F.col("source").isin(*positive)) if isinstance(positive, list) else by_source.join(positive.select("source").distinct(), "source", "left_semi")
    return own.orderBy("above_threshold", "source").limit(1).select(F.col("source").alias("worst"), "above_threshold", (F.col("above_threshold") >= gate).alias("passes"))


def render(view: DataFrame, title: str) -> str:
    """A small view as aligned text, for the command line."""
    names, rows = view.columns, [[("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in view.collect()]
    width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, width)).rstrip()
    return "\n".join([title, line(names), *map(line, rows)])
