"""Reply verdicts and document triage: prepared text, blocks, scores, medians, positions on the human scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch, markers
from ..functions.normalize import FOLD_FROM, FOLD_TO, fold_for_arabizi, normalize, script_ratio, words_of
from ..functions.parsing import position, zone
from ..functions.translit import prepare
from .blocks import TARGET
from .classifier import SCALE, Model, predict, raw_score
from .segments import profile

MIN_MARKERS, LONG_TEXT = 1, 150


class Scorer:
    """The main model, and optionally one for transliterated text (which it wants folded)."""

    def __init__(self, model: Model, arabizi: Model | None = None):
        self.model, self.arabizi = model, arabizi

    def scored(self, texts: DataFrame, text: str, transliterated: str) -> DataFrame:
        """The rows with ``score`` and ``threshold``, within the scan."""
        spark, flag = texts.sparkSession, F.col(transliterated)

        def of(m: Model, t: Column) -> Column:
            return m.score(raw_score(normalize(t), m.index(), spark))

        if self.arabizi is None:
            return texts.withColumns({"score": of(self.model, F.col(text)), "threshold": F.lit(self.model.threshold)})
        main, other = F.when(~flag, F.col(text)), F.when(flag, fold_for_arabizi(F.col(text)))
        both = texts.withColumns({"__main": of(self.model, main), "__other": of(self.arabizi, other)})
        return both.withColumns({"score": F.when(flag, F.col("__other")).otherwise(F.col("__main")), "threshold": self.pick(flag, lambda m: m.threshold)}).drop("__main", "__other")

    def blocks(self, spark: SparkSession, text: Column, transliterated: Column, target: int = TARGET) -> Column:
        """struct<n_words, n_normal, n_blocks, n_markers, median, up, scores>: a document's words as written and in normal form, its blocks,
        the markers that decide, and the blocks' scores with their median and the share that reaches the threshold; within the row."""
        models = [m and (m.index(), m.lo, m.hi, m.threshold) for m in (self.model, self.arabizi)]
        shared = spark.sparkContext.broadcast(models)
        decides = np.array([n in markers.DISCRIMINANT for n in markers.MARKERS])
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.float64())]
        fold = str.maketrans(FOLD_FROM, FOLD_TO)

        def scores(m: tuple, texts: list[str]) -> list[float]:
            index, lo, hi, _ = m
            if hi <= lo:
                return [0.0] * len(texts)
            s, n = index.sums(texts)
            with np.errstate(invalid="ignore", divide="ignore"):
                raw = np.where(n > 0, s.astype(np.float64) / n / float(SCALE), lo)
            return np.maximum(0.0, np.minimum(1.0, (raw - lo) / (hi - lo))).tolist()

        def of(texts: list[str], flags: list[bool]) -> list[pa.Array]:
            facts, held = [], ([], [])  # held: of either model, its blocks
            for t, flag in zip(texts, flags):
                normal = batch.standard_of(t)
                other = bool(flag) and shared.value[1] is not None
                own = [batch.standard_of("\n".join(x).translate(fold)) for x, _ in batch.block_words(t, target)] if other else batch.normal_blocks(t, target)
                first = len(held[other])
                held[other].extend(own)
                hits = np.array(batch.marker_counts(normal)) > 0
                facts.append((len(t.split()), len(normal.split()), len(own), int(hits[decides].sum()), other, first))
            found = [m and scores(m, h) for m, h in zip(shared.value, held)]
            columns = [[] for _ in kinds]
            for *own, other, first in facts:
                values, at_least = found[other][first : first + own[2]], shared.value[other][3]
                k, order = len(values), sorted(values)
                middle = 0.5 * order[(k - 1) // 2] + 0.5 * order[k // 2] if k else None
                for c, v in zip(columns, (*own, middle, sum(v >= at_least for v in values) / k if k else None, values)):
                    c.append(v)
            return [pa.array(c, t) for c, t in zip(columns, kinds)]

        @F.arrow_udf("struct<n_words:int,n_normal:int,n_blocks:int,n_markers:int,median:double,up:double,scores:array<double>>")
        def run(texts: pa.Array, flags: pa.Array) -> pa.Array:
            at, parts = 0, []
            for own in batch.slices(texts):
                parts.append(of([t or "" for t in own], flags.slice(at, len(own)).to_pylist()))
                at += len(own)
            columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else [pa.array([], t) for t in kinds]
            return pa.StructArray.from_arrays(columns, ["n_words", "n_normal", "n_blocks", "n_markers", "median", "up", "scores"])

        return run.asNondeterministic()(text, transliterated)  # else a filter on its numbers is pushed below it and runs it twice

    def pick(self, transliterated: Column, value) -> Column:
        own = F.lit(value(self.model))
        return own if self.arabizi is None else F.when(transliterated, F.lit(value(self.arabizi))).otherwise(own)


def triage(docs: DataFrame, id_col: str, text_col: str, scorer: Scorer | Model, strict: bool = False) -> DataFrame:
    """(id, n_words, n_blocks, verdict, median, position, share_positive, n_markers, transliterated), a row for each document.

    A document without a block is undecidable, which isn't a rejection; it has null figures."""
    scorer = scorer if isinstance(scorer, Scorer) else Scorer(scorer)
    own = _prepared(docs, id_col, text_col)
    facts = own.select("__id", "transliterated", scorer.blocks(docs.sparkSession, F.col("__t"), F.col("transliterated")).alias("__f"))
    names = {"n_words": "n_words", "n_blocks": "n_blocks", "n_markers": "n_markers", "median": "__m", "up": "__up"}
    out = facts.select("__id", "transliterated", *[F.col(f"__f.{k}").alias(v) for k, v in names.items()])
    yes = (F.col("__m") >= scorer.pick(F.col("transliterated"), lambda m: m.threshold)) & (F.lit(not strict) | (F.col("n_markers") >= MIN_MARKERS))
    verdict = F.when(F.col("n_blocks") == 0, "undecidable").when(yes, "positive").otherwise("other")
    return out.select(F.col("__id").alias(id_col), "n_words", "n_blocks", verdict.alias("verdict"), F.round("__m", 4).alias("median"), F.round(position(F.col("__m")), 4).alias("position"), F.round("__up", 3).alias("share_positive"), F.when(F.col("n_blocks") > 0, F.col("n_markers")).otherwise(0).alias("n_markers"), "transliterated")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __t, transliterated), a row for each row."""
    p = prepare(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("__id"), p.alias("__p"))
    return own.select("__id", F.col("__p.text").alias("__t"), F.col("__p.transliterated").alias("transliterated"))


def triage_summary(verdicts: DataFrame) -> DataFrame:
    """(verdict, n, share, median_position, min_position, max_position, n_transliterated); the row of null verdict is for all."""
    own = verdicts.groupingSets([["verdict"], []], "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("position"), 4).alias("median_position"), F.min("position").alias("min_position"), F.max("position").alias("max_position"), F.coalesce(F.sum(F.col("transliterated").cast("bigint")), F.lit(0)).alias("n_transliterated"))
    total = verdicts.agg(F.count(F.lit(1)).alias("__n"))
    return own.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.col("n") / F.col("__n"), 4).alias("share"), "median_position", "min_position", "max_position", "n_transliterated")


def block_dispersion(docs: DataFrame, id_col: str, text_col: str, scorer: Scorer | Model, long_text: int = LONG_TEXT) -> DataFrame:
    """(id, n, min, median, max, below_threshold, positions) of texts of ``long_text`` words or more with two blocks at least."""
    scorer = scorer if isinstance(scorer, Scorer) else Scorer(scorer)
    own = _prepared(docs, id_col, text_col)
    facts = own.select("__id", "transliterated", scorer.blocks(docs.sparkSession, F.col("__t"), F.col("transliterated")).alias("__f")).select("__id", "transliterated", "__f.*")
    threshold, scores = scorer.pick(F.col("transliterated"), lambda m: m.threshold), F.col("scores")
    below = F.size(F.filter(scores, lambda s: s < threshold))
    spots = F.array_sort(F.transform(scores, lambda s: F.round(position(s), 3)))
    return facts.where((F.col("n_normal") >= long_text) & (F.col("n_blocks") >= 2)).select(F.col("__id").alias(id_col), F.col("n_blocks").alias("n"), F.round(F.array_min(scores), 4).alias("min"), F.round("median", 4).alias("median"), F.round(F.array_max(scores), 4).alias("max"), below.alias("below_threshold"), spots.alias("positions"))


def reply_verdicts(replies: DataFrame, scorer: Scorer | Model, min_markers: int = MIN_MARKERS, order: str | None = None) -> DataFrame:
    """The verdict on each reply that isn't an error: skipped (empty, too short) or scored.

    (prompt_id, model, condition, script, n_words, scorable, skipped, score, label, above_classifier, n_markers, is_positive,
    transliterated, arabic, latin, other, ar, fr, arabizi, unknown, explanation), and the column ``order`` of the log if it is named."""
    scorer = scorer if isinstance(scorer, Scorer) else Scorer(scorer)
    p = prepare(F.coalesce(F.col("reply"), F.lit("")))
    own = replies.where(F.coalesce("error", F.lit("")) == "").select("prompt_id", "model", "condition", "script", *[c for c in (order,) if c], p.alias("__p"))
    own = own.select("*", F.col("__p.text").alias("__t"), F.col("__p.transliterated").alias("transliterated"), normalize(F.col("__p.text")).alias("__n")).drop("__p")
    own = own.withColumn("n_words", words_of(F.col("__n")))
    least = scorer.pick(F.col("transliterated"), lambda m: m.min_words)
    ready = (F.col("__t") != "") & (F.col("n_words") >= least)
    out = scorer.scored(own.withColumn("__s", F.when(ready, F.col("__t"))), "__s", "transliterated").withColumn("score", F.when(ready, F.col("score")))
    above, n = F.col("score") >= F.col("threshold"), markers.n_discriminant(F.col("__n"))
    found = markers.counts(F.col("__n"))
    skipped = F.when(F.col("__t") == "", "empty reply").when(~ready, F.format_string("too short (%d words, minimum %d)", "n_words", least))
    # with a model for transliterated text, the label is that of the folded text too
    label = F.when(F.col("transliterated"), predict(F.col("score"), F.col("n_words"), scorer.arabizi or scorer.model)["label"]).otherwise(predict(F.col("score"), F.col("n_words"), scorer.model)["label"])
    ratio, shares = script_ratio(F.col("__t")), profile(F.col("__t"))
    only = lambda c: F.when(ready, c)
    return out.select(
        "prompt_id", "model", "condition", "script", "n_words", ready.alias("scorable"), skipped.alias("skipped"), F.round("score", 4).alias("score"), only(label).alias("label"), above.alias("above_classifier"),
        only(n).alias("n_markers"), only(above & (n >= min_markers)).alias("is_positive"), "transliterated", *[F.round(ratio[k], 6).alias(k) for k in ("arabic", "latin", "other")],
        *[only(shares[k]).alias(k) for k in ("ar", "fr", "arabizi", "unknown")], only(markers.explain(found, F.col("n_words"))).alias("explanation"), *[c for c in (order,) if c],
    )


def measures(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One wide row for each text: status (empty, too_short, measured) and what there is to say about it."""
    p = prepare(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col), F.col(text_col).alias("__raw"), p["text"].alias("__t"), p["transliterated"].alias("transliterated"))
    own = own.withColumn("__n", normalize(F.col("__t"))).withColumn("n_words", words_of(F.col("__n")))
    status = F.when(~F.col("__t").rlike("(?U)[^\\s]"), "empty").when(F.col("n_words") < model.min_words, "too_short").otherwise("measured")
    raw = raw_score(F.when(status == "measured", F.col("__n")), model.index(), docs.sparkSession)
    out = own.withColumn("score", F.when(status == "measured", model.score(raw)))
    pos, n = position(F.col("score")), markers.n_discriminant(F.col("__n"))
    done = F.col("score").isNotNull()
    return out.select(
        id_col, status.alias("status"), "n_words", "transliterated", script_ratio(F.col("__raw")).alias("script"), F.round("score", 4).alias("score"), F.round(pos, 4).alias("position"), zone(pos).alias("zone"),
        (F.col("score") >= model.threshold).alias("above_classifier"), F.when(done, n).alias("n_markers"), F.when(done, (F.col("score") >= model.threshold) & (n >= MIN_MARKERS)).alias("is_positive"),
        F.when(done, markers.counts(F.col("__n"))).alias("markers"), F.when(done, profile(F.col("__t"))).alias("codeswitch"),
    )


__all__ = ["LONG_TEXT", "MIN_MARKERS", "Scorer", "TARGET", "block_dispersion", "measures", "reply_verdicts", "triage", "triage_summary"]
