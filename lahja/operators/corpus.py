"""Corpora of two classes for a contrast: clean, filter by script, chunk, cap sources, split, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_for_training, entity_of
from ..functions.normalize import fold_for_arabizi, nfkc, script_ratio, squeeze
from .blocks import TARGET, chunk_lines
from .classifier import Model, score_texts
from .sampling import balance as balanced
from .sampling import cap_sources, holdout_split

MIN_ARABIC, MIN_LATIN = 0.85, 0.60


def clean_lines(lines: DataFrame, contrast: dict, text: str = "line") -> DataFrame:
    """The lines as the contrast wants them."""
    t = F.col(text)
    if contrast["strip_entities"]:
        t = clean_for_training(t)
    if contrast["fold_arabizi"]:
        t = fold_for_arabizi(t)
    out = lines.withColumn(text, t)
    if contrast["arabic_only"]:
        out = out.where(script_ratio(F.col(text))["arabic"] >= MIN_ARABIC)
    elif contrast["latin_only"]:
        out = out.where(script_ratio(F.col(text))["latin"] >= MIN_LATIN)
    return out


def build(positive: DataFrame, negative: DataFrame, contrast: dict, order: list[str], target: int = TARGET, holdout: float = 0.25, balance: bool = True, seed: int = 0) -> DataFrame:
    """(cls, split, source, block, n_words, text) of lines (source, order, line); an empty class is an error."""
    sides = []
    for cls, lines in (("positive", positive), ("negative", negative)):
        blocks = chunk_lines(clean_lines(lines, contrast), "source", order, "line", target)
        capped = cap_sources(blocks.withColumn("key", F.concat_ws("/", "source", "block")), "source", "key", contrast["shares"], seed)
        sides.append(capped.withColumn("cls", F.lit(cls)))
    both = sides[0].unionByName(sides[1])
    split = holdout_split(both, "key", holdout, seed, by="cls")
    if {r["cls"] for r in split.select("cls").distinct().collect()} != {"positive", "negative"}:
        raise ValueError(f"a class of {contrast['name']} has no blocks")
    out = balanced(split, "cls") if balance else split
    return out.select("cls", "split", "source", "block", "n_words", "text")


def entity_counts(lines: DataFrame, text: str) -> DataFrame:
    """(entity, n): what the entity filter removes."""
    words = lines.select(F.explode(F.split(squeeze(nfkc(F.col(text))), " ")).alias("w"))
    return words.select(entity_of(F.col("w")).alias("entity")).where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def validate(lines: DataFrame, model: Model, order: str = "line_no", target: int = TARGET, limit: int | None = 4000, arabic_only: bool = True) -> DataFrame:
    """(source, role, n, median, above_threshold) of a cache (source, role, order, line): how a model judges the first ``limit`` blocks of each source (None: all)."""
    clean = clean_lines(lines, {"strip_entities": True, "fold_arabizi": False, "arabic_only": arabic_only, "latin_only": False})
    blocks = chunk_lines(clean, "source", [order], "line", target)
    scores = score_texts(blocks, ["source", "block"], "text", model)
    if limit is not None:
        scores = scores.where(F.col("block") < limit)
    by = scores.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("score"), 4).alias("median"), F.round(F.avg((F.col("score") >= model.threshold).cast("double")), 4).alias("above_threshold"))
    return by.join(lines.select("source", "role").distinct(), "source").select("source", "role", "n", "median", "above_threshold")
