"""Code-switch segmentation: runs of one script, words of one language within Latin runs.

Labels of a run's words are one string of codes (a: Arabizi, f: French, u: undecided). Smoothing gives an undecided word the
label of the nearest decided one to its left, else to its right, and neighbours of one label are one segment: both are one
regular expression over that string, so a text is segmented within its row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import batch
from ..functions.translit import FRENCH, STOPWORDS

_AR = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]"
_LA = "[A-Za-z\\x{C0}-\\x{FF}0-9']"
#: Possessive loops: Java's regex recurses on others, and a run may have any number of words.
RUN = f"{_AR}++(?:[\\s\\x{{064B}}-\\x{{065F}}]+{_AR}++)*+|{_LA}++(?:[ \\t]++{_LA}++)*+|[^\\s]++"
#: ``batch`` says the same of a whole text, word by word.
SMOOTH = "(?:^u++)?(?:(?:fu*+)++|(?:au*+)++)|^u++$"
ACCENT = "[àâäçéèêëîïôöùûüÿœæ]"
LETTER_DIGIT = "[a-zà-ÿ][2-9]|[2-9]'?[a-zà-ÿ]"
LANGS = ("ar", "fr", "arabizi", "unknown")
THRESHOLD = 0.15


def _label(word: Column) -> Column:
    w = F.btrim(F.lower(word), F.lit("'"))
    return F.when(w.rlike(LETTER_DIGIT) | w.isin(*STOPWORDS), F.lit("a")).when(w.isin(*FRENCH) | w.rlike(ACCENT), F.lit("f")).otherwise(F.lit("u"))


def _islands(run: Column) -> Column:
    """array<string>: the codes of each segment of a Latin run."""
    words = F.regexp_extract_all(run, F.lit(f"{_LA}+"), F.lit(0))
    return F.regexp_extract_all(F.array_join(F.transform(words, _label), ""), F.lit(SMOOTH), F.lit(0))


def _lang(codes: Column) -> Column:
    return F.when(codes.contains("f"), F.lit("fr")).when(codes.contains("a"), F.lit("arabizi")).otherwise(F.lit("unknown"))


def _script(run: Column) -> Column:
    return F.when(run.rlike(f"^{_AR}"), F.lit("arabic")).when(run.rlike(f"^{_LA}"), F.lit("latin")).otherwise(F.lit("other"))


_language_facts = F.arrow_udf(batch.language_facts, ArrayType(IntegerType()))


def profile(text: Column) -> Column:
    """struct<ar, fr, arabizi, unknown>: shares of the words; all 0 without words."""
    n = {k: _language_facts(text)[i] for i, k in enumerate(LANGS)}
    total = n["ar"] + n["fr"] + n["arabizi"] + n["unknown"]
    return F.struct(*[F.when(total > 0, F.round(n[k] / total, 4)).otherwise(F.lit(0.0)).alias(k) for k in LANGS])


def is_code_switched(shares: Column, threshold: float = THRESHOLD) -> Column:
    """At least two languages, the undecided one included, have such a share."""
    return sum((F.when(shares[k] >= threshold, 1).otherwise(0) for k in LANGS), F.lit(0)) >= 2


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(sizes: pd.Series) -> pd.Series:
    """Running sums of a row's sizes, each before its own."""
    return sizes.map(lambda x: np.cumsum(x) - x)


def segments(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text, script, lang, start, end) with text = source[start:end], behind ``more`` columns of the row; one pass, within the row."""
    keys = [*more, id_col]
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{RUN}|\\s+"), F.lit(0))
    own = docs.select(*keys, runs.alias("__runs")).withColumn("__at", _starts(F.transform("__runs", F.length)))
    placed = own.select(*keys, F.inline(F.arrays_zip(F.col("__runs").alias("run"), F.col("__at").alias("at")))).where("run rlike '^[^\\\\s]'").withColumn("script", _script(F.col("run")))
    latin = F.col("script") == "latin"
    placed = placed.where(~((F.col("script") == "other") & F.col("run").rlike("^[\\p{P}\\p{S}\\p{Z}]+$"))).withColumn("isles", F.when(latin, _islands(F.col("run"))))
    ends = F.aggregate("isles", F.array().cast("array<int>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(c))))
    bits = F.when(latin, F.regexp_extract_all("run", F.lit(f"{_LA}+|[ \\t]+"), F.lit(0)))  # word, gap, word ...
    rows = placed.withColumns({"bits": bits, "ends": ends}).select(*keys, "run", "at", "script", "bits", F.inline_outer(F.arrays_zip(F.col("isles").alias("codes"), F.col("ends").alias("stop"))))
    first = (F.col("stop") - F.length("codes")) * 2
    text = F.when(latin, F.array_join(F.slice("bits", first + 1, F.length("codes") * 2 - 1), "")).otherwise(F.col("run"))
    head = F.when(latin, F.length(F.array_join(F.slice("bits", F.lit(1), first), ""))).otherwise(0)
    lang = F.when(latin, _lang(F.col("codes"))).when(F.col("script") == "arabic", "ar").otherwise("unknown")
    out = rows.select(*keys, text.alias("text"), "script", lang.alias("lang"), (F.col("at") + head).cast("int").alias("start"))
    return out.withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def extract(docs: DataFrame, id_col: str, text_col: str, lang: str) -> DataFrame:
    """(id, fragments): those of one language in order, a row for each row that has some."""
    own = segments(docs.withColumn("__k", F.monotonically_increasing_id()), id_col, text_col, "__k").where(F.col("lang") == lang)
    by = own.groupBy("__k").agg(F.first(id_col).alias(id_col), F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]).alias("fragments"))
    return by.drop("__k")
