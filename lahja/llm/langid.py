"""Language identification by word-first backoff.

A word that the model knows scores, for each language, its negative log10 relative frequency in that language
(PENALTY where the language lacks it). An unseen word falls back to its character n-grams, 5 long first, then
4, 3, 2 and 1: the longest length of which any n-gram is known gives the mean over its known n-grams. A text's
score is the mean over all its words, every occurrence counted; the language with the lowest wins.

The model is fitted on a bounded sample of labelled rows: of each language the ``per_language`` distinct documents whose
ids and texts hash lowest, ROWS in all where that many languages would make more (a document each at least). All
languages, whole texts, all words and all n-grams of the sample count. Counting is distributed; what the driver gets and
broadcasts is the sample's vocabulary, kept sparsely (a language and a number for each word that the language has), so
it is bounded by the sample however large the corpus. Classification reads whole texts, in one
scan without a shuffle; only the text column goes to Python.

Defined results: a null text, or one without letters or numbers, has no language (null), margin 0 and is
rejected; so is a text whose best two languages are less than ``min_margin`` apart. With one language known
the margin is PENALTY. Without labelled documents everything is rejected. Ties go to the first name in
alphabetical order. Rows that repeat are judged alike, and count once in the sample. Very long texts are read whole. Any
other columns are carried as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import fresh, partitions
from ._text import Words, batches, flat, hash_fixed

PENALTY = 7.0
NGRAM = 5
#: Labelled rows of the sample: of one language, and in all.
PER_LANGUAGE, ROWS = 1500, 24_000
MIN_MARGIN = 0.005
RESULT = "struct<language:string,score:double,margin:double>"


class Table:
    """Numbers of words by language, for the languages that have the word; the others have PENALTY."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, count: np.ndarray, languages: int):
        order = np.lexsort((lang, key))
        key, lang, count = key[order], lang[order], count[order].astype(np.float64)
        total = np.bincount(lang, weights=count, minlength=languages)
        self.keys, self.start, self.size = np.unique(key, return_index=True, return_counts=True)
        self.lang, self.value = lang.astype(np.int32), np.minimum(-np.log10(count / total[lang]), PENALTY).astype(np.float32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lookup(self.keys, h)

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into at, language, number) of all entries of the words at these places."""
        own = flat(self.start[at], self.size[at])
        return np.repeat(np.arange(len(at)), self.size[at]), self.lang[own], self.value[own]


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def classify(self, texts: list[str | None]) -> list[tuple[str | None, float | None, float]]:
        words = Words(texts)
        n = len(self.languages)
        if not len(words.hash) or not n:
            return [(None, None, 0.0)] * len(texts)
        uniq, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        score = np.full((len(uniq), n), PENALTY, np.float32)
        at, known = self.words.find(uniq)
        row, lang, value = self.words.entries(at[known])
        score[np.flatnonzero(known)[row], lang] = value
        self._back_off(words, first, np.flatnonzero(~known), score)
        count = np.diff(words.first)
        own = np.flatnonzero(count > 0)
        total = np.add.reduceat(score[inverse].astype(np.float64), words.first[own], axis=0)
        mean = total / count[own, None]
        out: list[tuple[str | None, float | None, float]] = [(None, None, 0.0)] * len(texts)
        order = np.argsort(mean, axis=1, kind="stable")
        for k, i in enumerate(own):
            best = order[k, 0]
            margin = float(mean[k, order[k, 1]] - mean[k, best]) if n > 1 else PENALTY
            out[i] = (self.languages[best], float(mean[k, best]), margin)
        return out

    def _back_off(self, words: Words, first: np.ndarray, left: np.ndarray, score: np.ndarray) -> None:
        """Scores of unseen words; left indexes score, first gives a place of each in the texts."""
        for n in range(NGRAM, 0, -1):
            table = self.grams[n]
            if not len(left) or not len(table.keys):
                continue
            cp, start, size = padded(words, first[left])
            spots = np.maximum(size - n + 1, 0)
            owner = np.repeat(np.arange(len(left)), spots)
            begin = flat(start, spots)
            at, known = table.find(hash_fixed(cp, begin, n))
            owner, at = owner[known], at[known]
            hits = np.bincount(owner, minlength=len(left))
            done = hits > 0
            row, lang, value = table.entries(at)
            below = np.bincount(owner[row] * score.shape[1] + lang, weights=value - PENALTY, minlength=len(left) * score.shape[1]).reshape(len(left), -1)
            score[left[done]] = PENALTY + below[done] / hits[done, None]
            left = left[~done]


def lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each hash in ascending keys."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def padded(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen words with a blank on either side, one after another: code points, starts, sizes."""
    s, e = words.start[which], words.end[which]
    size = e - s + 2
    start = np.cumsum(size) - size
    cp = np.full(int(size.sum()), 32, np.uint32)
    inner = np.arange(int((e - s).sum())) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
    cp[inner + np.repeat(start + 1, e - s)] = words.cp[inner + np.repeat(s, e - s)]
    return cp, start, size


def count(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length of the n-grams or 0 for words, hashes, counts) of texts of one language."""
    out = []
    for a, b in batches(texts):
        words = Words(texts[a:b])
        uniq, first, times = np.unique(words.hash, return_index=True, return_counts=True)
        if not len(first):
            continue
        out.append((0, uniq, times))
        cp, start, size = padded(words, first)
        for n in range(1, NGRAM + 1):
            spots = np.maximum(size - n + 1, 0)
            h, inv = np.unique(hash_fixed(cp, flat(start, spots), n), return_inverse=True)
            out.append((n, h, np.bincount(inv, weights=np.repeat(times, spots), minlength=len(h)).astype(np.int64)))
    return out


COUNTS = "lang string, n int, h bigint, times bigint"


def _count(source):
    for batch in source:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for n, h, times in count(texts):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(times)], ["lang", "n", "h", "times"])


def model_of(counts: pa.Table) -> Model:
    """The model of summed counts."""
    languages = sorted(set(counts.column("lang").unique().to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    n, h, times = (counts.column(c).to_numpy() for c in ("n", "h", "times"))
    tables = [Table(h[n == k].view(np.uint64), lang[n == k], times[n == k], len(languages)) for k in range(NGRAM + 1)]
    return Model(languages, tables[0], dict(enumerate(tables[1:], 1)))


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of texts by language, counted here."""
    own = pa.RecordBatch.from_arrays([pa.array([k for k, v in samples.items() for _ in v], pa.string()), pa.array([t for v in samples.values() for t in v], pa.string())], ["lang", "text"])
    table = pa.Table.from_batches(list(_count([own])), pa.schema([("lang", pa.string()), ("n", pa.int32()), ("h", pa.int64()), ("times", pa.int64())]))
    return model_of(table.group_by(["lang", "n", "h"]).aggregate([("times", "sum")]).rename_columns(["lang", "n", "h", "times"]))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, rows: int) -> DataFrame:
    """(lang, text): the labelled sample."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    per = max(1, min(per_language, rows // max(1, len(sizes))))
    # a hash threshold lets through little more of a large language than is taken, whatever the number of partitions
    large = {k: 1.5 * per / n + 20 / n for k, n in sizes.items() if n > 1.5 * per + 20}
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("lang")), F.lit(1.0)) if large else F.lit(1.0)
    h = F.xxhash64("id", "text")
    chosen = own.where((F.length("text") > 0) & (h.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)) < share)).groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))
    first = W.partitionBy("lang").orderBy(F.col("h").bitwiseAND(F.lit((1 << 53) - 1)), "h")
    return chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per).select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model:
    chosen = sample(docs, id_col, text_col, lang_col, per_language, rows)
    counts = chosen.repartition(partitions(docs.sparkSession)).mapInArrow(_count, COUNTS).groupBy("lang", "n", "h").agg(F.sum("times").alias("times"))
    return model_of(counts.toArrow())


def _classify(docs: DataFrame, text_col: str, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def classify(texts: pd.Series) -> pd.DataFrame:
        own, rows = texts.tolist(), []
        for a, b in batches(own):
            rows += shared.value.classify(own[a:b])
        return pd.DataFrame(rows, columns=["language", "score", "margin"])

    return classify(F.col(f"`{text_col}`"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, language, score, margin, accepted), a row for each row."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), _classify(docs, text_col, model).alias("r"))
    return own.select(F.col("id").alias(id_col), "r.language", F.round("r.score", 6).alias("score"), F.round("r.margin", 6).alias("margin"), (F.col("r.language").isNotNull() & (F.col("r.margin") >= min_margin)).alias("accepted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that have a language; columns as given."""
    at = fresh(docs, "language_id")
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn(at, _classify(docs, text_col, model))
    return own.where(F.col(f"{at}.language").isNotNull() & (F.col(f"{at}.margin") >= min_margin)).select(*names)
