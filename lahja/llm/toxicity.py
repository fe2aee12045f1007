"""Toxicity by a classifier chain.

Categories are predicted one after another: every 0/1 column of the labels table but its id is one, in the table's order, the
``target`` (toxic) last. Each is a logistic regression over the presence of chosen words and word beginnings (3 to 6
characters, so that inflected and compound words of any language share features) and the probabilities of the categories
before it. The later models are trained with out-of-fold probabilities of the earlier ones, as they will meet at
prediction.

Everything is fitted on a bounded sample of labelled rows: the ``per_class`` ids labelled with the target and as many
without it that hash lowest (an id that is labelled several times has the least of its labels), whole texts, near copies
among them left out (same lowest n-gram hash), and the ``features`` words and beginnings that tell the target apart best.
A row without a label of an earlier category doesn't train that category. What is broadcast has a fixed size. Prediction
reads whole texts in one scan without a shuffle; only the text column goes to Python.

Defined results: a null text, or one without words, has probability 0 throughout and is never toxic.
Labels of ids that no document has are ignored; documents without labels are predicted like others. Without
labels of both classes of the target every probability is 0; a category of one class only has probability 0 or 1, as its
bias learns. Rows that repeat stay and are predicted alike; very long texts are read whole; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._text import Words, batches, grams, hash_fixed, mix
from .langid import lookup

TARGET = "toxic"
PER_CLASS, FEATURES, FOLDS = 2000, 384, 5
#: A feature word is in at least so many sampled documents of one class.
MIN_DOCS = 8


#: Lengths of the word beginnings.
BEGINNINGS = (3, 4, 5, 6)


def presence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every word and word beginning; repeats stay."""
    size = words.end - words.start
    docs, hashes = [words.doc], [words.hash]
    for n in BEGINNINGS:
        own = np.flatnonzero(size >= n)
        docs.append(words.doc[own])
        hashes.append(mix(hash_fixed(words.cp, words.start[own], n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, steps: int = 250) -> np.ndarray:
    """Weights, the last one the bias: accelerated gradient descent on the mean log loss, with a ridge on all but the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x1.shape[1], np.float32)
    prev = w.copy()
    ridge = np.full(len(w), l2, np.float32)
    ridge[-1] = 0
    norm = np.full(x1.shape[1], 1 / np.sqrt(x1.shape[1]), np.float32)
    top = 1.0
    for _ in range(20):  # largest eigenvalue by power iteration, for the step
        norm = x1.T @ (x1 @ norm)
        top = float(np.linalg.norm(norm))
        norm /= np.float32(top)
    step = np.float32(1 / (0.25 * 1.05 * top / len(x) + l2))
    for t in range(steps):
        ahead = w + np.float32(t / (t + 3)) * (w - prev)
        grad = x1.T @ (_sigmoid(x1 @ ahead) - y) / np.float32(len(x)) + ridge * ahead
        prev, w = w, ahead - step * grad
    return w.astype(np.float64)


@dataclass
class Chain:
    chain: list[str]  # categories in order, the target last
    keys: np.ndarray  # ascending hashes of the feature words
    weights: dict[str, np.ndarray]  # features, then the earlier categories, then the bias

    def __post_init__(self):
        self.bits = np.zeros(1 << 16, bool)  # most words are no feature
        self.bits[self.keys >> np.uint64(48)] = True

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities by text and category."""
        out = np.zeros((len(texts), len(self.chain)))
        if not self.weights:
            return out
        words = Words(texts)
        doc, h = presence(words)
        may = self.bits[h >> np.uint64(48)]
        doc, h = doc[may], h[may]
        at, known = lookup(self.keys, h)
        pairs = np.unique(doc[known] * len(self.keys) + at[known])
        doc, feature = pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1)
        some = np.diff(words.first) > 0
        for k, c in enumerate(self.chain):
            w = self.weights[c]
            z = np.bincount(doc, weights=w[feature], minlength=len(texts)) + w[-1] + out[:, :k] @ w[len(self.keys) : -1]
            out[:, k] = _sigmoid(z) * some
        return out


def sketch(texts: list[str | None]) -> list[tuple[int | None, np.ndarray]]:
    """(lowest n-gram hash, distinct features) of each text."""
    out: list[tuple[int | None, np.ndarray]] = []
    for a, b in batches(texts):
        words = Words(texts[a:b])
        d, g = grams(words, 3)
        low = np.full(b - a, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, d, g)
        doc, h = presence(words)
        order = np.argsort(doc, kind="stable")
        h, cut = h[order], np.searchsorted(doc[order], np.arange(b - a + 1))
        out += [(int(low[i : i + 1].view(np.int64)[0]), np.unique(h[cut[i] : cut[i + 1]])) for i in range(b - a)]
    return out


def fit(sketches: list[tuple[int | None, np.ndarray]], labels: np.ndarray, chain: list[str], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """labels: a row for each text, a column for each category, NaN where unknown."""
    target = labels[:, -1] if len(labels) else np.zeros(0)
    if len(set(target.tolist())) < 2:
        return Chain(chain, np.zeros(0, np.uint64), {})
    keep, seen = [], set()
    for i, (low, _) in enumerate(sketches):
        if (low, target[i]) not in seen:
            seen.add((low, target[i]))
            keep.append(i)
    doc_words, labels = [sketches[i][1] for i in keep], labels[keep]
    y = labels[:, -1]
    every = np.concatenate(doc_words)
    owner = np.repeat(np.arange(len(keep)), [len(w) for w in doc_words])
    uniq, inv = np.unique(every, return_inverse=True)
    pos = np.bincount(inv, weights=y[owner], minlength=len(uniq))
    neg = np.bincount(inv, minlength=len(uniq)) - pos
    n1, n0 = y.sum(), len(y) - y.sum()
    gap = np.abs(np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))) * np.sqrt(np.maximum(pos, neg))
    gap[np.maximum(pos, neg) < min(MIN_DOCS, max(2, len(y) // 10))] = 0
    best = np.argsort(-gap, kind="stable")[:features]
    keys = np.sort(uniq[best[gap[best] > 0]])
    x = np.zeros((len(keep), len(keys)), np.float32)
    at, known = lookup(keys, every)
    x[owner[known], at[known]] = 1
    fold = np.arange(len(keep)) % folds
    weights, before = {}, np.zeros((len(keep), 0), np.float32)
    for k, c in enumerate(chain):
        have = ~np.isnan(labels[:, k])
        full = np.hstack([x, before])
        weights[c] = logistic(full[have], labels[have, k]) if have.any() else np.zeros(full.shape[1] + 1)
        if c != chain[-1]:
            out = np.zeros(len(keep), np.float32)
            for f in range(folds):
                rest = have & (fold != f)
                w = logistic(full[rest], labels[rest, k]) if rest.any() else weights[c]
                out[fold == f] = _sigmoid(full[fold == f] @ w[:-1] + w[-1])
            before = np.hstack([before, out[:, None]])
    return Chain(chain, keys, weights)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = TARGET, categories: list[str] | None = None, per_class: int = PER_CLASS) -> Chain:
    """categories: the columns of labels that come before the target; all others but the id, where none are given."""
    spark = docs.sparkSession
    chain = [*(categories if categories is not None else [c for c in labels.columns if c not in (id_col, target)]), target]
    value = [F.min(F.when(F.col(f"`{c}`").cast("int").isin(0, 1), F.col(f"`{c}`").cast("int"))).alias(f"y{k}") for k, c in enumerate(chain)]
    named = labels.select(F.col(f"`{id_col}`").alias("id"), *labels.columns).where(F.col("id").isNotNull()).groupBy("id").agg(*value)
    goal = F.col(f"y{len(chain) - 1}")
    named = named.where(goal.isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(goal.alias("y")).count().collect()}
    # a hash threshold lets through little more than is taken: some labels have no document
    share = F.lit(0.0)
    for v, n in sizes.items():
        share = F.when(goal == v, F.lit(min(1.0, 1.5 * per_class / n + 20 / n))).otherwise(share)
    chosen = named.where(F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)) < share)
    bound = 4 * per_class + 1000
    rows = chosen.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("ids are not spread by their hash")
    few = spark.createDataFrame(rows, chosen.schema) if rows else chosen

    @F.pandas_udf("struct<low:bigint,words:array<bigint>>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        found = sketch(texts.tolist())
        return pd.DataFrame({"low": [x for x, _ in found], "words": [w.view(np.int64) for _, w in found]})

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0).join(F.broadcast(few), "id")
    own = own.withColumns({"h": F.xxhash64("id"), "t": F.xxhash64("text")}).withColumn("place", F.row_number().over(W.partitionBy(goal).orderBy("h", "id", "t"))).where(F.col("place") <= per_class)
    found = own.select("h", "id", "t", *[f"y{k}" for k in range(len(chain))], sketched("text").alias("s")).toArrow().sort_by([("h", "ascending"), ("t", "ascending")])
    y = np.column_stack([found.column(f"y{k}").to_numpy().astype(np.float64) for k in range(len(chain))]) if len(found) else np.zeros((0, len(chain)))
    s = found.column("s").combine_chunks()
    words, low = s.field("words"), s.field("low").to_pylist()
    cut, flat = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
    sketches = [(low[i], flat[cut[i] : cut[i + 1]]) for i in range(len(low))]
    order = np.random.default_rng(0).permutation(len(sketches))
    return fit([sketches[i] for i in order], y[order], chain)


def score(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, a probability p_ for each category, the target), a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<" + ",".join(f"c{k}:double" for k in range(len(model.chain))) + ">")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = texts.tolist()
        parts = [shared.value.predict(own[a:b]) for a, b in batches(own)]
        return pd.DataFrame(np.vstack(parts) if parts else np.zeros((0, len(model.chain))), columns=[f"c{k}" for k in range(len(model.chain))])

    own = docs.select(F.col(f"`{id_col}`").alias("id"), predict(F.col(f"`{text_col}`")).alias("r"))
    return own.select(F.col("id").alias(id_col), *[F.round(f"r.c{k}", 6).alias(f"p_{c}") for k, c in enumerate(model.chain)], (F.col(f"r.c{len(model.chain) - 1}") >= threshold).alias(model.chain[-1]))
