"""Contrastive classifier on character n-grams: log-likelihood ratios, calibration, learned threshold, evaluation.

Weights are integers (SCALE times the ratio), so that sums don't depend on order or partitioning and equal texts score the
same everywhere. The weight table has at most ``max_features`` rows, whatever the corpus; it is broadcast. Texts are scored in the
scan, a batch at a time, without a row for each n-gram; counts for training leave a task as one row for each of its n-grams.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batch import slices
from ..functions.normalize import normalize, words_of
from ..storage import materialize

NGRAM, ALPHA, MAX_FEATURES, MIN_WORDS = 4, 0.5, 60_000, 25
SCALE = 1_000_000_000


def char_ngrams(normal: Column, n: int = NGRAM) -> Column:
    """Overlapping n-grams of text in normal form, word ends marked; linear in the text."""
    s = F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("_")), F.lit(" "))
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with their ends marked, one after another, and where each begins."""
    marked = [f" {t.replace(' ', '_')} " if t is not None else "" for t in texts]
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)


class Windows:
    """N-grams of a batch as numbers over an alphabet: exact, as each character has bits of its own."""

    def __init__(self, cp: np.ndarray, begins: np.ndarray, n: int, alphabet: np.ndarray):
        """alphabet: ascending code points; the n-grams of others have the number 0."""
        bits = max(1, int(len(alphabet)).bit_length())
        self.begins, self.n = begins, n
        place = np.zeros(int(alphabet[-1]) + 2 if len(alphabet) else 1, np.uint64)
        place[alphabet] = np.arange(1, len(alphabet) + 1)
        own = place[np.minimum(cp, len(place) - 1)]
        count = max(len(cp) - n + 1, 0)
        self.key = np.zeros(count, np.uint64)
        known = np.ones(count, bool)
        for k in range(n):
            part = own[k : k + count]
            self.key = (self.key << np.uint64(bits)) | part
            known &= part > 0
        self.key[~known] = 0
        # those that reach into the next text are none
        self.sizes = np.maximum(np.diff(begins) - n + 1, 0)
        self.where = np.arange(int(self.sizes.sum())) + np.repeat(begins[:-1] - (np.cumsum(self.sizes) - self.sizes), self.sizes)

    @staticmethod
    def fits(n: int, characters: int) -> bool:
        return n * max(1, int(characters).bit_length()) <= 64


class Index:
    """A weight table for lookups: n-grams as ascending numbers, their weights."""

    def __init__(self, grams: list[str], w: np.ndarray, n: int):
        cp = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.alphabet = n, np.unique(cp)
        if not Windows.fits(n, len(self.alphabet)):
            raise ValueError("too many characters for n-grams of this length")
        key = Windows(cp, np.arange(len(grams) + 1) * n, n, self.alphabet)
        key = key.key[key.where]
        order = np.argsort(key)
        self.key, self.w = key[order], w[order]

    @classmethod
    def of(cls, weights: DataFrame, n: int) -> Index:
        table = weights.select("gram", "w").toArrow()
        return cls(table.column("gram").to_pylist(), table.column("w").to_numpy().astype(np.int64), n)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, number of n-grams) of each text."""
        cp, begins = _codes(texts)
        own = Windows(cp, begins, self.n, self.alphabet)
        value = np.zeros(len(own.key), np.int64)
        some = np.flatnonzero(own.key) if len(self.key) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, own.key[some]), max(len(self.key) - 1, 0))
        hit = self.key[at] == own.key[some] if len(self.key) else np.zeros(0, bool)
        value[some[hit]] = self.w[at[hit]]
        acc = np.concatenate([[0], np.cumsum(value)])
        first = np.minimum(begins[:-1], len(value))  # texts at the end may be too short for any
        return acc[np.minimum(first + own.sizes, len(value))] - acc[first], own.sizes


@dataclass
class Model:
    weights: DataFrame  # gram, w
    lo: float
    hi: float
    threshold: float
    n: int = NGRAM
    min_words: int = MIN_WORDS
    labels: tuple[str, str] = ("positive", "negative")
    meta: dict = field(default_factory=dict)

    def index(self) -> Index:
        """The weights for lookups, read once."""
        if "_index" not in self.__dict__:
            self._index = Index.of(self.weights, self.n)
        return self._index

    def params(self) -> dict:
        return {f: self.__dict__[f] for f in ("lo", "hi", "threshold", "n", "min_words", "labels", "meta")}

    def save(self, path: str) -> None:
        """A folder of Parquet weights and JSON parameters; a path that ends in .json or .json.gz: one file, to be exchanged."""
        spark = self.weights.sparkSession
        if path.endswith((".json", ".json.gz")):
            table = self.weights.select("gram", (F.col("w") / float(SCALE)).alias("w")).toArrow()
            own = self.params() | {"ngram": self.n, "weights": dict(zip(table.column("gram").to_pylist(), table.column("w").to_pylist()))}
            own.pop("n")
            with (gzip.open if path.endswith(".gz") else open)(path, "wt", encoding="utf-8") as f:
                json.dump(own, f, ensure_ascii=False)
            return
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(json.dumps(self.params()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """A saved model; what a file lacks has its default."""
        if path.endswith((".json", ".json.gz")):
            with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
                own = json.load(f)
            n = int(own.get("ngram", own.get("n", NGRAM)))
            weights = spark.createDataFrame([(g, int(round(w * SCALE))) for g, w in own.get("weights", {}).items()], "gram string, w bigint")
            return cls(weights, float(own.get("lo", 0.0)), float(own.get("hi", 1.0)), float(own.get("threshold", 0.5)), n, int(own.get("min_words", MIN_WORDS)), tuple(own.get("labels", ("positive", "negative"))), own.get("meta", {}))
        params = json.loads(spark.read.text(f"{path}/params").first()[0])
        return cls(spark.read.parquet(f"{path}/weights"), **params | {"labels": tuple(params["labels"])})

    def score(self, raw: Column) -> Column:
        """Calibrated score of a raw one; a text without n-grams has the low end's."""
        if self.hi <= self.lo:
            return F.lit(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(raw, F.lit(self.lo)) - self.lo) / (self.hi - self.lo)))


def raw_score(normal: Column, index: Index, spark: SparkSession) -> Column:
    """Mean weight over the n-grams of text in normal form, unknown ones count 0; null without n-grams."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("struct<s:bigint,n:bigint>")
    def scan(texts: pa.Array) -> pa.Array:
        parts = [shared.value.sums(own) for own in slices(texts)]
        both = [np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in both], ["s", "n"])

    found = scan(normal)
    return F.when(found["n"] > 0, found["s"].cast("double") / found["n"] / float(SCALE))


def raw_scores(texts: DataFrame, keys: list[str], normal: str, weights: DataFrame | Index, n: int = NGRAM) -> DataFrame:
    """(keys, raw), a row for each row."""
    index = weights if isinstance(weights, Index) else Index.of(weights, n)
    return texts.select(*keys, raw_score(F.col(normal), index, texts.sparkSession).alias("raw"))


def gram_counts(texts: DataFrame, positive: str, normal: str, n: int = NGRAM) -> DataFrame:
    """(gram, cp, cn): how often each n-gram occurs in texts of either class; counted in every task, then summed."""

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            flags, a, b = batch.column(0).to_numpy(zero_copy_only=False).astype(bool), 0, 0
            for own in slices(batch.column(1)):
                a, b = b, b + len(own)
                cp, begins = _codes(own)
                alphabet = np.unique(cp)
                if not Windows.fits(n, len(alphabet)):  # a batch of very many characters or long n-grams
                    sizes = np.maximum(np.diff(begins) - n + 1, 0)
                    where = np.arange(int(sizes.sum())) + np.repeat(begins[:-1] - (np.cumsum(sizes) - sizes), sizes)
                    spelled = np.array([cp[i : i + n].tobytes().decode("utf-32-le", "surrogatepass") for i in where.tolist()], object)
                    code, names = pd.factorize(spelled)
                    names = names.tolist()
                else:
                    found = Windows(cp, begins, n, alphabet)
                    sizes, where = found.sizes, found.where
                    keys, first, code = np.unique(found.key[where], return_index=True, return_inverse=True)
                    at = where[first]
                    body = cp[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
                    names = [body[i : i + n] for i in range(0, len(body), n)]
                p = np.bincount(code, weights=np.repeat(flags[a:b], sizes), minlength=len(names)).astype(np.int64)
                total = np.bincount(code, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(p), pa.array(total - p)], ["gram", "cp", "cn"])

    own = texts.where(F.col(normal).isNotNull()).select(F.col(positive), F.col(normal))
    return own.mapInArrow(run, "gram string, cp bigint, cn bigint").groupBy("gram").agg(F.sum("cp").alias("cp"), F.sum("cn").alias("cn"))


def llr_weights(texts: DataFrame, positive: str, normal: str, n: int = NGRAM, alpha: float = ALPHA, max_features: int = MAX_FEATURES) -> DataFrame:
    """(gram, cp, cn, w) of texts of two classes; ``positive`` is a boolean column."""
    counts = materialize(gram_counts(texts, positive, normal, n), "grams")
    t = counts.agg(F.sum("cp").alias("p"), F.sum("cn").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ratio = F.log((F.col("cp") + alpha) / ((t["p"] or 0) + alpha * t["v"])) - F.log((F.col("cn") + alpha) / ((t["n"] or 0) + alpha * t["v"]))
    out = counts.select("gram", "cp", "cn", F.round(ratio * float(SCALE)).cast("bigint").alias("w"))
    if t["v"] <= max_features:
        return out
    return out.orderBy(F.desc(F.abs("w") * F.log1p(F.col("cp") + F.col("cn"))), "gram").limit(max_features)


def youden(scores: DataFrame, score: str = "score", positive: str = "p") -> DataFrame:
    """One row (threshold, j): the lowest score that maximises sensitivity + specificity - 1; 0.5 where a class is empty.

    Scores are grouped first; the running sums are over distinct scores, by range partitions in parallel and then over partitions."""
    by = scores.groupBy(F.col(score).alias("t")).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("n"))
    ranked = running(by, ["t"], {"p_before": "p", "n_before": "n"})
    total = ranked.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    j = (F.col("tp") - F.col("p_before")) / F.col("tp") - (F.col("tn") - F.col("n_before")) / F.col("tn")
    best = ranked.crossJoin(F.broadcast(total)).where("tp > 0 and tn > 0").select("t", F.round(j, 12).alias("j")).orderBy(F.desc("j"), "t").limit(1)
    return best.agg(F.coalesce(F.max("t"), F.lit(0.5)).alias("threshold"), F.max("j").alias("j"))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """The frame with sums over all rows before each, in a total order, without one task that holds all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "running")
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    over = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    heads = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(over), F.lit(0)).alias(f"__{k}") for k in sums])
    own = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(F.broadcast(heads), "__part")
    return out.select(*df.columns, *[(F.col(f"__{k}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(k) for k, c in sums.items()])


def nth(scores: DataFrame, column: str, k: Column) -> DataFrame:
    """One row (value): the k-th smallest, k an expression of n; exact."""
    by = scores.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(by, ["value"], {"before": "c"})
    total = ranked.agg(F.sum("c").alias("n"))
    hit = ranked.crossJoin(F.broadcast(total)).withColumn("k", k)
    return hit.where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("c"))).select("value")


def percentile_index(q: float) -> Column:
    """1-based place of the percentile: element int(q * n) of the sorted values, clamped."""
    return F.least(F.col("n"), F.floor(F.col("n") * q) + 1)



def upper_median() -> Column:
    return F.floor(F.col("n") / 2) + 1


def train(texts: DataFrame, positive: str, text: str, labels: tuple[str, str] = ("positive", "negative"), n: int = NGRAM, alpha: float = ALPHA, max_features: int = MAX_FEATURES, min_words: int = MIN_WORDS, meta: dict | None = None) -> Model:
    """Weights, calibration between below the lowest negative and the positives' 90th percentile, Youden threshold."""
    own = materialize(texts.select(F.monotonically_increasing_id().alias("id"), F.col(positive).alias("p"), normalize(F.col(text)).alias("normal")), "train")
    sizes = {r["p"]: r["count"] for r in own.groupBy("p").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        raise ValueError("both classes need texts")
    weights = materialize(llr_weights(own, "p", "normal", n, alpha, max_features).select("gram", "w"), "weights")
    raw = materialize(raw_scores(own, ["id", "p"], "normal", weights, n).select("p", F.coalesce("raw", F.lit(0.0)).alias("raw")), "raw")
    low = raw.where("not p").agg(F.min("raw")).first()[0]
    hi = nth(raw.where("p"), "raw", percentile_index(0.90)).first()[0]
    model = Model(weights, low - 0.10 * max(hi - low, 1e-6), hi, 0.5, n, min_words, labels)
    model.threshold = youden(raw.select("p", model.score(F.col("raw")).alias("score"))).first()["threshold"]
    model.meta = dict(meta or {}) | {"n_positive": sizes[True], "n_negative": sizes[False], "n_features": weights.count(), "ngram": n, "labels": list(labels), "threshold": round(model.threshold, 4)}
    return model


def score_texts(texts: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """(keys, score)."""
    own = texts.select(*keys, normalize(F.col(text)).alias("normal"))
    return raw_scores(own, keys, "normal", model.index(), model.n).select(*keys, model.score(F.col("raw")).alias("score"))


def predict(score: Column, n_words: Column, model: Model) -> Column:
    """struct<label, confidence>; null below the model's minimum of words."""
    t, (pos, neg) = model.threshold, model.labels
    up = F.struct(F.lit(pos).alias("label"), (0.5 + 0.5 * (score - t) / max(1e-9, 1.0 - t)).alias("confidence"))
    down = F.struct(F.lit(neg).alias("label"), (0.5 + 0.5 * (t - score) / max(1e-9, t)).alias("confidence"))
    return F.when(n_words >= model.min_words, F.when(score >= t, up).otherwise(down))


def auc(scores: DataFrame, score: str = "score", positive: str = "p") -> DataFrame:
    """One row (auc): area under the ROC curve by ranks, ties count half; NaN where a class is empty."""
    by = scores.groupBy(F.col(score).alias("t")).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("n"))
    ranked = running(by, ["t"], {"below": "n"})
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return ranked.agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), wins / (F.sum("p") * F.sum("n"))).otherwise(F.lit(float("nan"))).alias("auc"))


def evaluate(texts: DataFrame, positive: str, text: str, model: Model) -> DataFrame:
    """One row of figures on texts that were held out."""
    own = texts.select(F.monotonically_increasing_id().alias("id"), F.col(positive).alias("p"), normalize(F.col(text)).alias("normal"))
    own = materialize(own.withColumn("words", words_of(F.col("normal"))), "eval")
    scores = materialize(raw_scores(own, ["id", "p", "words"], "normal", model.index(), model.n).select("p", "words", model.score(F.col("raw")).alias("score")), "scores")
    t = model.threshold
    short = F.sum((F.col("words") < model.min_words).cast("int"))
    right = F.sum((F.col("p") == (F.col("score") >= t)).cast("int"))
    n = F.count(F.lit(1))
    flat = scores.agg(F.coalesce(F.sum(F.col("p").cast("int")), F.lit(0)).alias("n_positive"), F.coalesce(F.sum((~F.col("p")).cast("int")), F.lit(0)).alias("n_negative"), F.round(F.lit(t), 4).alias("threshold"), F.round(F.coalesce(right / n, F.lit(0.0)), 4).alias("accuracy"), F.coalesce(short, F.lit(0)).alias("too_short"), F.round(F.coalesce(100 * short / n, F.lit(0.0)), 1).alias("too_short_pct"))
    mid = [nth(scores.where(cond), "score", upper_median()).agg(F.round(F.max("value"), 4).alias(name)) for cond, name in (("p", "median_positive"), ("not p", "median_negative"))]
    return flat.crossJoin(auc(scores).select(F.round("auc", 4).alias("auc"))).crossJoin(mid[0]).crossJoin(mid[1])
