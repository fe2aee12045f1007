"""Registries: corpora with role and licence, contrasts between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
_LINTO = "Derja_tunsi TunBERT TuDiCOI Tweet_TN TunSwitchTunisiaOnly TunSwitchCodeSwitching BRAD Chakhabitt CombinedNames HkayetTounsia KisatiAna Lbachch T-HSAB TN_RAP_lyrics TRCD TunHistoires Tunisien_Dialect_Summary-llama2"
_RAW = "https://raw.githubusercontent.com/"
#: key: role, kind, locator, cap in bytes, licence, sub-corpora
SOURCES: dict[str, dict] = {
    k: {"key": k, "role": role, "kind": kind, "locator": locator, "max_bytes": cap, "license": licence, "include": [f"{x}/" for x in include.split()]}
    for k, role, kind, locator, cap, licence, include in [
        ("ar", "negative", "wikipedia", "ar", 183 * MB, "CC BY-SA 4.0", ""),
        ("ar_source", "negative", "wikipedia", "arwikisource", 60 * MB, "public domain / CC BY-SA 4.0", ""),
        ("arbml_tn", "positive", "hf", "arbml/Tunisian_Dialect_Corpus", None, None, ""),
        ("ary", "negative", "wikipedia", "ary", None, "CC BY-SA 4.0", ""),
        ("arz", "negative", "wikipedia", "arz", 294 * MB, "CC BY-SA 4.0", ""),
        ("dz", "negative", "url", _RAW + "kinmokusu/oea_algd/master/data/dataset/data.csv", None, None, ""),
        ("linto", "positive", "hf", "data/archives/linto", None, "CC BY-SA 4.0", _LINTO),
        ("llm_fusha", "negative", "local", "generated replies, training prompts", None, "model output", ""),
        ("llm_fusha_val", "negative", "local", "generated replies, held-out prompts", None, "model output", ""),
        ("mac", "negative", "url", _RAW + "LeMGarouani/MAC/main/MAC%20corpus.csv", None, None, ""),
        ("mar_latin", "negative", "hf", "ilias-brh/english-arabizi-sentence-pairs", None, "CC BY-NC-SA 4.0", ""),
        ("omcd", "negative", "url", " ".join(f"{_RAW}kabilessefar/OMCD-Offensive-Moroccan-Comments-Dataset/main/{x}.csv" for x in ("train", "test")), None, None, ""),
        ("tsac", "positive", "url", " ".join(f"{_RAW}fbougares/TSAC/master/{a}_{b}.txt" for a in ("train", "test") for b in ("pos", "neg")), None, "LGPL-3.0", ""),
        ("tunizi", "positive", "url", _RAW + "chaymafourati/TUNIZI-Sentiment-Analysis-Tunisian-Arabizi-Dataset/master/TUNIZI-Dataset.txt", None, None, ""),
    ]
}
_ALL, _ARABIC = "arbml_tn linto tsac tunizi", "arbml_tn linto tsac"
#: name: negatives, positives (empty: all), flags g(enre controlled) a(rabic only) l(atin only) f(old) s(trip entities)
CONTRASTS: dict[str, dict] = {
    name: {"name": name, "negatives": neg.split(), "positives": pos.split() or None, "genre_controlled": "g" in flags, "arabic_only": "a" in flags, "latin_only": "l" in flags, "fold_arabizi": "f" in flags, "strip_entities": "s" in flags, "shares": {}}
    for name, neg, pos, flags in [
        ("vs_algerian", "dz", _ALL, "gas"), ("vs_all", "ar ary arz dz mac omcd", "", ""), ("vs_egyptian", "arz", "", ""), ("vs_maghreb", "ary dz mac omcd", _ALL, "gas"),
        ("vs_maghreb_arabizi", "ary dz mac omcd", _ARABIC, "gasf"), ("vs_maghreb_llm", "ary dz llm_fusha mac omcd", _ALL, "gas"), ("vs_maghrebi", "ary", "", ""),
        ("vs_moroccan_latin", "mar_latin", "tunizi", "ls"), ("vs_moroccan_tw", "mac", _ALL, "gas"), ("vs_moroccan_yt", "omcd", _ALL, "gas"), ("vs_msa", "ar", "", ""),
    ]
}


def project_name(locator: Column) -> Column:
    return F.when(locator.contains("wik"), locator).otherwise(F.concat(locator, F.lit("wiki")))


def sources(spark: SparkSession) -> DataFrame:
    rows = [(s["key"], s["role"], s["kind"], s["locator"], s["max_bytes"], s["license"], s["include"]) for s in SOURCES.values()]
    return spark.createDataFrame(rows, "key string, role string, kind string, locator string, max_bytes bigint, license string, include array<string>")


def by_role(registry: DataFrame, role: str) -> DataFrame:
    return registry.where(F.col("role") == role)


def unlicensed(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("license", F.lit("")) == "")


def budget(registry: DataFrame) -> DataFrame:
    """(key, mb, uncapped): caps in MB, a row for each source; the total is a row of null key."""
    cap = F.coalesce("max_bytes", F.lit(0))
    own = registry.select("key", F.round(cap / MB, 1).alias("mb"), (cap == 0).alias("uncapped"))
    total = registry.agg(F.lit(None).cast("string").alias("key"), F.round(F.sum(cap) / MB, 1).alias("mb"), F.lit(False).alias("uncapped"))
    return own.union(total)


def contrasts(spark: SparkSession) -> DataFrame:
    """(contrast, class, source, share, genre_controlled): one row for each source of a contrast's class."""
    every = [k for k, s in SOURCES.items() if s["role"] == "positive"]
    rows = [(c["name"], cls, k, float(c["shares"].get(k, 0.5)), c["genre_controlled"]) for c in CONTRASTS.values() for cls, keys in (("positive", c["positives"] or every), ("negative", c["negatives"])) for k in keys]
    return spark.createDataFrame(rows, "contrast string, class string, source string, share double, genre_controlled boolean")


def buildable(contrast_sources: DataFrame, cached: DataFrame) -> DataFrame:
    """(contrast, buildable): both classes have a cached source. ``cached`` has a column source."""
    have = contrast_sources.join(cached.select("source").distinct().withColumn("have", F.lit(1)), "source", "left")
    found = have.groupBy("contrast", "genre_controlled").agg(F.max(F.when(F.col("class") == "positive", F.col("have"))).alias("p"), F.max(F.when(F.col("class") == "negative", F.col("have"))).alias("n"))
    return found.select("contrast", "genre_controlled", (F.col("p").isNotNull() & F.col("n").isNotNull()).alias("buildable"))


def inventory(spark: SparkSession, cached: DataFrame) -> DataFrame:
    """(kind, name, role, lines, genre_controlled): cached sources with their lines, and the contrasts that can be built of them.

    ``cached``: (key, lines), as ``readers.cached`` gives it."""
    have = cached.select(F.col("key").alias("source"), "lines").join(sources(spark).select(F.col("key").alias("source"), "role"), "source", "left")
    own = have.select(F.lit("source").alias("kind"), F.col("source").alias("name"), "role", "lines", F.lit(None).cast("boolean").alias("genre_controlled"))
    built = buildable(contrasts(spark), have).where("buildable")
    return own.union(built.select(F.lit("contrast"), F.col("contrast"), F.lit(None).cast("string"), F.lit(None).cast("bigint"), "genre_controlled"))
