"""A corpus of verse from training examples: prompts parsed, texts deduplicated, ids joined by fingerprint, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import batch
from ..functions.parsing import TASKS, USUL, parse_prompt
from ..storage import materialize

GROUPED = ("genre", "gharad", "region", "wazn_sub", "split")
FIELDS = ("gharad", "wazn_sub", "region", "poet", "uid", "title")


#: Words of verse, and lines that aren't blank.
_facts = F.arrow_udf(batch.verse_facts, ArrayType(IntegerType()))


def from_examples(examples: DataFrame) -> DataFrame:
    """Entries of (pos, split, prompt, text): one for each text, its metadata those of its first example, the modes of all.

    The group of a text is folded map-side; null texts are left out."""
    parsed = examples.where("text is not null").select("pos", "split", "text", parse_prompt(F.col("prompt")).alias("m")).where("m is not null")
    first = F.struct("m.genre", "m.genre_ar", "m.title", "m.gharad", "m.wazn_sub", "m.region", "split")
    own = parsed.groupBy("text").agg(F.min_by(first, "pos").alias("f"), F.array_sort(F.collect_set("m.mode")).alias("modes"))
    found = _facts(F.col("text"))
    return own.select("text", "f.*", F.col("f.genre").isin(*USUL).alias("is_usul"), F.lit(None).cast("string").alias("poet"), F.lit(None).cast("string").alias("uid"), found[1].alias("n_lines"), found[0].alias("n_words"), "modes")


def attach_uids(entries: DataFrame, index: DataFrame, fingerprint) -> DataFrame:
    """Entries with the uid of their fingerprint where they have none; of repeated fingerprints the last (by pos) counts.

    ``index``: (pos, fingerprint, uid); ``fingerprint``: text column to column."""
    last = index.where("fingerprint is not null and uid is not null").groupBy("fingerprint").agg(F.max_by("uid", "pos").alias("__uid"))
    own = entries.withColumn("fingerprint", fingerprint(F.col("text"))).join(last, "fingerprint", "left")
    return own.withColumn("uid", F.coalesce("uid", "__uid")).drop("fingerprint", "__uid")


def _vocabulary(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of verse, each of a slice once."""
    for rows in source:
        for texts in batch.slices(rows.column(0)):
            words = {w for t in texts for w in batch.verse_of(t or "").split()}
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["w"])


def corpus_report(entries: DataFrame) -> DataFrame:
    """(section, key, n, pct): totals, vocabulary (exact), coverage of fields, counts by genre and other fields.

    The entries are written once, as they are read three times; a task hands on each word of a few thousand once."""
    entries = materialize(entries.select("text", "n_words", "n_lines", *dict.fromkeys((*FIELDS, *GROUPED))), "entries")
    total = entries.agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), *[F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in FIELDS])
    vocabulary = entries.select("text").mapInArrow(_vocabulary, "w string").distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    flat = total.crossJoin(vocabulary)
    no = F.lit(None).cast("double")
    rows = [F.struct(F.lit("total").alias("section"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("n"), no.alias("pct")) for c in ("n_texts", "n_words", "n_lines", "vocabulary")]
    rows += [F.struct(F.lit("coverage").alias("section"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("n"), F.when(F.col("n_texts") > 0, F.round(100 * F.col(c) / F.col("n_texts"), 1)).otherwise(F.lit(0.0)).alias("pct")) for c in FIELDS]
    out = flat.select(F.inline(F.array(*rows)))
    long = entries.select(F.inline(F.array(*[F.struct(F.lit(f"by_{c}").alias("section"), F.col(c).alias("key")) for c in GROUPED]))).where("key is not null and key <> ''")
    return out.union(long.groupBy("section", "key").agg(F.count(F.lit(1)).alias("n")).select("section", "key", "n", no.alias("pct")))

COLUMNS = ("uid", "genre", "genre_ar", "is_usul", "gharad", "wazn_sub", "region", "poet", "title", "n_lines", "n_words", "modes", "split", "source", "text")
#: Genres by their Arabic names.
GENRES = {name: key for _, key, name in TASKS} | {"نثر": "prose"}


def from_markdown(tree: DataFrame) -> DataFrame:
    """Entries of a markdown tree (meta, title, text) whose heads name a genre: the complete source, with poets and ids."""
    m = lambda *keys: F.nullif(F.coalesce(*[F.try_element_at("meta", F.lit(k)) for k in keys]), F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in GENRES.items() for x in kv])
    own = tree.select("text", m("genre").alias("genre_ar"), F.coalesce(F.col("title"), m("title")).alias("title"), m("gharad").alias("gharad"), m("wazn_sub").alias("wazn_sub"), m("region").alias("region"), m("poet").alias("poet"), m("uid").alias("uid")).where("genre_ar is not null")
    own = own.withColumn("genre", F.coalesce(named[F.col("genre_ar")], F.col("genre_ar")))
    found = _facts(F.col("text"))
    return own.select("text", "genre", "genre_ar", "title", "gharad", "wazn_sub", "region", F.lit(None).cast("string").alias("split"), F.col("genre").isin(*USUL).alias("is_usul"), "poet", "uid", found[1].alias("n_lines"), found[0].alias("n_words"), F.array().cast("array<string>").alias("modes"))


def write_corpus(entries: DataFrame, out: str, source: str) -> None:
    """<out>/corpus.jsonl, <out>/corpus.csv and <out>/report.json (folders), entries sorted by genre, id and the text's beginning."""
    entries = materialize(entries, "entries")  # sampled, sorted and written twice, and reported
    own = entries.withColumn("source", F.lit(source)).select(*COLUMNS).sort("genre", F.coalesce("uid", F.lit("")), F.substring("text", 1, 40))
    own.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/corpus.jsonl")
    own.withColumn("modes", F.array_join("modes", "|")).write.mode("overwrite").options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{out}/corpus.csv", header=True)
    report_json(entries, source).coalesce(1).write.mode("overwrite").text(f"{out}/report.json")


def report_json(entries: DataFrame, source: str) -> DataFrame:
    """The corpus report as one JSON document."""
    found = corpus_report(entries)
    total = found.agg(*[F.max(F.when((F.col("section") == "total") & (F.col("key") == k), F.col("n"))).alias(k) for k in ("n_texts", "n_words", "n_lines", "vocabulary")])
    by = lambda part, cell: found.where(F.col("section") == part).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "key", cell.alias("v")))), lambda x: F.struct(x["key"], x["v"]))).alias(part))
    parts = [by("coverage", F.struct("n", "pct")), *[by(f"by_{c}", F.col("n")) for c in ("genre", "gharad", "region", "wazn_sub", "split")]]
    for p in parts:
        total = total.crossJoin(p)  # one row each
    return total.select(F.to_json(F.struct(F.lit(source).alias("source"), *total.columns)).alias("value"))
