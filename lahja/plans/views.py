"""Views over the test tables that drive code paths which their texts alone would not reach; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابكدهفڨحيجكلمنوبقرستوڥوخيز"
PHRASES = [
    "مـــاذا مِن تُونس", "شنوة أحوالك برشا اللي ماناكلش باش نمشي", "ما تبعدش على الدار برشة باهي", "يا لطفي!! في تونس التونسيين بتونس", "برشاااااا هههههه", "عام ٢٠٢٤ و ۱۲ ڨلب ڥيديو",
    "ما شاء الله كان وما ذلك الا بعد حين", "توا قداش كيفاش وين وقتاش فما زوز يزي شوية ياخي قاعد علاش شنو",
]
WIKI_HEAD, WIKI_TAIL = "{{a {{b}} c}} [[File:x.png|t]] [[p|q]] [[plain]] [http://e l] [https://e.org] <ref name=x/> <ref>y</ref> ", "\n== H ==\n* item '''bold'''\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one that has fewer splits than the cluster has cores (a file of one row group) is spread first, as text functions are bound by CPU."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def arabic(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, source, t): each document in Arabic letters, behind one of eight phrases."""
    docs = table(spark, sf, "documents")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.select("doc_id", "lang", "source", F.concat(phrase, F.lit(" "), F.translate(F.lower("text"), LATIN, ARABIC)).alias("t"))


AR_SQL = f"v AS (SELECT doc_id, lang, source, ([{', '.join(repr(p) for p in PHRASES)}])[doc_id % 8 + 1] || ' ' || translate(lower(text), '{LATIN}', '{ARABIC}') AS t FROM documents)"


def wiki(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit(WIKI_HEAD), F.col("html"), F.lit(WIKI_TAIL)).alias("t"))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


WIKI_SQL = f"v AS (SELECT page_id, {_sql(WIKI_HEAD)} || html || {_sql(WIKI_TAIL)} AS t FROM pages)"


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """(pos, prompt_id, model, condition, script, category, reply, error): all replies of each conversation, in pairs of a first and a second one.

    The first pair has the conversation's id as its prompt, the pair k after it id-k. Positions follow conversation and turn."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    own = turns.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    step = turns.groupBy("conv_id").count().agg(F.greatest(F.lit(2), F.max("count")).alias("step"))
    own = own.crossJoin(F.broadcast(step)).withColumn("pair", F.floor((F.col("r") + 1) / 2).cast("int"))
    c = F.col("conv_id")
    prompt = F.when(F.col("pair") == 1, c.cast("string")).otherwise(F.concat_ws("-", c.cast("string"), F.col("pair").cast("string")))
    return own.select((c * F.col("step") + F.col("r")).alias("pos"), prompt.alias("prompt_id"), F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"), F.when(F.col("r") % 2 == 1, "implicite").otherwise("explicite").alias("condition"), F.when(c % 5 == 0, "arabizi").otherwise("arabe").alias("script"), F.concat(F.lit("c"), (c % 7).cast("string")).alias("category"), F.col("text").alias("reply"), F.when(c % 17 == 0, F.lit("429 refused")).alias("error"))


REPLIES_SQL = """r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant'),
r1 AS (SELECT *, (r + 1) // 2 AS pair, (SELECT greatest(2, max(r)) FROM r0) AS step FROM r0),
replies AS (SELECT conv_id * step + r AS pos, CASE WHEN pair = 1 THEN CAST(conv_id AS VARCHAR) ELSE conv_id || '-' || pair END AS prompt_id, 'm' || (conv_id % 3) AS model, CASE WHEN r % 2 = 1 THEN 'implicite' ELSE 'explicite' END AS condition,
  CASE WHEN conv_id % 5 = 0 THEN 'arabizi' ELSE 'arabe' END AS script, 'c' || (conv_id % 7) AS category, text AS reply, CASE WHEN conv_id % 17 = 0 THEN '429 refused' END AS error FROM r1)"""
