"""Morphological and lexical markers: a dictionary of patterns on text in standard normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import batch

_B, _E = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
#: name, pattern between word ends, category, meaning
_TABLE = """
n_prefix_1sg|ن[%s]{2,}|morphology|first person prefix
negation_ma_sh|ما\\s?\\S{1,12}ش|morphology|circumfix of negation
future_bash|باش|morphology|future particle
progressive_qaed|قاعد\\S*|morphology|progressive
relativizer_elli|اللي|function word|relative
interrog_chnowa|شنو[هاي]?|function word|what
interrog_3lach|علاش|function word|why
interrog_9adech|قداش|function word|how much
interrog_kifach|كيفاش|function word|how
interrog_win|وين|function word|where
interrog_waqtech|وقتاش|function word|when
existential_famma|فم[اه]|function word|there is
now_tawa|تو[ا]?|function word|now
quant_barsha|برش[اه]|lexicon|a lot
num_zouz|زوز|lexicon|two
adj_behi|باهي|lexicon|good
enough_yezzi|يزي|lexicon|enough
little_chwaya|شوي[اه]|lexicon|a little
ok_yakhi|ياخي|lexicon|isn't it
""".replace("%s", _LETTERS)
MARKERS = {name: (pattern, category, gloss) for name, pattern, category, gloss in (x.split("|") for x in _TABLE.strip().split("\n"))}
MODERN = frozenset({"quant_barsha", "interrog_chnowa", "adj_behi", "ok_yakhi", "enough_yezzi"})
#: Those whose presence tells this dialect from its neighbours; the others explain, they don't decide.
DISCRIMINANT = frozenset(MARKERS) - {"n_prefix_1sg", "relativizer_elli", "interrog_3lach"}


#: What a marker is in Arabic, for readers of a report; one without is shown by its meaning.
LABELS = {
    "negation_ma_sh": "نفي بما وشين", "future_bash": "علامة الاستقبال", "progressive_qaed": "علامة الاستمرار", "relativizer_elli": "اسم موصول", "interrog_chnowa": "استفهام عن الشيء",
    "interrog_3lach": "استفهام عن السبب", "interrog_9adech": "استفهام عن المقدار", "interrog_kifach": "استفهام عن الحال", "interrog_win": "استفهام عن المكان", "interrog_waqtech": "استفهام عن الزمن",
    "now_tawa": "الآن", "quant_barsha": "كثير", "num_zouz": "اثنان", "adj_behi": "حسن", "little_chwaya": "قليل",
}
CATEGORY_LABELS = {"morphology": "صرف", "lexicon": "معجم"}


def pattern(name: str) -> str:
    return _B + MARKERS[name][0] + _E


def marker_table(spark: SparkSession) -> DataFrame:
    rows = [(n, p, c, g, n in DISCRIMINANT, n in MODERN) for n, (p, c, g) in MARKERS.items()]
    return spark.createDataFrame(rows, "marker string, pattern string, category string, gloss string, discriminant boolean, modern boolean")


def describe(hits: DataFrame) -> DataFrame:
    """The rows (marker, category, ...) with gloss, whether the marker decides, and Arabic labels where there are any, else gloss and category."""
    spark = hits.sparkSession
    known = spark.createDataFrame([(n, g, n in DISCRIMINANT, LABELS.get(n)) for n, (_, _, g) in MARKERS.items()], "marker string, gloss string, decides boolean, label string")
    kinds = spark.createDataFrame(list(CATEGORY_LABELS.items()), "category string, category_label string")
    out = hits.join(F.broadcast(known), "marker", "left").join(F.broadcast(kinds), "category", "left")
    return out.withColumns({"label": F.coalesce("label", "gloss", "marker"), "category_label": F.coalesce("category_label", "category")}).select(*hits.columns, "gloss", "decides", "label", "category_label")


_facts = F.arrow_udf(batch.marker_facts, ArrayType(IntegerType()))


def counts(normal: Column) -> Column:
    """array<struct<marker, category, n>> of the markers that occur; for text in standard normal form."""
    own = [F.struct(F.lit(n).alias("marker"), F.lit(MARKERS[n][1]).alias("category"), _facts(normal)[i].alias("n")) for i, n in enumerate(MARKERS)]
    return F.filter(F.array(*own), lambda x: x["n"] > 0)


def n_discriminant(normal: Column) -> Column:
    """How many markers that decide occur."""
    return sum(((_facts(normal)[i] > 0).cast("int") for i, n in enumerate(MARKERS) if n in DISCRIMINANT), F.lit(0))


def rates(normal: Column, per: int = 10_000) -> Column:
    """array<struct<marker, rate>> per so many words; [] without words."""
    words = _facts(normal)[len(MARKERS)]
    own = [F.struct(F.lit(n).alias("marker"), F.round(per * _facts(normal)[i] / words, 2).alias("rate"), _facts(normal)[i].alias("n")) for i, n in enumerate(MARKERS)]
    found = F.filter(F.array(*own), lambda x: x["n"] > 0)
    return F.when(words > 0, F.transform(found, lambda x: F.struct(x["marker"].alias("marker"), x["rate"].alias("rate")))).otherwise(F.array().cast("array<struct<marker:string,rate:double>>"))


def score(found: Column, n_words: Column, modern: bool = False) -> Column:
    """Diversity and density of ``counts``; ``modern`` restricts diversity only."""
    own = F.filter(found, lambda x: x["marker"].isin(*sorted(MODERN))) if modern else found
    hits = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
    value = 0.7 * F.least(F.lit(1.0), F.size(own) / 5.0) + 0.3 * F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), n_words / 20.0))
    return F.when((F.size(own) == 0) | (n_words == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))


def explain(found: Column, n_words: Column) -> Column:
    """Readable report, most frequent first."""
    hits = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
    gloss = F.create_map(*[F.lit(x) for n in MARKERS for x in (n, MARKERS[n][2])])
    rows = F.array_sort(F.transform(found, lambda x: F.struct((-x["n"]).alias("k"), x["marker"].alias("marker"), x["category"].alias("category"))))
    lines = F.transform(rows, lambda x: F.format_string("  %-22s x%-3d [%s] %s", x["marker"], -x["k"], x["category"], gloss[x["marker"]]))
    head = F.format_string("score=%.3f  (%d hits, %d distinct markers)", score(found, n_words), hits, F.size(found))
    return F.when(F.size(found) == 0, F.lit("no marker found")).otherwise(F.array_join(F.concat(F.array(head), lines), "\n"))


def find(docs: DataFrame, id_col: str, normal_col: str) -> DataFrame:
    """(id, marker, category, start, text): every hit, with the place in the normal form; one shuffle, of hits only."""
    per = [F.struct(F.lit(n).alias("marker"), F.lit(MARKERS[n][1]).alias("category"), F.lit(k).alias("rank"), F.split(F.col(normal_col), pattern(n)).alias("between"), F.regexp_extract_all(F.col(normal_col), F.lit(pattern(n)), F.lit(0)).alias("hits")) for k, n in enumerate(MARKERS)]
    long = docs.select(id_col, F.inline(F.array(*per))).where("size(hits) > 0")
    # lengths of what precedes: a running sum inside the row
    sizes = F.transform(F.sequence(F.lit(1), F.size("hits")), lambda i: F.length(F.element_at("between", i)) + F.when(i > 1, F.length(F.element_at("hits", F.greatest(i - 1, F.lit(1))))).otherwise(0))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    zipped = F.arrays_zip(ends.alias("start"), F.col("hits").alias("text"))
    return long.select(id_col, "marker", "category", F.inline(zipped)).toDF(id_col, "marker", "category", "start", "text")
