"""The catalogue: a query for each operator over the test tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import markers as M
from ..functions import normalize as N
from ..functions import parsing as P
from ..functions import translit as T
from ..operators import blocks as B
from ..operators import classifier as K
from ..operators import corpus, poems, report, sampling, segments
from ..operators import triage as TR
from ..sources import readers, registry
from . import sqltext as S
from .views import AR_SQL, ARABIC, LATIN, REPLIES_SQL, WIKI_SQL, arabic, replies, table, wiki

def normal(view: DataFrame, text: str = "t") -> DataFrame:
    """The view with its standard normal form ``n`` as a column of its own."""
    return view.withColumn("n", N.normalize(F.col(text)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def mapped(name: str, f: Callable[[Column], Column], sql: str | None, view: str = "ar") -> None:
    """A query (id, out) of one column function over a view."""
    source, key, cte = {"ar": (arabic, "doc_id", AR_SQL), "docs": (lambda s, d: docs(s, d).withColumnRenamed("text", "t"), "doc_id", "v AS (SELECT *, text AS t FROM documents)"), "wiki": (wiki, "page_id", WIKI_SQL)}[view]
    query(None if sql is None else f"WITH {cte} SELECT {key}, {sql} AS out FROM v", name)(lambda spark, sf: source(spark, sf).select(key, f(F.col("t")).alias("out")))


# ---- normalisation and cleaning
mapped("strip_tatweel", N.strip_tatweel, "replace(t, chr(1600), '')")
mapped("strip_diacritics", N.strip_diacritics, rf"regexp_replace(t, '[{N.MARKS}]', '', 'g')")
mapped("unify_digits", N.unify_digits, f"translate(t, '{N.DIGITS_FROM}', '{N.DIGITS_TO}')")
mapped("unify_orthography", N.unify_orthography, S.letters("t"))
mapped("reduce_elongation", N.reduce_elongation, S.elongation("t"))
mapped("fold_arabizi", N.fold_for_arabizi, f"translate(t, '{N.FOLD_FROM}', '{N.FOLD_TO}')")
mapped("normalize_light", lambda t: N.normalize(t, "light"), S.squeeze(S.light("t")))
mapped("normalize_standard", N.normalize, S.norm("t"))
mapped("normalize_aggressive", lambda t: N.normalize(t, "aggressive"), S.only_arabic(S.elongation(S.letters(S.light("t")))))
mapped("poem_normalize", N.poem_normalize, S.squeeze(rf"regexp_replace({S.letters(rf'''regexp_replace(replace(t, chr(1600), ''), '[{N.MARKS}]', '', 'g')''')}, '[^\x{{0621}}-\x{{064A}}0-9 ]', ' ', 'g')"))
mapped("count_words", N.count_words, f"CAST({S.n_words(S.norm('t'))} AS INTEGER)")
mapped("arabic_ratio", lambda t: F.round(N.arabic_ratio(t), 6), r"round(CAST(len(regexp_extract_all(t, '[\x{0600}-\x{06FF}]')) AS DOUBLE) / len(regexp_replace(t, '\s', '', 'g')), 6)")
_NOISE = r"""regexp_replace(regexp_replace(t, '@[\p{L}\p{N}_]+|#\S+|https?://\S+|www\.\S+|\bRT\b', ' ', 'g'), '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}]+', ' ', 'g')"""
for _c in ".,!?;:-'\"()%#*$&|@+=/":
    _e = "\\" + _c if _c in ".?*$()|+" else _c.replace("'", "''")
    _NOISE = f"regexp_replace({_NOISE}, '{_e}{{3,}}', '{_c.replace(chr(39), chr(39) * 2)}', 'g')"
mapped("clean_social", C.clean_social, S.squeeze(_NOISE), "docs")
mapped("strip_label", lambda t: C.strip_label(F.concat(F.lit("-1;  "), t)), r"regexp_replace('-1;  ' || t, '^\s*-?[01]\s*[;,\t]\s*', '')", "docs")
mapped("strip_punctuation", C.strip_punctuation, S.strip_punctuation("t"))
mapped("strip_entities", C.strip_entities, None)
mapped("clean_training", C.clean_for_training, None)
for _name, _text in (("strip_entities", "t"), ("clean_training", S.strip_punctuation("t"))):
    SQL[_name] = f"WITH {AR_SQL}, {S.entities('v', 'doc_id', _text)} SELECT v.doc_id, coalesce(o, '') AS out FROM v LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) FILTER (entity IS NULL) AS o FROM en GROUP BY doc_id) USING (doc_id)"
mapped("adversarial_clean", lambda t: C.clean_reply(F.concat(t, F.lit(" 漢！\n user\nx"))), S.squeeze(r"""regexp_replace(string_split_regex(t || ' 漢！' || chr(10) || ' user' || chr(10) || 'x', '\n\s*(?:user|assistant|system)\b')[1], '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}A-Za-z0-9\s.,;:!?()\[\]\-–—«»"''/%+]', ' ', 'g')"""), "docs")
_wiki_sql = "t"
for _pattern, _to in C.WIKI_STEPS:
    _wiki_sql = f"regexp_replace({_wiki_sql}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_to.replace('$', chr(92))}', 'g')"
mapped("strip_wikitext", C.strip_wikitext, _wiki_sql, "wiki")
mapped("to_arabizi", T.to_arabizi, S.to_arabizi("t"))
mapped("arabizi_score", lambda t: F.round(T.arabizi_score(t), 6), f"round({S.arabizi('t')}, 6)", "docs")
mapped("is_arabizi", T.is_arabizi, f"({S.arabizi('t')}) >= 0.15", "docs")
mapped("marker_discriminant", lambda t: M.n_discriminant(N.normalize(t)), f"{S.n_discriminant(S.norm('t'))}")


@query(f"WITH {S.to_arabic('text', 'doc_id', 'documents')} SELECT doc_id, out FROM tr")
def to_arabic(spark, sf):
    return docs(spark, sf).select("doc_id", T.to_arabic(F.col("text")).alias("out"))


@query(f"WITH {S.to_arabic('text', 'doc_id', 'documents', 'ق')} SELECT doc_id, out FROM tr")
def to_arabic_qaf(spark, sf):
    return docs(spark, sf).select("doc_id", T.to_arabic(F.col("text"), g_as_qaf=True).alias("out"))


@query(f"WITH {S.prepared('documents', 'doc_id', 'text')} SELECT doc_id, t AS text, translit AS transliterated FROM pr")
def prepare(spark, sf):
    p = T.prepare(F.col("text"))
    return docs(spark, sf).select("doc_id", p["text"].alias("text"), p["transliterated"].alias("transliterated"))


_RATIO = f"WITH {AR_SQL}, c AS (SELECT doc_id, {S.count('t', S.AR)} AS a, {S.count('t', S.LA)} AS l, {S.count('t', S.ALNUM)} AS n FROM v), o AS (SELECT *, greatest(0, n - a - l) AS o FROM c) SELECT doc_id, round(a / (a + l + o), 6) AS arabic, round(l / (a + l + o), 6) AS latin, round(o / (a + l + o), 6) AS other FROM o"


@query(_RATIO)
def script_ratio(spark, sf):
    r = N.script_ratio(F.col("t"))
    return arabic(spark, sf).select("doc_id", *[F.round(r[k], 6).alias(k) for k in ("arabic", "latin", "other")])


@query(f"SELECT w AS n_words, count(*) AS n FROM (SELECT CAST({S.n_words(S.norm('text'))} AS INTEGER) AS w FROM documents) GROUP BY w")
def word_count_hist(spark, sf):
    return docs(spark, sf).select(N.count_words(F.col("text")).alias("n_words")).groupBy("n_words").agg(F.count(F.lit(1)).alias("n"))


_LINES_OF = f"{WIKI_SQL}, h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN translate(lower(t), '{LATIN}', '{ARABIC}') ELSE t END AS t FROM v), s AS (SELECT page_id, {_wiki_sql} AS t FROM h), l AS (SELECT page_id, unnest(range(len(string_split(t, chr(10))))) AS line_no, {S.squeeze('unnest(string_split(t, chr(10)))')} AS line FROM s)"


@query(rf"WITH {_LINES_OF} SELECT page_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE {S.n_words(S.norm('line'))} >= 5 AND len(regexp_extract_all(line, '[\x{{0600}}-\x{{06FF}}]')) >= 0.6::DOUBLE * len(regexp_replace(line, '\s', '', 'g'))")
def wiki_lines(spark, sf):
    """Every other page in Arabic letters: lines that are Arabic enough stay."""
    half = F.when(F.col("page_id") % 2 == 0, F.translate(F.lower("t"), LATIN, ARABIC)).otherwise(F.col("t"))
    return readers.wiki_lines(wiki(spark, sf).withColumn("t", half), "t", 5, keys=("page_id",))


@query(f"WITH {AR_SQL}, {S.entities('v', 'doc_id', 't')} SELECT entity, count(*) AS n FROM en WHERE entity IS NOT NULL GROUP BY entity")
def entity_counts(spark, sf):
    return corpus.entity_counts(arabic(spark, sf), "t")


# ---- segmentation
_RUN = r"(?:[\x{0600}-\x{06FF}\x{0750}-\x{077F}]+(?:[\s\x{064B}-\x{065F}]+[\x{0600}-\x{06FF}\x{0750}-\x{077F}]+)*|[A-Za-z\x{C0}-\x{FF}0-9'']+(?:[ \t]+[A-Za-z\x{C0}-\x{FF}0-9'']+)*|[^\s]+)"
_SEG = rf"""sx AS (SELECT CAST((floor((max(doc_id) - least(min(doc_id), 0)) / 1000000) + 1) * 1000000 AS BIGINT) AS step FROM documents),
sv AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + step, t || ' ' || text FROM (SELECT v.doc_id, v.t, d.text FROM v JOIN documents d USING (doc_id)), sx),
st AS (SELECT doc_id, unnest(k) AS run, unnest(range(len(k))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:{_RUN}|\s+)') AS k FROM sv)),
sp AS (SELECT *, coalesce(sum(len(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0,
  CASE WHEN regexp_matches(run, '^[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]') THEN 'arabic' WHEN regexp_matches(run, '^[A-Za-z\x{{C0}}-\x{{FF}}0-9'']') THEN 'latin' WHEN regexp_matches(run, '^\s') THEN 'white' ELSE 'other' END AS script FROM st),
sw AS (SELECT doc_id, i, off0, j, w, sum(len(w)) OVER (PARTITION BY doc_id, i ORDER BY j) - len(w) AS off FROM (SELECT doc_id, i, off0, unnest(k) AS w, unnest(range(len(k))) AS j FROM (SELECT doc_id, i, off0, regexp_extract_all(run, '(?:[A-Za-z\x{{C0}}-\x{{FF}}0-9'']+|[ \t]+)') AS k FROM sp WHERE script = 'latin'))),
sl AS (SELECT *, {S.label("trim(lower(w), '''')")} AS lab FROM sw WHERE j % 2 = 0),
sm AS (SELECT *, coalesce(last_value(lab IGNORE NULLS) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(lab IGNORE NULLS) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'unknown') AS lang FROM sl),
sg AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, i ORDER BY j) AS seg FROM (SELECT *, CASE WHEN lag(lang) OVER (PARTITION BY doc_id, i ORDER BY j) IS DISTINCT FROM lang THEN 1 ELSE 0 END AS new FROM sm)),
sb AS (SELECT doc_id, i, lang, any_value(off0) AS off0, min(off) AS a, max(off + len(w)) AS b, count(*) AS n FROM sg GROUP BY doc_id, i, seg, lang),
segs AS (SELECT sb.doc_id, substr(sp.run, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS text, 'latin' AS script, lang, CAST(sb.off0 + a AS INTEGER) AS start, CAST(sb.off0 + b AS INTEGER) AS "end", n FROM sb JOIN sp USING (doc_id, i)
  UNION ALL SELECT doc_id, run, script, CASE WHEN script = 'arabic' THEN 'ar' ELSE 'unknown' END, CAST(off0 AS INTEGER), CAST(off0 + len(run) AS INTEGER), CASE WHEN script = 'arabic' THEN len(list_filter(string_split_regex(run, '\s+'), lambda x: x <> '')) ELSE 1 END
  FROM sp WHERE script = 'arabic' OR (script = 'other' AND NOT regexp_full_match(run, '[\p{{P}}\p{{S}}\p{{Z}}]+')))"""


def _mixed(spark, sf):
    """Each document, and behind its whole Arabic view again; the second text's id is farther off than any two ids are apart, so that none clash."""
    own = docs(spark, sf).select("doc_id", "text")
    step = own.agg(((F.floor((F.max("doc_id") - F.least(F.min("doc_id"), F.lit(0))) / 1000000) + 1) * 1000000).alias("step"))
    both = arabic(spark, sf).select("doc_id", "t").join(own, "doc_id").crossJoin(F.broadcast(step)).select((F.col("doc_id") + F.col("step")).alias("doc_id"), F.concat("t", F.lit(" "), "text").alias("text"))
    return own.union(both)


@query(f'WITH {AR_SQL}, {_SEG} SELECT doc_id, text, script, lang, start, "end" FROM segs', "segments")
def segments_(spark, sf):
    return segments.segments(_mixed(spark, sf), "doc_id", "text")


_PROFILE = "lp AS (SELECT sv.doc_id, " + ", ".join(f"round(coalesce(sum(n) FILTER (lang = '{k}'), 0) / sum(n), 4) AS {k}" for k in segments.LANGS) + " FROM sv LEFT JOIN segs USING (doc_id) GROUP BY sv.doc_id)"


@query(f"WITH {AR_SQL}, {_SEG}, {_PROFILE} SELECT doc_id, " + ", ".join(f"coalesce({k}, 0.0) AS {k}" for k in segments.LANGS) + " FROM lp")
def lang_profile(spark, sf):
    p = segments.profile(F.col("text"))
    return _mixed(spark, sf).select("doc_id", *[p[k].alias(k) for k in segments.LANGS])


@query(f"WITH {AR_SQL}, {_SEG}, {_PROFILE} SELECT doc_id, " + " + ".join(f"CASE WHEN {k} >= 0.15 THEN 1 ELSE 0 END" for k in segments.LANGS) + " >= 2 AS out FROM lp")
def code_switched(spark, sf):
    return _mixed(spark, sf).select("doc_id", segments.is_code_switched(segments.profile(F.col("text"))).alias("out"))


@query(f"WITH {AR_SQL}, {_SEG} SELECT doc_id, string_agg(text, ' | ' ORDER BY start) AS fragments FROM segs WHERE lang = 'fr' GROUP BY doc_id")
def extract_fr(spark, sf):
    return segments.extract(_mixed(spark, sf), "doc_id", "text", "fr").select("doc_id", F.array_join("fragments", " | ").alias("fragments"))


# ---- markers
_COUNTS = f"WITH {AR_SQL}, n AS (SELECT doc_id, {S.norm('t')} AS n FROM v), m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS marker, '{M.MARKERS[k][1]}' AS category, CAST({S.marker('n', k)} AS INTEGER) AS n FROM n" for k in M.MARKERS) + ") "


@query(_COUNTS + "SELECT * FROM m WHERE n > 0")
def marker_counts(spark, sf):
    return normal(arabic(spark, sf)).select("doc_id", F.inline(M.counts(F.col("n")))).where("n > 0")


@query(_COUNTS + "SELECT marker, category, CAST(sum(n) AS BIGINT) AS n FROM m WHERE n > 0 GROUP BY marker, category")
def marker_profile(spark, sf):
    return marker_counts(spark, sf).groupBy("marker", "category").agg(F.sum("n").alias("n"))


@query(_COUNTS + f"SELECT m.doc_id, marker, round(10000 * m.n / w, 2) AS rate FROM m JOIN (SELECT doc_id, {S.n_words('n')} AS w FROM n) USING (doc_id) WHERE m.n > 0")
def marker_rates(spark, sf):
    return normal(arabic(spark, sf)).select("doc_id", F.inline(M.rates(F.col("n"))))


@query(_COUNTS + "SELECT doc_id, marker, n, CASE marker WHEN 'quant_barsha' THEN 'كثير' WHEN 'ok_yakhi' THEN 'isn''t it' WHEN 'future_bash' THEN 'علامة الاستقبال' ELSE '-' END AS label, CASE category WHEN 'function word' THEN 'function word' WHEN 'lexicon' THEN 'معجم' ELSE 'صرف' END AS category_label, marker NOT IN ('n_prefix_1sg', 'relativizer_elli', 'interrog_3lach') AS decides FROM m WHERE n > 0")
def marker_labels(spark, sf):
    """Markers with what a report shows of them; of the labels those of three markers, one of which has none and falls back."""
    own = M.describe(marker_counts(spark, sf))
    return own.select("doc_id", "marker", "n", F.when(F.col("marker").isin("quant_barsha", "ok_yakhi", "future_bash"), F.col("label")).otherwise("-").alias("label"), "category_label", "decides")


def found(spark, sf) -> DataFrame:
    """(doc_id, found, words): generated as rows and gathered within the row's task, so that no expression repeats the scan."""
    own = normal(arabic(spark, sf)).select("doc_id", F.explode(F.array(M.counts(F.col("n")))).alias("found"), N.words_of(F.col("n")).alias("words"))
    return own


def _score_sql(modern: bool) -> str:
    own = f"count(*) FILTER (m.n > 0 AND marker IN ({S.strings(sorted(M.MODERN))}))" if modern else "count(*) FILTER (m.n > 0)"
    return _COUNTS + f"SELECT doc_id, CASE WHEN k = 0 OR w = 0 THEN 0.0 ELSE round(0.7::DOUBLE * least(1.0, k / 5.0) + 0.3::DOUBLE * least(1.0::DOUBLE, h / greatest(1.0::DOUBLE, w / 20.0)), 4) END AS score FROM (SELECT m.doc_id, {own} AS k, sum(m.n) AS h, any_value({S.n_words('n.n')}) AS w FROM m JOIN n USING (doc_id) GROUP BY m.doc_id)"


@query(_score_sql(False))
def marker_score(spark, sf):
    return found(spark, sf).select("doc_id", M.score(F.col("found"), F.col("words")).alias("score"))


@query(_score_sql(True))
def marker_score_modern(spark, sf):
    return found(spark, sf).select("doc_id", M.score(F.col("found"), F.col("words"), modern=True).alias("score"))


@query()
def marker_hits(spark, sf):
    """Places come from splitting by patterns with lookarounds: held against Python's re in tests."""
    return M.find(arabic(spark, sf).select("doc_id", N.normalize(F.col("t")).alias("n")), "doc_id", "n")


@query()
def marker_explain(spark, sf):
    return found(spark, sf).select("doc_id", M.explain(F.col("found"), F.col("words")).alias("explanation"))


@query()
def detect_report(spark, sf):
    """All that one text tells, in one row."""
    t = F.col("text")
    r, p = N.script_ratio(t), segments.profile(t)
    return normal(_mixed(spark, sf), "text").select("doc_id", *[F.round(r[k], 6).alias(k) for k in ("arabic", "latin", "other")], F.round(T.arabizi_score(t), 6).alias("arabizi_score"), *[p[k].alias(f"lang_{k}") for k in segments.LANGS], F.to_json(M.rates(F.col("n"))).alias("rates"))
