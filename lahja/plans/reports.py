"""Queries over the classifier, blocks, corpora, replies, triage, registries and verse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import parsing as P
from ..operators import blocks as B
from ..operators import classifier as K
from ..operators import corpus, poems, report, sampling
from ..operators import triage as TR
from ..sources import readers, registry
from . import sqltext as S
from .queries import docs, query
from .views import REPLIES_SQL, arabic, replies, table

M = f"WITH {S.MODEL} "


def classes(spark, sf):
    return docs(spark, sf).where("lang in ('fr', 'es')").select("doc_id", "source", (F.col("lang") == "fr").alias("p"), "text")


_MODELS: dict[tuple[str, str], K.Model] = {}


def trained(spark, sf) -> K.Model:
    return K.train(classes(spark, sf), "p", "text", ("fr", "es"))


def model(spark, sf) -> K.Model:
    """One model for each corpus and session: queries that score share it; ``eval_report`` and ``llr_weights`` train."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = trained(spark, sf)
    return _MODELS[key]


def class_scores(spark, sf):
    own = classes(spark, sf)
    return K.score_texts(own, ["doc_id", "p"], "text", model(spark, sf))


# ---- classifier
@query(M + "SELECT gram, CAST(cp AS BIGINT) AS cp, CAST(cn AS BIGINT) AS cn FROM mk")
def char_ngram_counts(spark, sf):
    return K.gram_counts(classes(spark, sf).select("p", N.normalize(F.col("text")).alias("n")), "p", "n")


@query(M + "SELECT gram, CAST(cp AS BIGINT) AS cp, CAST(cn AS BIGINT) AS cn, w FROM mw")
def llr_weights(spark, sf):
    return K.llr_weights(classes(spark, sf).select("p", N.normalize(F.col("text")).alias("n")), "p", "n")


@query(M + "SELECT gram, w FROM mw ORDER BY abs(w) * ln(1.0::DOUBLE + cp + cn) DESC, gram LIMIT 5000")
def top_features(spark, sf):
    """The 5,000 features that tell most, the cut being the feature."""
    own = classes(spark, sf).select("p", N.normalize(F.col("text")).alias("n"))
    return K.llr_weights(own, "p", "n", max_features=5000).select("gram", "w")


@query(M + "SELECT doc_id, p, round(score, 6) AS score FROM ms")
def llr_doc_scores(spark, sf):
    return class_scores(spark, sf).select("doc_id", "p", F.round("score", 6).alias("score"))


@query(M + "SELECT round(threshold, 6) AS threshold, round(j, 6) AS j FROM mt")
def youden_threshold(spark, sf):
    return K.youden(class_scores(spark, sf)).select(F.round("threshold", 6).alias("threshold"), F.round("j", 6).alias("j"))


@query(M + "SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT score, sum(CAST(p AS INT)) AS p, sum(CAST(NOT p AS INT)) AS n, coalesce(sum(sum(CAST(NOT p AS INT))) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ms GROUP BY score)")
def roc_auc(spark, sf):
    return K.auc(class_scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


_EV = f"""{M}, ew AS (SELECT doc_id, {S.n_words('t')} AS words FROM mn), es AS (SELECT ms.*, words, threshold FROM ms JOIN ew USING (doc_id), mt),
er AS (SELECT p, score, row_number() OVER (PARTITION BY p ORDER BY score) AS i, count(*) OVER (PARTITION BY p) AS n FROM es)
SELECT CAST(count(*) FILTER (p) AS BIGINT) AS n_positive, CAST(count(*) FILTER (NOT p) AS BIGINT) AS n_negative, round(any_value(threshold), 4) AS threshold, round(avg(CAST(p = (score >= threshold) AS DOUBLE)), 4) AS accuracy,
  CAST(count(*) FILTER (words < 25) AS BIGINT) AS too_short, round(100.0 * count(*) FILTER (words < 25) / count(*), 1) AS too_short_pct, (SELECT round(max(score), 4) FROM er WHERE p AND i = n // 2 + 1) AS median_positive, (SELECT round(max(score), 4) FROM er WHERE NOT p AND i = n // 2 + 1) AS median_negative,
  (SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 4) FROM (SELECT score, sum(CAST(p AS INT)) AS p, sum(CAST(NOT p AS INT)) AS n, coalesce(sum(sum(CAST(NOT p AS INT))) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM es GROUP BY score)) AS auc FROM es"""


@query(_EV)
def eval_report(spark, sf):
    return K.evaluate(classes(spark, sf), "p", "text", trained(spark, sf))


@query(f"{M}, pw AS (SELECT doc_id, {S.n_words('t')} AS n_words FROM mn) SELECT doc_id, CASE WHEN n_words < 25 THEN NULL WHEN score >= threshold THEN 'fr' ELSE 'es' END AS label, round(CASE WHEN n_words < 25 THEN NULL WHEN score >= threshold THEN 0.5::DOUBLE + 0.5::DOUBLE * (score - threshold) / greatest(1e-9::DOUBLE, 1.0::DOUBLE - threshold) ELSE 0.5::DOUBLE + 0.5::DOUBLE * (threshold - score) / greatest(1e-9::DOUBLE, threshold) END, 6) AS confidence FROM ms JOIN pw USING (doc_id), mt")
def predict_labels(spark, sf):
    m = model(spark, sf)
    own = classes(spark, sf).select("doc_id", N.normalize(F.col("text")).alias("n")).withColumn("w", N.words_of(F.col("n")))
    raw = K.raw_scores(own, ["doc_id", "w"], "n", m.weights)
    r = K.predict(m.score(F.col("raw")), F.col("w"), m)
    return raw.select("doc_id", r.alias("r")).select("doc_id", "r.label", F.round("r.confidence", 6).alias("confidence"))


# ---- blocks and corpora
_CHUNK = f"""cl AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS li FROM documents),
cn AS (SELECT source, doc_id, li, line, n, row_number() OVER (PARTITION BY source ORDER BY doc_id, li) AS i FROM (SELECT *, {S.n_words(S.norm('line'))} AS n FROM cl) WHERE n > 0),
cr AS (SELECT source, i, n AS cum, 0 AS block FROM cn WHERE i = 1 UNION ALL SELECT p.source, p.i, CASE WHEN r.cum >= 60 THEN p.n ELSE r.cum + p.n END, CASE WHEN r.cum >= 60 THEN r.block + 1 ELSE r.block END FROM cr r JOIN cn p ON p.source = r.source AND p.i = r.i + 1),
ck AS (SELECT source, CAST(block AS BIGINT) AS block, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_words, string_agg(line, chr(10) ORDER BY i) AS text FROM cr JOIN cn USING (source, i) GROUP BY source, block HAVING sum(n) >= 30)"""


def lines(spark, sf, where: str = "true"):
    own = docs(spark, sf).where(where)
    return own.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line"))


@query(f"WITH RECURSIVE {_CHUNK} SELECT * FROM ck")
def chunk_blocks(spark, sf):
    return B.chunk_lines(lines(spark, sf), "source", ["doc_id", "li"], "line").drop("first")


@query(f"WITH RECURSIVE {S.blocks('documents', 'doc_id', 'text')} SELECT doc_id, CAST(block AS INTEGER) AS block, t AS text FROM bl")
def doc_blocks(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(B.document_blocks(F.col("text"))).alias("block", "text"))


_GROUP = f"""gd AS (SELECT source, doc_id, text, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM (SELECT *, len({S.words('text')}) AS n FROM documents) WHERE n > 0),
gr AS (SELECT source, i, n AS cum, 0 AS block FROM gd WHERE i = 1 UNION ALL SELECT p.source, p.i, CASE WHEN r.cum >= 500 THEN p.n ELSE r.cum + p.n END, CASE WHEN r.cum >= 500 THEN r.block + 1 ELSE r.block END FROM gr r JOIN gd p ON p.source = r.source AND p.i = r.i + 1)
SELECT source, CAST(block AS BIGINT) AS block, min(doc_id) || '+' || count(*) AS unit, CAST(sum(n) AS BIGINT) AS n_words, string_agg(text, chr(10) ORDER BY i) AS text FROM gr JOIN gd USING (source, i) GROUP BY source, block HAVING sum(n) >= 250"""


@query(f"WITH RECURSIVE {_GROUP}")
def group_documents(spark, sf):
    return B.group_documents(docs(spark, sf), "source", "doc_id", "text", 500)


def block_scores(spark, sf, m):
    own = B.chunk_lines(lines(spark, sf), "source", ["doc_id", "li"], "line")
    return K.score_texts(own, ["source", "block"], "text", m)


@query(f"WITH RECURSIVE {S.MODEL}, {_CHUNK}, {S.scores('ck', 'source, block', 'text')} SELECT source, count(*) AS n, round(median(score), 4) AS median, round(avg(CAST(score >= threshold AS DOUBLE)), 4) AS above_threshold FROM sc, mt GROUP BY source")
def score_by_source(spark, sf):
    m = model(spark, sf)
    return report.score_by_source(block_scores(spark, sf, m), m.threshold, limit=None)


@query(f"WITH RECURSIVE {S.MODEL}, {_CHUNK}, {S.scores('ck', 'source, block', 'text')} SELECT source AS worst, above_threshold, above_threshold >= 0.9 AS passes FROM (SELECT source, round(avg(CAST(score >= threshold AS DOUBLE)), 4) AS above_threshold FROM sc, mt WHERE source IN (SELECT source FROM documents WHERE lang = 'fr' AND len(source) > 4) GROUP BY source) ORDER BY above_threshold, source LIMIT 1")
def worst_source(spark, sf):
    """Of the sources with two digits that have French documents: the others play the negatives, which are not asked about."""
    return report.worst_source(score_by_source(spark, sf), docs(spark, sf).where("lang = 'fr' and length(source) > 4"))


@query(f"WITH RECURSIVE {S.MODEL}, {_CHUNK}, {S.scores('ck', 'source, block', 'text')} SELECT source, count(*) AS n, round(median(score), 4) AS median, round(avg(CAST(score >= threshold AS DOUBLE)), 4) AS above_threshold FROM sc, mt WHERE block < 7 GROUP BY source")
def first_blocks_by_source(spark, sf):
    """The evaluation's own bound on blocks of a source, small enough to act."""
    m = model(spark, sf)
    return report.score_by_source(block_scores(spark, sf, m), m.threshold, limit=7)


@query("SELECT doc_id, lang, rank, CASE WHEN rank <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def holdout_split(spark, sf):
    return sampling.holdout_split(docs(spark, sf).select("doc_id", "lang"), "doc_id", by="lang")


@query("WITH s AS (SELECT doc_id, lang, rank, CASE WHEN rank <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('fr', 'es'))) SELECT * FROM s WHERE split = 'test' OR rank <= (SELECT min(c) FROM (SELECT count(*) AS c FROM s WHERE split = 'train' GROUP BY lang))")
def balanced_classes(spark, sf):
    return sampling.balance(sampling.holdout_split(docs(spark, sf).where("lang in ('fr', 'es')").select("doc_id", "lang"), "doc_id", by="lang"), "lang")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':0'), doc_id LIMIT 50")
def reservoir_sample(spark, sf):
    return sampling.hash_sample(docs(spark, sf).select("doc_id"), 50, "doc_id")


@query("""WITH RECURSIVE c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), f AS (SELECT 0 AS k, (SELECT sum(n) FROM c)::BIGINT AS total, -1::BIGINT AS last
  UNION ALL SELECT k + 1, (SELECT sum(least(n, CAST(floor(0.3::DOUBLE * f.total) AS BIGINT))) FROM c)::BIGINT, f.total FROM f WHERE k < 64 AND total <> last),
t AS (SELECT CAST(floor(0.3::DOUBLE * total) AS BIGINT) AS cap FROM f ORDER BY k DESC LIMIT 1)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM documents), t WHERE r <= cap""")
def capped_sources(spark, sf):
    own = docs(spark, sf).select("doc_id", "lang")
    return sampling.cap_sources(own, "lang", "doc_id", {k: 0.3 for k in ("en", "fr", "de", "es")})


@query()
def build_dataset_counts(spark, sf):
    """A whole contrast on the Arabic view: its parts have SQL of their own; together they are held against Python in tests."""
    own = arabic(spark, sf).select("source", "lang", "doc_id", F.posexplode(F.split("t", "\n")).alias("li", "line"))
    c = registry.CONTRASTS["vs_maghreb_arabizi"]
    built = corpus.build(own.where("lang = 'fr'"), own.where("lang = 'es'"), c, ["doc_id", "li"])
    return built.groupBy("cls", "split", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))


_PROMPTS = "pm AS (SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 5 = 0 THEN 'arabizi' ELSE 'arabe' END AS script, 'c' || (conv_id % 7) AS category FROM (SELECT DISTINCT conv_id FROM conversations))"


def prompts(spark, sf):
    c = F.col("conv_id")
    return table(spark, sf, "conversations").select(c).distinct().select(c.cast("string").alias("id"), F.when(c % 5 == 0, "arabizi").otherwise("arabe").alias("script"), F.concat(F.lit("c"), (c % 7).cast("string")).alias("category"))


@query(f"WITH {_PROMPTS}, q AS (SELECT script, count(*) AS k, least(count(*), greatest(1, CAST(round_even(12.0 * count(*) / (SELECT count(*) FROM pm), 0) AS BIGINT))) AS q FROM pm GROUP BY script), s AS (SELECT pm.*, q, row_number() OVER (PARTITION BY pm.script ORDER BY md5(id || ':0'), id) AS r FROM pm JOIN q USING (script)), c AS (SELECT *, row_number() OVER (PARTITION BY script ORDER BY id DESC) AS b FROM s WHERE r <= q) SELECT id, script, category FROM c WHERE script <> (SELECT script FROM q ORDER BY k DESC, script LIMIT 1) OR b > greatest(0, (SELECT sum(q) FROM q) - 12)")
def stratified_prompts(spark, sf):
    return sampling.stratified(prompts(spark, sf), 12)


@query(f"WITH {REPLIES_SQL}, o AS (SELECT pos, prompt_id FROM replies WHERE len({S.words('reply')}) >= 20), k AS (SELECT prompt_id, row_number() OVER (ORDER BY md5(prompt_id || ':0'), prompt_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT prompt_id FROM o)) SELECT pos, prompt_id, CASE WHEN r <= floor(n * 0.25) THEN 'validation' ELSE 'train' END AS side FROM o JOIN k USING (prompt_id)")
def split_by_prompt(spark, sf):
    own = replies(spark, sf)
    return sampling.split_by_prompt(own, "prompt_id", F.size(N.split_words(F.col("reply")))).select("pos", "prompt_id", "side")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE source IN ('src1', 'src2'))")
def exact_dup_contamination(spark, sf):
    """Texts that are also on the held-out side: the benchmark, and two sources."""
    held = table(spark, sf, "benchmark").select("text").union(docs(spark, sf).where("source in ('src1', 'src2')").select("text"))
    return sampling.contamination(docs(spark, sf), held, "text").select("doc_id")


# ---- replies
_VERDICTS = f"""{S.MODEL}, {REPLIES_SQL}, ok AS (SELECT * FROM replies WHERE error IS NULL), {S.prepared('ok', 'pos', 'reply')},
vn AS (SELECT pos, t, translit, {S.norm('t')} AS nt FROM pr), vw AS (SELECT *, {S.n_words('nt')} AS n_words FROM vn), vr AS (SELECT * FROM vw WHERE n_words >= 25), {S.scores('vr', 'pos', 't')},
vm AS (SELECT pos, {S.n_discriminant('nt')} AS k FROM vr),
vd AS (SELECT ok.pos, ok.prompt_id, ok.model, ok.condition, ok.script, category, CAST(vw.n_words AS INTEGER) AS n_words, vw.n_words >= 25 AND vw.t <> '' AS scorable, round(score, 4) AS score, score AS exact, vw.t, score >= threshold AS above_classifier, CAST(k AS INTEGER) AS n_markers, translit AS transliterated FROM ok JOIN vw USING (pos) LEFT JOIN sc USING (pos) LEFT JOIN vm USING (pos), mt)"""


def verdicts(spark, sf, m=None):
    return TR.reply_verdicts(replies(spark, sf), m or model(spark, sf))


@query(f"""WITH {_VERDICTS}, rr AS (SELECT pos, {S.count('t', S.AR)} AS a, {S.count('t', S.LA)} AS l, greatest(0, {S.count('t', S.ALNUM)} - {S.count('t', S.AR)} - {S.count('t', S.LA)}) AS o FROM vw)
SELECT prompt_id, model, condition, script, n_words, scorable, CASE WHEN t = '' THEN 'empty reply' WHEN NOT scorable THEN 'too short (' || n_words || ' words, minimum 25)' END AS skipped, score, CASE WHEN scorable THEN CASE WHEN exact >= threshold THEN 'fr' ELSE 'es' END END AS label, above_classifier, n_markers,
  CASE WHEN scorable THEN above_classifier AND n_markers >= 1 END AS is_positive, transliterated, CASE WHEN a + l + o > 0 THEN round(a / (a + l + o), 6) ELSE 0 END AS arabic, CASE WHEN a + l + o > 0 THEN round(l / (a + l + o), 6) ELSE 0 END AS latin, CASE WHEN a + l + o > 0 THEN round(o / (a + l + o), 6) ELSE 0 END AS other
FROM vd JOIN rr USING (pos), mt""")
def reply_verdicts(spark, sf):
    """All but language shares and explanation, which are ``lang_profile`` and ``marker_explain`` of the prepared reply."""
    return verdicts(spark, sf).drop("ar", "fr", "arabizi", "unknown", "explanation")


@query(f"""WITH {_VERDICTS}, a AS (SELECT model, condition, script, count(*) AS n, CAST(count(error) AS BIGINT) AS n_errors FROM replies GROUP BY ALL),
b AS (SELECT model, condition, script, count(*) FILTER (score IS NULL) AS bad, count(score) AS good, median(score) AS m, avg(CAST(abs(score - threshold) < 0.02::DOUBLE AS DOUBLE)) FILTER (score IS NOT NULL) AS b FROM vd, mt GROUP BY ALL)
SELECT model, condition, script, n, n_errors, coalesce(bad, 0) AS n_unscorable, coalesce(good, 0) AS n_scored, round(m, 3) AS median, round(b, 3) AS borderline_rate, round((round(m, 3) - 0.8308::DOUBLE) / (0.9184::DOUBLE - 0.8308::DOUBLE), 6) AS position, round(coalesce(good, 0) / n, 6) AS coverage FROM a LEFT JOIN b USING (model, condition, script)""")
def bench_cells(spark, sf):
    m = model(spark, sf)
    return report.cells(replies(spark, sf), verdicts(spark, sf, m), m.threshold)


@query(f"WITH {_VERDICTS}, vv AS (SELECT model, prompt_id, condition, pos, score FROM vd UNION ALL SELECT model, prompt_id, condition, pos + 1000000000, round(1 - score, 4) FROM vd WHERE pos % 3 = 0), p AS (SELECT model, prompt_id, arg_max(score, pos) FILTER (condition = 'implicite' AND score IS NOT NULL) AS i, arg_max(score, pos) FILTER (condition = 'explicite' AND score IS NOT NULL) AS e FROM vv GROUP BY ALL) SELECT model, count(*) AS n_pairs, CAST(count(*) FILTER (e - i > 0) AS BIGINT) AS n_up, round(median(e - i), 4) AS median_delta, round(count(*) FILTER (e - i > 0) / count(*), 6) AS rate_up FROM p WHERE i IS NOT NULL AND e IS NOT NULL GROUP BY model")
def paired_shift(spark, sf):
    """A third of the replies are measured again later, with another score: the last measure counts."""
    own = TR.reply_verdicts(replies(spark, sf), model(spark, sf), order="pos")
    again = own.where("pos % 3 = 0").withColumns({"pos": F.col("pos") + 1000000000, "score": F.round(1 - F.col("score"), 4)})
    return report.paired_shifts(own.union(again), "pos")


@query(f"WITH {_VERDICTS} SELECT model, condition, category, count(*) AS n, round(median(score), 3) AS median FROM vd WHERE score IS NOT NULL GROUP BY ALL")
def by_register(spark, sf):
    known = replies(spark, sf).select(F.col("prompt_id").alias("id"), "category").distinct()
    return report.by_register(verdicts(spark, sf), known)


@query(f"WITH {_PROMPTS}, {REPLIES_SQL} SELECT id AS prompt_id, model, condition, script FROM pm, (VALUES ('m0'), ('m1'), ('m2')) AS m(model), (VALUES ('implicite'), ('explicite')) AS c(condition) WHERE (id, model, condition) NOT IN (SELECT (prompt_id, model, condition) FROM replies)")
def resume_worklist(spark, sf):
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    return report.work_list(prompts(spark, sf), models, ["implicite", "explicite"], replies(spark, sf))


@query(f"WITH {REPLIES_SQL}, x AS (SELECT model, category, pos, error IS NOT NULL OR category = 'c0' AS bad FROM replies), o AS (SELECT *, sum(CAST(NOT bad AS INT)) OVER w AS ok, sum(CAST(bad AS INT)) OVER w AS nb FROM x WINDOW w AS (PARTITION BY category ORDER BY pos)) SELECT category AS model, count(*) AS calls, CAST(count(*) FILTER (NOT bad) AS BIGINT) AS succeeded, coalesce(min(pos) FILTER (ok = 0 AND nb >= 3), -1) AS abandoned_at, min(pos) FILTER (ok = 0 AND nb >= 3) IS NOT NULL AS abandoned FROM o GROUP BY category")
def abandon_replay(spark, sf):
    own = replies(spark, sf).withColumn("error", F.when(F.col("category") == "c0", F.lit("down")).otherwise(F.col("error")))
    return report.abandoned(own.withColumn("model", F.col("category")), "pos").withColumn("abandoned_at", F.coalesce("abandoned_at", F.lit(-1)))


# ---- triage
_TRIAGE = f"""{S.MODEL}, {S.prepared('documents', 'doc_id', 'text')}, {S.blocks('pr', 'doc_id', 't')}, {S.scores('bl', 'doc_id, block', 't')},
td AS (SELECT doc_id, median(score) AS m, avg(CAST(score >= threshold AS DOUBLE)) AS up, count(*) AS nb, any_value(threshold) AS th FROM sc, mt GROUP BY doc_id),
tk AS (SELECT doc_id, {S.n_discriminant(S.norm('t'))} AS k FROM pr)"""


def _triage_sql(strict: bool) -> str:
    rule = "m >= th AND k >= 1" if strict else "m >= th"
    return f"""{_TRIAGE}, tv AS (SELECT pr.doc_id, CAST(len({S.words('t')}) AS INTEGER) AS n_words, CAST(coalesce(nb, 0) AS INTEGER) AS n_blocks, CASE WHEN nb IS NULL THEN 'undecidable' WHEN {rule} THEN 'positive' ELSE 'other' END AS verdict,
round(m, 4) AS median, round((m - 0.8308::DOUBLE) / (0.9184::DOUBLE - 0.8308::DOUBLE), 4) AS position, round(up, 3) AS share_positive, CAST(CASE WHEN nb IS NULL THEN 0 ELSE k END AS INTEGER) AS n_markers, translit AS transliterated FROM pr LEFT JOIN td USING (doc_id) LEFT JOIN tk USING (doc_id))"""


@query(f"WITH RECURSIVE {_triage_sql(False)} SELECT * FROM tv")
def triage_verdicts(spark, sf):
    return TR.triage(docs(spark, sf), "doc_id", "text", model(spark, sf))


@query(f"WITH RECURSIVE {_triage_sql(True)} SELECT * FROM tv")
def triage_strict(spark, sf):
    return TR.triage(docs(spark, sf), "doc_id", "text", model(spark, sf), strict=True)


@query(f"WITH RECURSIVE {_triage_sql(False)} SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM tv), 4) AS share, round(median(position), 4) AS median_position, min(position) AS min_position, max(position) AS max_position, CAST(count(*) FILTER (transliterated) AS BIGINT) AS n_transliterated FROM tv GROUP BY GROUPING SETS ((verdict), ())")
def triage_summary(spark, sf):
    return TR.triage_summary(triage_verdicts(spark, sf))


_DISPERSION = f"""WITH RECURSIVE {_TRIAGE} SELECT doc_id, CAST(count(*) AS INTEGER) AS n, round(min(score), 4) AS min, round(median(score), 4) AS median, round(max(score), 4) AS max, CAST(count(*) FILTER (score < threshold) AS INTEGER) AS below_threshold,
list_sort(list(round((score - 0.8308::DOUBLE) / (0.9184::DOUBLE - 0.8308::DOUBLE), 3))) AS positions FROM sc JOIN (SELECT doc_id, {S.n_words(S.norm('t'))} AS w FROM pr) USING (doc_id), mt WHERE w >= 150 GROUP BY doc_id HAVING count(*) >= 2"""


@query(_DISPERSION.replace("WITH RECURSIVE", "WITH RECURSIVE dispersion AS (WITH RECURSIVE", 1) + ") SELECT doc_id, unnest(range(len(positions)))::INTEGER AS i, unnest(positions) AS position FROM dispersion")
def block_positions(spark, sf):
    """Where each block of a long text lies, in order."""
    return TR.block_dispersion(docs(spark, sf), "doc_id", "text", model(spark, sf)).select("doc_id", F.posexplode("positions").alias("i", "position"))


@query(f"SELECT * EXCLUDE (positions) FROM ({_DISPERSION})")
def block_dispersion(spark, sf):
    return TR.block_dispersion(docs(spark, sf), "doc_id", "text", model(spark, sf)).drop("positions")


@query(f"""WITH {S.MODEL}, {S.prepared('documents', 'doc_id', 'text')}, xn AS (SELECT doc_id, t, translit, {S.norm('t')} AS nt FROM pr), xw AS (SELECT *, {S.n_words('nt')} AS n_words FROM xn), xr AS (SELECT * FROM xw WHERE n_words >= 25), {S.scores('xr', 'doc_id', 't')},
xm AS (SELECT doc_id, {S.n_discriminant('nt')} AS k FROM xr)
SELECT xw.doc_id, CASE WHEN NOT regexp_matches(xw.t, '\\S') THEN 'empty' WHEN n_words < 25 THEN 'too_short' ELSE 'measured' END AS status, CAST(n_words AS INTEGER) AS n_words, translit AS transliterated, round(score, 4) AS score,
  round((score - 0.8308::DOUBLE) / (0.9184::DOUBLE - 0.8308::DOUBLE), 4) AS position, CASE WHEN score < 0.8542 THEN 'low' WHEN score < 0.8982 THEN 'below_typical' WHEN score <= 0.9372 THEN 'centre' WHEN score IS NOT NULL THEN 'high' END AS zone, score >= threshold AS above_classifier, CAST(k AS INTEGER) AS n_markers, score >= threshold AND k >= 1 AS is_positive
FROM xw LEFT JOIN sc USING (doc_id) LEFT JOIN xm USING (doc_id), mt""")
def measure_records(spark, sf):
    own = TR.measures(docs(spark, sf), "doc_id", "text", model(spark, sf))
    return own.select("doc_id", "status", "n_words", "transliterated", "score", "position", "zone", "above_classifier", "n_markers", "is_positive")


@query(f"{M} SELECT doc_id, round((score - 0.8308::DOUBLE) / (0.9184::DOUBLE - 0.8308::DOUBLE), 6) AS position, CASE WHEN score < 0.8542 THEN 'low' WHEN score < 0.8982 THEN 'below_typical' WHEN score <= 0.9372 THEN 'centre' ELSE 'high' END AS zone FROM ms")
def anchor_zones(spark, sf):
    pos = P.position(F.col("score"))
    return class_scores(spark, sf).select("doc_id", F.round(pos, 6).alias("position"), P.zone(pos).alias("zone"))


# ---- registries and readers
def _values(rows, names: str) -> str:
    cell = lambda x: "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


_SRC = _values([(s["key"], s["role"], s["max_bytes"], s["license"]) for s in registry.SOURCES.values()], "key, role, max_bytes, license")


@query(f"SELECT key, round(coalesce(max_bytes, 0) / 1048576.0::DOUBLE, 1) AS mb, coalesce(max_bytes, 0) = 0 AS uncapped FROM {_SRC} UNION ALL SELECT NULL, round(sum(coalesce(max_bytes, 0)) / 1048576.0::DOUBLE, 1), false FROM {_SRC}")
def source_budget(spark, sf):
    return registry.budget(registry.sources(spark))


@query(f"SELECT key FROM {_SRC} WHERE coalesce(license, '') = ''")
def unlicensed_sources(spark, sf):
    return registry.unlicensed(registry.sources(spark)).select("key")


@query(f"SELECT role, count(*) AS n FROM {_SRC} GROUP BY role")
def sources_by_role(spark, sf):
    own = registry.sources(spark)
    return registry.by_role(own, "positive").union(registry.by_role(own, "negative")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT contrast, genre_controlled, contrast NOT IN ('vs_algerian', 'vs_egyptian', 'vs_maghrebi', 'vs_moroccan_latin', 'vs_moroccan_tw') AS buildable FROM (VALUES ('vs_algerian', true), ('vs_all', false), ('vs_egyptian', false), ('vs_maghreb', true), ('vs_maghreb_arabizi', true), ('vs_maghreb_llm', true), ('vs_maghrebi', false), ('vs_moroccan_latin', false), ('vs_moroccan_tw', true), ('vs_moroccan_yt', true), ('vs_msa', false)) AS t(contrast, genre_controlled)")
def buildable_contrasts(spark, sf):
    """With a positive corpus or two, and omcd and ar among the negatives."""
    cached = spark.createDataFrame([("tsac",), ("omcd",), ("linto",), ("ar",)], "source string")
    return registry.buildable(registry.contrasts(spark), cached)


@query("SELECT arg_max(c, n) AS best FROM (SELECT 'url' AS c, avg(len(coalesce(url, ''))) AS n FROM pages UNION ALL SELECT 'html', avg(len(coalesce(html, ''))) FROM pages) UNION ALL SELECT arg_max(c, n) FROM (SELECT 'text' AS c, avg(len(text)) AS n FROM documents UNION ALL SELECT 'lang', avg(len(lang)) FROM documents UNION ALL SELECT 'source', avg(len(source)) FROM documents)")
def best_text_column(spark, sf):
    best = [readers.best_text_column(table(spark, sf, t), by_name=False, rows=None) for t in ("pages", "documents")]
    return spark.createDataFrame([(b,) for b in best], "best string")


_MSG = [
    ("429 RESOURCE_EXHAUSTED retry in 12.5s", "google"), ("RESOURCE_EXHAUSTED GenerateRequestsPerDay", "google"), ("500 internal", "google"), ("429 limit: 0", "google"), ("429 limit: 01", "google"),
    ("Rate limited, try again in 7 s", "openrouter"), ("Retry after 3.5s; free-models-per-day", "openrouter"), ("DAILY limit", "openrouter"), ("odd", "openrouter"),
    ("retry in 2s", "xai"), ("insufficient credits", "xai"), ("Quota reached, retry after 60s", "xai"), ("bad gateway", "xai"),
]
#: What each message means, written down by hand.
_MEANS = [(True, 12.5, False), (True, None, True), (False, None, False), (True, None, True), (True, None, False), (True, 7.0, False), (True, 3.5, True), (True, None, True), (True, None, False), (True, 2.0, False), (True, None, True), (True, 60.0, True), (True, None, False)]


@query(f"SELECT message, provider, limited, CAST(retry_after AS DOUBLE) AS retry_after, exhausted FROM {_values([(*m, *x) for m, x in zip(_MSG, _MEANS)], 'message, provider, limited, retry_after, exhausted')}")
def quota_classify(spark, sf):
    own = spark.createDataFrame(_MSG, "message string, provider string")
    q = F.when(F.col("provider") == "google", P.classify_quota(F.col("message"), "google")).when(F.col("provider") == "openrouter", P.classify_quota(F.col("message"), "openrouter")).otherwise(P.classify_quota(F.col("message"), "xai"))
    return own.select("message", "provider", q.alias("q")).select("message", "provider", "q.*")


# ---- verse
def examples(spark, sf):
    """Documents as texts; the prompt's task, theme and mode follow the id."""
    d = F.col("doc_id")
    task = F.element_at(F.array(*[F.lit(t) for t, _, _ in P.TASKS]), (d % 8 + 1).cast("int"))
    prompt = F.when(d % 11 == 0, F.lit("اكتب تعريفًا نثريًّا موجزًا بـ«عنوان»")).when(d % 13 == 0, F.lit("?")).otherwise(F.concat(task, F.lit(".\nفي غرض «"), F.col("lang"), F.lit("»"), F.when(d % 2 == 0, F.lit(" واجعل مطلعه هذا الشطر بنصّه")).otherwise(F.lit(""))))
    return docs(spark, sf).select(d.alias("pos"), F.when(d % 9 == 0, "validation").otherwise("train").alias("split"), prompt.alias("prompt"), "text", "lang")


_PARSED = f"""ex AS (SELECT doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN 'validation' ELSE 'train' END AS split, text, CASE WHEN doc_id % 11 = 0 THEN 'prose' ELSE ([{S.strings(k for _, k, _ in P.TASKS)}])[doc_id % 8 + 1] END AS genre,
  CASE WHEN doc_id % 11 = 0 THEN 'عنوان' END AS title, CASE WHEN doc_id % 11 <> 0 THEN lang END AS gharad, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'continue' ELSE 'compose' END AS mode FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 <> 0),
en AS (SELECT text, arg_min(genre, pos) AS genre, arg_min(split, pos) AS split, coalesce(string_agg(DISTINCT mode, ' ' ORDER BY mode), '') AS modes, first(gharad ORDER BY pos) AS gharad, first(title ORDER BY pos) AS title FROM ex GROUP BY text)"""


@query(f"WITH {_PARSED} SELECT pos, genre, title, gharad, mode FROM ex")
def prompt_parse(spark, sf):
    own = examples(spark, sf).select("pos", P.parse_prompt(F.col("prompt")).alias("m")).where("m is not null")
    return own.select("pos", "m.genre", "m.title", "m.gharad", "m.mode")


@query(f"WITH {_PARSED} SELECT md5(text) AS text_md5, genre, split, gharad, title, modes FROM en")
def poem_dedup(spark, sf):
    return poems.from_examples(examples(spark, sf)).select(F.md5("text").alias("text_md5"), "genre", "split", "gharad", "title", F.array_join("modes", " ").alias("modes"))


@query(f"WITH {_PARSED}, ix AS (SELECT md5(text) AS fp, arg_max('u' || doc_id, doc_id) AS uid FROM documents GROUP BY 1) SELECT md5(text) AS text_md5, uid FROM en LEFT JOIN ix ON ix.fp = md5(text)")
def poem_uid_join(spark, sf):
    index = docs(spark, sf).select(F.col("doc_id").alias("pos"), F.md5("text").alias("fingerprint"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("uid"))
    return poems.attach_uids(poems.from_examples(examples(spark, sf)), index, F.md5).select(F.md5("text").alias("text_md5"), "uid")


_POEM = S.squeeze(rf"regexp_replace({S.letters(rf'''regexp_replace(replace(text, chr(1600), ''), '[{N.MARKS}]', '', 'g')''')}, '[^\x{{0621}}-\x{{064A}}0-9 ]', ' ', 'g')")
_CR = f"""{_PARSED}, pn AS (SELECT *, list_filter(string_split({_POEM}, ' '), lambda w: w <> '') AS w, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS nl FROM en)
SELECT 'total' AS section, 'n_texts' AS key, count(*) AS n, NULL::DOUBLE AS pct FROM pn UNION ALL SELECT 'total', 'n_words', coalesce(sum(len(w)), 0)::BIGINT, NULL FROM pn UNION ALL SELECT 'total', 'n_lines', coalesce(sum(nl), 0)::BIGINT, NULL FROM pn
UNION ALL SELECT 'total', 'vocabulary', count(DISTINCT x), NULL FROM (SELECT unnest(w) AS x FROM pn)
{' '.join(f"UNION ALL SELECT 'coverage', '{c}', count({c if c in ('gharad', 'title') else 'NULL'}), round(100.0 * count({c if c in ('gharad', 'title') else 'NULL'}) / count(*), 1) FROM pn" for c in poems.FIELDS)}
{' '.join(f"UNION ALL SELECT 'by_{c}', {c}, count(*), NULL FROM pn WHERE {c} IS NOT NULL GROUP BY {c}" for c in ('genre', 'gharad', 'split'))}"""


@query(f"WITH {_CR}")
def corpus_report(spark, sf):
    return poems.corpus_report(poems.from_examples(examples(spark, sf)))
