"""Blocks, classifier, sampling, reports, triage, verse, readers and the stream on small fixtures."""

from __future__ import annotations

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lahja.operators import blocks as B
from lahja.operators import classifier as K
from lahja.operators import corpus, poems, report, sampling
from lahja.operators import triage as TR
from lahja.sources import readers, registry
from lahja.streaming.replies import new_replies, score_stream

POS = ["شنوة أحوالك اليوم برشا باهي توا نمشي باش نشري خبز من السوق مع صاحبي وزوز كيلو طماطم وشوية بصل ونرجع للدار نطيب الماكلة فيسع"] * 6
NEG = ["ذهب الرجل الى المدينة الكبيرة لكي يشتري الطعام من السوق القديم ثم عاد الى بيته في المساء وقد اشترى الخبز والفاكهة والخضر الطازجة كلها"] * 6


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, i % 2 == 0, f"{(POS if i % 2 == 0 else NEG)[0]} {'ab'[i % 2]}{i // 2}") for i in range(24)]
    return spark.createDataFrame(rows, "id int, p boolean, t string")


@pytest.fixture(scope="module")
def model(texts):
    return K.train(texts, "p", "t", ("tn", "msa"))


def walk(lines, target):
    out, buf, count = [], [], 0
    for x in lines:
        if not (n := len(x.split())):
            continue
        buf.append(x)
        count += n
        if count >= target:
            out.append("\n".join(buf))
            buf, count = [], 0
    return out + (["\n".join(buf)] if buf and count >= target // 2 else [])


def test_chunk_lines_of_partitions_equals_one_walk(spark):
    rng = random.Random(0)
    rows = [(f"s{g}", i, " ".join("w" * rng.randrange(90) for _ in range(1)) if rng.random() < 0.1 else " ".join("x" for _ in range(rng.randrange(70)))) for g in range(3) for i in range(200 if g else 3)]
    df = spark.createDataFrame(rows, "source string, i int, line string")
    got = {(r["source"], r["block"]): r["text"] for r in B.chunk_lines(df, "source", ["i"], "line", 60).collect()}
    want = {(g, k): t for g in ("s0", "s1", "s2") for k, t in enumerate(walk([x for s, _, x in rows if s == g], 60))}
    assert got == want
    assert B.chunk_lines(df.limit(0), "source", ["i"], "line").count() == 0


def test_document_blocks(spark):
    ten = "\n".join(["w " * 10] * 6)
    df = spark.createDataFrame([(ten,), ("w " * 5,), ("w " * 40,), ("\n!!!\n",), ("w " * 150,), (None,)], "t string")
    rows = [r["b"] for r in df.select(B.document_blocks(F.col("t"), 30).alias("b")).collect()]
    assert [len(b) for b in rows] == [2, 0, 1, 0, 5, 0]
    groups = B.group_documents(spark.createDataFrame([("s", i, "w " * 20) for i in range(7)], "s string, i int, t string"), "s", "i", "t", 60)
    assert [r["unit"] for r in groups.orderBy("block").collect()] == ["0+3", "3+3"]


def test_classifier_against_brute_force(spark, texts, model):
    from collections import Counter

    def grams(t):
        s = " " + t.replace(" ", "_") + " "
        return [s[i : i + 4] for i in range(len(s) - 3)]

    normal = {r["id"]: (r["p"], r["n"]) for r in texts.select("id", "p", K.normalize(F.col("t")).alias("n")).collect()}
    cp, cn = Counter(), Counter()
    for p, t in normal.values():
        (cp if p else cn).update(grams(t))
    vocab = set(cp) | set(cn)
    w = {g: math.log((cp[g] + 0.5) / (cp.total() + 0.5 * len(vocab))) - math.log((cn[g] + 0.5) / (cn.total() + 0.5 * len(vocab))) for g in vocab}
    got = {r["gram"]: r["w"] / K.SCALE for r in model.weights.collect()}
    assert got.keys() == w.keys() and all(abs(got[g] - w[g]) < 1e-8 for g in w)
    raw = {i: (p, sum(w[g] for g in grams(t)) / len(grams(t))) for i, (p, t) in normal.items()}
    pos, neg = sorted(x for p, x in raw.values() if p), [x for p, x in raw.values() if not p]
    hi = pos[int(0.9 * len(pos))]
    assert abs(model.hi - hi) < 1e-7 and abs(model.lo - (min(neg) - 0.1 * max(hi - min(neg), 1e-6))) < 1e-7
    e = K.evaluate(texts, "p", "t", model).first()
    assert e["auc"] == 1.0 and e["accuracy"] == 1.0 and e["too_short"] == 24 * (len(normal[0][1].split()) < 25)
    with pytest.raises(ValueError):
        K.train(texts.where("p"), "p", "t")


def test_auc_youden_and_percentiles(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, p boolean")
    assert K.auc(frame([(1.0, True), (0.0, False)])).first()[0] == 1.0 and K.auc(frame([(0.5, True), (0.5, False)])).first()[0] == 0.5
    assert math.isnan(K.auc(frame([(0.5, True)])).first()[0]) and K.youden(frame([(0.5, True)])).first()["threshold"] == 0.5
    assert K.youden(frame([(0.9, True), (0.8, True), (0.2, False), (0.85, False)])).first()["threshold"] == 0.8
    ten = frame([(float(i), True) for i in range(1, 11)])
    assert K.nth(ten, "score", K.percentile_index(0.9)).first()[0] == 10.0 and K.nth(ten, "score", K.upper_median()).first()[0] == 6.0


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = K.Model.load(spark, str(tmp_path / "m"))
    assert (again.lo, again.hi, again.threshold, again.labels) == (model.lo, model.hi, model.threshold, model.labels) and again.weights.count() == model.weights.count()


def test_caps():
    assert sampling.cap_total({"a": 5000, "b": 50}) == 100
    assert sampling.cap_total({"a": 100, "b": 100}) == 200
    with pytest.raises(ValueError):
        sampling.cap_total({"a": 1, "b": 1}, {"a": 0.1, "b": 0.1})


def test_sampling(spark):
    df = spark.createDataFrame([(i, f"s{i % 3 == 0}") for i in range(100)], "id int, source string")
    split = sampling.holdout_split(df, "id")
    assert split.where("split = 'train'").count() == 75 and split.exceptAll(sampling.holdout_split(df, "id")).isEmpty()
    assert sampling.cap_sources(df, "source", "id", {"sTrue": 0.1, "sFalse": 0.95}).where("source = 'sTrue'").count() <= 10
    prompts = spark.createDataFrame([(f"p{i}", "arabizi" if i < 8 else "arabe") for i in range(42)], "id string, script string")
    for n in (1, 5, 20):
        got = sampling.stratified(prompts, n)
        assert got.where("script = 'arabizi'").count() >= 1 and got.count() <= max(n, 2)
    assert sampling.stratified(prompts, 99).count() == 42
    with pytest.raises(ValueError):
        sampling.stratified(prompts, 0)
    rows = spark.createDataFrame([(f"p{i % 8}", "w " * (25 if i % 5 else 3)) for i in range(80)], "prompt string, t string")
    sides = sampling.split_by_prompt(rows, "prompt", F.size(F.split("t", " ")))
    a, b = (sides.where(F.col("side") == s).select("prompt").distinct() for s in ("train", "validation"))
    assert sampling.contamination(a, b, "prompt").isEmpty() and b.count() == 2


def test_reports(spark):
    replies = spark.createDataFrame([("p1", "m", "implicite", "arabe", "r", None), ("p2", "m", "implicite", "arabe", "", "429"), ("p1", "m", "explicite", "arabe", "r", None), ("p3", "m", "implicite", "arabe", "r", None)], readers.REPLY)
    v = spark.createDataFrame([("p1", "m", "implicite", "arabe", True, 0.80), ("p1", "m", "explicite", "arabe", True, 0.90), ("p3", "m", "implicite", "arabe", True, 0.839)], "prompt_id string, model string, condition string, script string, scorable boolean, score double")
    cell = report.cells(replies, v, 0.838).where("condition = 'implicite'").first()
    assert (cell["n"], cell["n_errors"], cell["n_scored"], cell["borderline_rate"]) == (3, 1, 2, 0.5)
    shift = report.paired_shifts(v).first()
    assert (shift["n_pairs"], shift["n_up"], shift["median_delta"]) == (1, 1, 0.1)
    assert report.by_register(v, spark.createDataFrame([("p1", "c")], "id string, category string")).count() == 2
    log = spark.createDataFrame([(i, "dead", "x") for i in range(4)] + [(9, "ok", None), (10, "ok", "x"), (11, "ok", "x"), (12, "ok", "x")], "pos int, model string, error string")
    got = {r["model"]: (r["abandoned"], r["abandoned_at"]) for r in report.abandoned(log, "pos").collect()}
    assert got == {"dead": (True, 2), "ok": (False, None)}
    assert "median" in report.render(report.cells(replies, v, 0.838), "x")


def test_triage_and_replies(spark, texts, model):
    docs = texts.select("id", "t").union(spark.createDataFrame([(90, "قصير"), (91, None), (92, "")], "id int, t string"))
    out = {r["id"]: r for r in TR.triage(docs, "id", "t", model).collect()}
    assert len(out) == 27
    assert out[90]["verdict"] == out[91]["verdict"] == out[92]["verdict"] == "undecidable" and out[90]["median"] is None
    strict = {r["id"]: r["verdict"] for r in TR.triage(docs, "id", "t", model, strict=True).collect()}
    assert all(strict[i] == "other" for i in range(1, 24, 2) if out[i]["n_blocks"])
    replies = texts.select(F.col("id").cast("string").alias("prompt_id"), F.lit("m").alias("model"), F.lit("implicite").alias("condition"), F.lit("arabe").alias("script"), F.concat("t", F.lit(" "), "t").alias("reply"), F.lit(None).cast("string").alias("error"))
    v = {r["prompt_id"]: r for r in TR.reply_verdicts(replies, TR.Scorer(replace(model, threshold=0.5), model)).collect()}
    assert v["0"]["is_positive"] and not v["1"]["is_positive"] and v["0"]["label"] == "tn" and "score=" in v["0"]["explanation"]
    m = {r["id"]: r["status"] for r in TR.measures(docs, "id", "t", model).collect()}
    assert m[92] == "empty" and m[90] == "too_short"
    total = TR.triage_summary(TR.triage(docs, "id", "t", model)).where("verdict is null").first()
    assert total["n"] == 27 and total["share"] == 1.0


def test_stream_scores_each_key_once(spark, model, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"prompt_id": "1", "model": "m", "condition": "implicite", "script": "arabe", "reply": POS[0] + " " + POS[0]}
    (folder / "a.json").write_text(json.dumps(row, ensure_ascii=False) + "\nbroken{\n" + json.dumps(row, ensure_ascii=False))
    go = lambda: score_stream(new_replies(spark, str(folder)), TR.Scorer(model), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    go()
    (folder / "b.json").write_text(json.dumps(row | {"prompt_id": "2"}, ensure_ascii=False) + "\n" + json.dumps(row, ensure_ascii=False))
    go()
    assert sorted(r["prompt_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_build(spark):
    lines = lambda t: spark.createDataFrame([(f"s{i % 2}", i, f"{t[0]} {'اب'[i % 2] * 3}") for i in range(60)], "source string, i int, line string")
    out = corpus.build(lines(POS), lines(NEG), registry.CONTRASTS["vs_maghreb"], ["i"], target=40)
    n = {(r["cls"], r["split"]): r["count"] for r in out.groupBy("cls", "split").count().collect()}
    assert n["positive", "train"] == n["negative", "train"] and n["positive", "test"] > 0
    train, test = out.where("split = 'train'").select("cls", "source", "block"), out.where("split = 'test'").select("cls", "source", "block")
    assert train.intersect(test).isEmpty()
    with pytest.raises(ValueError):
        corpus.build(lines(["latin only here"]), lines(NEG), registry.CONTRASTS["vs_maghreb"], ["i"])


def test_poems(spark):
    rows = [(1, "train", "انظم القسيم.", "بيت اول\nبيت ثاني"), (2, "train", "انظم القسيم. واجعل مطلعه هذا الشطر بنصّه", "بيت اول\nبيت ثاني"), (3, "validation", "?", "x"), (4, "train", "انظم الملزومة", None)]
    e = poems.from_examples(spark.createDataFrame(rows, "pos int, split string, prompt string, text string"))
    r = e.first()
    assert e.count() == 1 and r["modes"] == ["compose", "continue"] and (r["n_lines"], r["n_words"], r["is_usul"]) == (2, 4, True)
    index = spark.createDataFrame([(1, "f", "old"), (2, "f", "new"), (3, None, "z")], "pos int, fingerprint string, uid string")
    got = poems.attach_uids(e, index, lambda t: F.lit("f"))
    assert got.first()["uid"] == "new"
    totals = {(r["section"], r["key"]): r["n"] for r in poems.corpus_report(got).collect()}
    assert totals["total", "vocabulary"] == 3 and totals["coverage", "uid"] == 1 and totals["by_genre", "qasim"] == 1


def test_readers(spark, tmp_path):
    d = tmp_path
    (d / "a.jsonl").write_text('{"uid": "u1", "text": "one"}\n\n{"id": "", "text": "two"}\n{"text": ""}\n')
    assert [(r["id"], r["text"]) for r in readers.read_documents(spark, str(d / "a.jsonl")).orderBy("pos").collect()] == [("u1", "one"), ("2", "two")]
    (d / "b.txt").write_text("x\n\ny\n")
    assert [(r["id"], r["text"]) for r in readers.read_documents(spark, str(d / "b.txt")).orderBy("pos").collect()] == [("0", "x"), ("2", "y")]
    (d / "c.csv").write_text("id,text\n7,hello\n,there\n")
    assert sorted((r["id"], r["text"]) for r in readers.read_documents(spark, str(d / "c.csv")).collect()) == [("1", "there"), ("7", "hello")]
    (d / "dir").mkdir()
    (d / "dir" / "f.md").write_text("whole\ntext")
    assert [tuple(r)[1:] for r in readers.read_documents(spark, str(d / "dir")).collect()] == [("f.md", "whole\ntext")]
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(d / "dir" / ".." / "dir" / "f.md"))
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(d / "none.txt"))
    (d / "t.csv").write_text("n,Tweet,name\n1,some words here,bob\n2,,al\n")
    assert [r["line"] for r in readers.read_csv_text(spark, str(d / "t.csv")).collect()] == ["some words here", ""]
    (d / "j.jsonl").write_text('{"a": "long text", "b": "x", "n": 3}\n"plain"\n[broken\n')
    assert sorted(r["line"] for r in readers.read_json_text(spark, str(d / "j.jsonl")).collect()) == ["long text", "plain"]
    (d / "s.tsv").write_text("1\tlast\n")
    assert readers.read_tsv_text(spark, str(d / "s.tsv")).first()["line"] == "last"
    (d / "dump.xml").write_text("<mediawiki><page><title>T</title><ns>0</ns><revision><text bytes='9'>نص طويل بما يكفي هنا [[x|y]]</text></revision></page><page><title>R</title><ns>0</ns><redirect title='T'/><revision><text bytes='1'>x</text></revision></page><page><title>N</title><ns>4</ns><revision><text bytes='1'>x</text></revision></page></mediawiki>")
    pages = readers.read_dump(spark, str(d / "dump.xml"))
    assert [r["title"] for r in pages.collect()] == ["T"] and readers.wiki_lines(pages).first()["line"] == "نص طويل بما يكفي هنا y"
    (d / "p.jsonl").write_text('{"id": "1", "category": "c", "script": "arabe", "text": "t"}\n{"id": "1", "category": "c", "script": "arabe", "text": "t"}\n')
    with pytest.raises(ValueError):
        readers.read_prompts(spark, str(d / "p.jsonl"))


def test_cache(spark, tmp_path):
    lines = spark.createDataFrame([("a b c d e",), ("short",), ("@x one two three four",)], "line string")
    own = [registry.SOURCES["tsac"], registry.SOURCES["dz"]]

    def read(s):
        if s["key"] == "dz":
            raise OSError("gone")
        return lines

    meta = readers.fetch_all(spark, read, own, str(tmp_path))
    assert {r["key"]: r["lines"] for r in meta.collect()} == {"tsac": 2, "dz": None} and readers.fetch_totals(meta).first()["failed"] == "dz"
    assert readers.load_cache(spark, str(tmp_path), registry.sources(spark), "positive").count() == 2
    assert readers.load_cache(spark, str(tmp_path), registry.sources(spark), "negative").count() == 0
    assert len(registry.SOURCES) == 14 and len(registry.CONTRASTS) == 11


def test_every_contrast_keeps_the_judge_out():
    assert all("llm_fusha_val" not in c["negatives"] for c in registry.CONTRASTS.values())
