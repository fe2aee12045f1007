"""Literal expectations of the column functions and operators."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lahja.functions import cleaning as C
from lahja.functions import markers as M
from lahja.functions import normalize as N
from lahja.functions import parsing as P
from lahja.functions import translit as T
from lahja.operators import segments as S
from lahja.sources.entities import AMBIGUOUS, ENTITIES


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    assert one(spark, N.normalize, "مـــاذا", "مَاذَا", None, "  a   b ", "ﻟ") == ["ماذا", "ماذا", "", "a b", "ل"]
    assert one(spark, lambda t: N.normalize(t, "light"), "أنا") == ["أنا"] and one(spark, N.normalize, "أنا")[0].startswith("انا")
    assert one(spark, lambda t: N.normalize(t, "aggressive"), "برشاااااا", "ڨلب ڥيديو!!", "ok ١٢") == ["برشاا", "ڨلب ڥيديو", "12"]
    with pytest.raises(ValueError):
        N.normalize(F.lit(""), "other")
    assert one(spark, N.count_words, "", "a b", "ـــ x") == [0, 2, 1]
    assert one(spark, N.reduce_elongation, "aaab", "\n\n\n\n", "aa") == ["aab", "\n\n\n\n", "aa"]


def test_script_ratio(spark):
    rows = one(spark, N.script_ratio, "...", "", "abc سلام 12", None)
    assert [tuple(r) for r in (rows[0], rows[1], rows[3])] == [(0, 0, 0)] * 3
    assert abs(sum(rows[2]) - 1) < 1e-12 and rows[2]["arabic"] == 4 / 9
    assert one(spark, N.arabic_ratio, "سلام ab", " ") == [4 / 6, 0.0]


def test_to_arabic(spark):
    given = {"9alb": "قلب", "7ob": "حب", "enti": "انتي", "kha": "خا", "barcha": "برشا", "saa": "سا", "nou": "نو", "mchina": "مشينا", "gal": "ڨل", "3'": "غ", "3": "ع", "kh": "خ", "k": "ك", "g": "ڨ", "sehr": "سهر", "3'e": "غا", "É": "É", "tax!": "تكس!"}
    assert one(spark, T.to_arabic, *given) == list(given.values())
    assert one(spark, lambda t: T.to_arabic(t, g_as_qaf=True), "g") == ["ق"]
    assert one(spark, T.to_arabizi, "قلب", "شَمس", None) == ["9lb", "chms", ""]


def brute_to_arabic(text):
    keys = {f"{k}'": v for k, v in T.QUOTED.items()} | T.DIGRAPHS
    single = dict(zip(T.SINGLES_FROM, T.SINGLES_TO)) | {"x": "كس"}
    low, out, i = text.lower(), [], 0
    consonant = lambda c: (c.isalpha() and c not in "aeiou") or c in "23456789"
    while i < len(text):
        hit = next((k for k in sorted(keys, key=len, reverse=True) if low.startswith(k, i)), None)
        if hit:
            out.append(keys[hit])
            i += len(hit)
            continue
        c = low[i]
        if c in "aeo" and 0 < i < len(low) - 1 and consonant(low[i - 1]) and consonant(low[i + 1]):
            pass
        elif c == "e":
            out.append("ا" if i == 0 or not low[i - 1].isalnum() else "")
        else:
            out.append(single.get(c, text[i]))
        i += 1
    return "".join(out)


def test_to_arabic_against_scan(spark):
    import random

    rng = random.Random(0)
    texts = ["".join(rng.choice("aeoiusctkhgdp3279'é xeE.ع") for _ in range(rng.randrange(25))) for _ in range(2000)]
    assert one(spark, T.to_arabic, *texts) == [brute_to_arabic(t) for t in texts]


def test_arabizi(spark):
    assert one(spark, T.is_arabizi, "chnowa a7welek ya sa7bi", "3aslema kifach enti", "bonjour comment allez vous", "i bought an iphone 13 yesterday", "شنوة أحوالك", "") == [True, True, False, False, False, False]
    p = one(spark, T.prepare, "chnowa a7welek ya sa7bi", "المشكلة ok merci", " \n", None)
    assert p[0]["transliterated"] and not re.search("[a-z]", p[0]["text"]) and tuple(p[1]) == ("المشكلة ok merci", False) and p[2]["text"] == "" == p[3]["text"]


def test_segments(spark):
    df = spark.createDataFrame([(1, "ken 3andek le temps ajoutili chwaya de sucre"), (2, "المشكلة أنو le service ماهوش disponible!"), (3, ""), (4, None), (5, "كلام عربي")], "id int, t string")
    rows = S.segments(df, "id", "t").orderBy("id", "start").collect()
    texts = {r["id"]: r["t"] for r in df.collect()}
    assert all(texts[r["id"]][r["start"] : r["end"]] == r["text"] for r in rows)
    one_ = [r for r in rows if r["id"] == 1]
    assert len(one_) > 1 and one_[0]["lang"] == "arabizi" and one_[0]["text"].startswith("ken") and one_[-1]["lang"] == "fr" and one_[-1]["text"].endswith("sucre")
    p = {r["id"]: r["p"] for r in df.select("id", S.profile(F.col("t")).alias("p")).collect()}
    assert tuple(p[3]) == tuple(p[4]) == (0, 0, 0, 0) and abs(sum(p[2]) - 1) < 1e-3
    switched = {r["id"]: r["o"] for r in df.select("id", S.is_code_switched(S.profile(F.col("t"))).alias("o")).collect()}
    assert switched[2] and not switched[5]
    assert S.extract(df, "id", "t", "fr").where("id = 2").first()["fragments"] == ["le service", "disponible"] or S.extract(df, "id", "t", "fr").where("id = 2").count() == 1


def test_long_runs(spark):
    """Runs of very many words, which a recursive match would not survive."""
    long = "كلمة " * 50_000 + "le mot " * 50_000
    p = one(spark, S.profile, long)[0]
    assert p["ar"] == 0.3333 and p["fr"] == 0.6667
    df = spark.createDataFrame([(1, "mot " * 20_000 + "le " + "ken " * 3)], "id int, t string")
    assert [r["lang"] for r in S.segments(df, "id", "t").orderBy("start").collect()] == ["fr", "arabizi"]
    for f in (N.normalize, C.strip_wikitext, C.clean_social, C.strip_punctuation, T.to_arabic, T.to_arabizi):
        assert one(spark, f, long)[0]


def test_markers(spark):
    cases = {"ماناكلش الخبز": True, "ما تبعدش على الدار": True, "ماتبعدش": True, "ما بقاش": True, "ما شاء الله كان": False, "ما هذا الا بشر": False}
    got = one(spark, lambda t: F.regexp_count(t, F.lit(M.pattern("negation_ma_sh"))) > 0, *cases)
    assert got == list(cases.values())
    assert len(M.MARKERS) == 19 and len(M.DISCRIMINANT) == 16
    df = spark.createDataFrame([("اللي " + "كلمة " * 99,)], "t string").withColumn("n", N.normalize(F.col("t")))
    assert [tuple(r) for r in df.select(F.inline(M.rates(F.col("n"), 100 * 100))).collect()] == [("relativizer_elli", 100.0)]
    assert one(spark, lambda t: M.n_discriminant(t), "ما شاء الله كان", "باش نمشي توا برشا") == [0, 3]


def test_marker_hits_against_re(spark):
    texts = ["باش نمشي، باش! ما تبعدش ماناكلش", "برشا برشا شنو توا قاعدين", "", "x باشx باش"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, n string")
    got = sorted((r["id"], r["marker"], r["start"], r["text"]) for r in M.find(df, "id", "n").collect())
    want = sorted((i, name, m.start(), m.group(0)) for i, t in enumerate(texts) for name, (p, _, _) in M.MARKERS.items() for m in re.finditer(rf"\b{p}\b", t))
    assert got == want
    head = spark.createDataFrame([("باش توا",)], "n string").select(M.explain(M.counts(F.col("n")), F.lit(2)).alias("e")).first()["e"]
    assert head.startswith("score=") and "future_bash" in head


def test_entities(spark):
    yes = "تونس تونسي التونسيين بتونس المغربية الجزائري لطفي!! تونس،".split()
    no = "نهار شمس حوار بيضا وليدي جده".split()
    assert one(spark, C.is_entity, *yes) == [True] * len(yes) and one(spark, C.is_entity, *no) == [False] * len(no)
    assert not AMBIGUOUS & set(ENTITIES)
    assert one(spark, C.clean_for_training, "يا لطفي!! نمشي ١٢ لتونس", None) == ["يا نمشي", ""]


def test_cleaning(spark):
    wiki = "{{a {{b}} c}}نص [[ملف:x.png|t]] [[p|q]] [[r]] [http://e l] [https://e.org] <ref>y</ref><ref name=x/> <!-- c -->\n== H ==\n* '''bold'''\n{| t\n|}"
    out = one(spark, C.strip_wikitext, wiki)[0]
    assert not re.search(r"[{}\[\]<>=]|png|http|''", out) and re.split(r"\s+", out.strip()) == ["نص", "q", "r", "l", "bold"]
    assert one(spark, C.clean_line, "@x #y http://z a b c d!!!! 😂", "a b", None) == ["a b c d!", None, None]
    assert one(spark, C.strip_label, "1; text", "-1\tx", "0 y", "12 z") == ["text", "x", "y", "12 z"]
    assert one(spark, C.clean_reply, "hello\nuser\nleak", "漢 ok！") == ["hello", "ok"]


def test_parsing(spark):
    p = one(spark, P.parse_prompt, "انظم القسيم.\nفي غرض «غزل» واجعل مطلعه هذا الشطر بنصّه", "اكتب تعريفًا نثريًّا موجزًا بـ«عنوان»", "?")
    assert (p[0]["genre"], p[0]["gharad"], p[0]["mode"], p[0]["region"]) == ("qasim", "غزل", "continue", None) and (p[1]["genre"], p[1]["title"], p[1]["mode"]) == ("prose", "عنوان", None) and p[2] is None
    q = one(spark, P.classify_quota, "429 retry in 3.5s", "PerDay RESOURCE_EXHAUSTED", "x")
    assert [tuple(x) for x in q] == [(True, 3.5, False), (True, None, True), (False, None, False)]
    df = spark.createDataFrame([(P.LOW,), (P.HIGH,), (0.95,), (0.80,), (0.90,)], "s double")
    rows = df.select(P.position(F.col("s")).alias("p"), P.zone(P.position(F.col("s"))).alias("z")).collect()
    assert abs(rows[0]["p"]) < 1e-9 and abs(rows[1]["p"] - 1) < 1e-9 and rows[2]["p"] > 1 and rows[3]["p"] < 0 and [r["z"] for r in rows[2:]] == ["high", "low", "centre"]
