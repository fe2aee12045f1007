"""The queries take whole texts and whole tables: small tables on which a cut would lose rows."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from lahja import catalogue

from .test_catalogue import rows

SEGMENTED = ["segments", "lang_profile", "code_switched", "extract_fr"]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("long"))
    text = "le chat de la maison mange " * 12 + "ch7al w 3lech barcha, bonjour 漢 " * 6
    own = [(3, text), (1_000_003, "merci beaucoup " + text), (17, "hello")]
    spark.createDataFrame([(i, t, "fr", "s") for i, t in own], "doc_id bigint, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    return sf


@pytest.mark.parametrize("name", SEGMENTED)
def test_whole_texts_are_segmented(spark, long_texts, name):
    got = catalogue.queries()[name](spark, long_texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{long_texts}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_report_of_whole_texts(spark, long_texts):
    report = {r["doc_id"]: r for r in catalogue.queries()["detect_report"](spark, long_texts).collect()}
    profile = {r["doc_id"]: r for r in catalogue.queries()["lang_profile"](spark, long_texts).collect()}
    assert len(report) == 6 and report.keys() == profile.keys()
    assert all(report[k][f"lang_{x}"] == profile[k][x] for k in report for x in ("ar", "fr", "arabizi", "unknown"))


@pytest.fixture(scope="module")
def long_talks(spark, tmp_path_factory):
    """Conversations of one to seven replies, of 30 words each."""
    sf = str(tmp_path_factory.mktemp("talks"))
    turns = [(c, 2 * k + side, ("user", "assistant")[side], f"r{c} t{k} " + "mot et autre " * 10) for c in range(1, 40) for k in range(1 + c % 7) for side in (0, 1)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    words = ("le chat dort dans la maison blanche ", "el perro duerme en la casa grande ")
    spark.createDataFrame([(i, words[i % 2] * 8, ("fr", "es")[i % 2], "s") for i in range(40)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    return sf, [t for t in turns if t[2] == "assistant"]


def test_every_reply_is_judged_and_counted(spark, long_talks):
    from lahja.plans import views

    sf, said = long_talks
    own = views.replies(spark, sf).collect()
    assert sorted(r["reply"] for r in own) == sorted(t[3] for t in said)
    assert [r["reply"] for r in sorted(own, key=lambda r: r["pos"])] == [t[3] for t in sorted(said)]
    assert len({r["pos"] for r in own}) == len({(r["prompt_id"], r["condition"]) for r in own}) == len(said)
    ran = sum(t[0] % 17 > 0 for t in said)
    run = lambda name: catalogue.queries()[name](spark, sf).collect()
    assert len(run("reply_verdicts")) == ran
    assert sum(r["n"] for r in run("bench_cells")) == len(said)
    assert sum(r["n"] for r in run("by_register")) == ran
    assert sum(r["n_pairs"] for r in run("paired_shift")) == sum((1 + c % 7) // 2 for c in range(1, 40) if c % 17)
    assert len(run("split_by_prompt")) == len(said)
    assert sum(r["calls"] for r in run("abandon_replay")) == len(said)


def test_every_block_of_a_source_counts(spark, tmp_path):
    words = ("le chat dort dans la maison blanche " * 9, "el perro duerme en la casa grande " * 9)  # 63 words: a block each
    own = [(i, words[i > 4100], ("fr", "es")[i > 4100], "hot" if i <= 4100 else "cold") for i in range(1, 4151)]
    spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["n"] for r in catalogue.queries()["score_by_source"](spark, str(tmp_path)).collect()}
    assert got == {"hot": 4100, "cold": 50}


def test_every_text_is_indexed(spark, tmp_path):
    own = [(i, f"text {max(i, 3)}", "fr", "s") for i in range(1, 11)]
    spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["text_md5"]: r["uid"] for r in catalogue.queries()["poem_uid_join"](spark, str(tmp_path)).collect()}
    assert got == {hashlib.md5(t.encode()).hexdigest(): f"u{i}" for i, t, _, _ in own[2:]}


def test_texts_that_are_not_indexed_have_no_uid(spark):
    from lahja.operators import poems

    entries = spark.createDataFrame([("a", None), ("b", None), ("c", "own")], "text string, uid string")
    index = spark.createDataFrame([(1, "a", "u1"), (2, "a", "u2"), (3, "z", "u3"), (4, None, "u4")], "pos bigint, fingerprint string, uid string")
    got = {r["text"]: r["uid"] for r in poems.attach_uids(entries, index, lambda t: t).collect()}
    assert got == {"a": "u2", "b": None, "c": "own"}
