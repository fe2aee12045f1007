"""Row identity, readers, verse I/O, collection, commands and streams on small fixtures."""

from __future__ import annotations

import json
import random

import pytest

from lahja import cli
from lahja.operators import blocks as B
from lahja.operators import classifier as K
from lahja.operators import collect as C
from lahja.operators import poems, report, segments
from lahja.operators import triage as TR
from lahja.sources import readers
from lahja.streaming.units import grouped_units

from .test_operators import NEG, POS, walk


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i % 2 == 0, f"{(POS if i % 2 == 0 else NEG)[0]} {'ab'[i % 2]}{i // 2}") for i in range(24)]
    return K.train(spark.createDataFrame(rows, "p boolean, t string"), "p", "t", ("tn", "msa"))


# ---- rows of their own
def test_chunks_of_null_groups_and_shared_keys(spark):
    rng = random.Random(3)
    rows = [(g, 7 if i % 5 == 0 else i, " ".join(f"w{i}" for _ in range(rng.randrange(1, 50)))) for g in ("a", None, "b") for i in range(120)]
    out = B.chunk_lines(spark.createDataFrame(rows, "source string, i int, line string"), "source", ["i"], "line").collect()
    for g in ("a", None, "b"):
        own = sorted((r for r in out if r["source"] == g), key=lambda r: r["block"])
        assert [r["block"] for r in own] == list(range(len(own)))
        got = [x for r in own for x in r["text"].split("\n")]
        lines = [x for s, _, x in rows if s == g]
        assert not set(got) - set(lines) and all(sum(len(x.split()) for x in r["text"].split("\n")) == r["n_words"] and len(r["text"].split("\n")) == r["n_lines"] for r in own)
        assert walk(got, 60) == [r["text"] for r in own]  # one walk over the lines in their order cuts them alike
        assert sum(len(x.split()) for x in lines) - sum(r["n_words"] for r in own) < 30
    two = spark.createDataFrame([("s", 1, "a " * 80), ("s", 1, "b " * 80)], "source string, i int, line string")
    assert sorted((r["n_lines"], r["n_words"]) for r in B.chunk_lines(two, "source", ["i"], "line").collect()) == [(1, 80), (1, 80)]
    assert B.chunk_lines(two.limit(0), "source", ["i"], "line").count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_chunks_do_not_depend_on_partitions(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, " ".join("x" for _ in range(rng.choice([0, 1, 3, 30, 61, 200])))) for g in "abc" for i in range(rng.choice([1, 40, 150]))]
    df = spark.createDataFrame(rows, "source string, i int, line string")
    want = {(g, k): t for g in "abc" for k, t in enumerate(walk([x for s, _, x in rows if s == g], 60))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {(r["source"], r["block"]): r["text"] for r in B.chunk_lines(df, "source", ["i"], "line").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_segments_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "bonjour barcha"), (1, "ch7al merci"), (None, "le chat"), (None, "la maison")], "id int, text string")
    out = segments.segments(df, "id", "text").collect()
    texts = {None: ["le chat", "la maison"], 1: ["bonjour barcha", "ch7al merci"]}
    assert all(any(t[r["start"] : r["end"]] == r["text"] for t in texts[r["id"]]) for r in out) and sum(r["start"] == 0 for r in out) == 4
    french = [(r["id"], r["fragments"]) for r in segments.extract(df, "id", "text", "fr").collect()]
    assert len(french) == 4 and all(any("".join(f) in t for t in texts[i]) for i, f in french)


def test_measures_and_dispersion_of_null_and_repeated_ids(spark, model):
    long = "\n".join([POS[0]] * 10)
    df = spark.createDataFrame([(None, long), (None, NEG[0] * 2), (5, long), (5, long), (6, "x")], "id int, t string")
    found = TR.measures(df, "id", "t", model).collect()
    assert len(found) == 5 and all((r["score"] is not None) == (r["status"] == "measured") for r in found)
    spread = TR.block_dispersion(df, "id", "t", model).collect()
    assert sorted(str(r["id"]) for r in spread) == ["5", "5", "None"] and len({r["n"] for r in spread}) == 1
    assert len(TR.triage(df, "id", "t", model).collect()) == 5


# ---- scores within the scan
def test_index_scores_as_a_join_would(spark, model):
    w = {r["gram"]: r["w"] for r in model.weights.collect()}
    texts = [POS[0], NEG[0], "abc", "", None, "😂😂 ab cd", " x " * 400]
    sums, n = model.index().sums(texts)
    for t, s, k in zip(texts, sums.tolist(), n.tolist()):
        own = [f" {t.replace(' ', '_')} "[i : i + 4] for i in range(len(t) + 2 - 3)] if t is not None else []
        assert k == len(own) and s == sum(w.get(g, 0) for g in own)
    with pytest.raises(ValueError):
        K.Index([chr(i) * 8 for i in range(97, 1200)], [0] * 1103, 8)


def test_model_files(spark, model, tmp_path):
    path = f"{tmp_path}/m.json.gz"
    model.save(path)
    again = K.Model.load(spark, path)
    assert {tuple(r) for r in again.weights.collect()} == {tuple(r) for r in model.weights.collect()}
    assert again.params() == model.params()
    (tmp_path / "bare.json").write_text(json.dumps({"weights": {"abcd": 1.5}}))
    bare = K.Model.load(spark, f"{tmp_path}/bare.json")
    assert (bare.n, bare.threshold, bare.min_words, bare.labels) == (4, 0.5, 25, ("positive", "negative")) and bare.weights.first()["w"] == 1_500_000_000


# ---- reports
def test_last_measure_and_worst_positive(spark):
    rows = [("m", "1", "implicite", True, 0.5, 1), ("m", "1", "explicite", True, 0.9, 2), ("m", "1", "explicite", True, 0.8, 3), ("m", "1", "implicite", True, None, 9)]
    v = spark.createDataFrame(rows, "model string, prompt_id string, condition string, scorable boolean, score double, pos int")
    assert report.paired_shifts(v, "pos").first()["median_delta"] == 0.3 == report.paired_shifts(v.coalesce(1)).first()["median_delta"]
    by = spark.createDataFrame([("neg", 0.0), ("p1", 0.95), ("p2", 0.91)], "source string, above_threshold double")
    assert tuple(report.worst_source(by, ["p1", "p2"]).first()) == ("p2", 0.91, True)


# ---- readers
def test_text_of_json_and_of_sparse_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "short", "meta": {"deep": "a much longer string"}, "n": 5, "same": "truly"}\n{broken\n"alone"\n{"a": 1}\n[1]\n\n')
    assert sorted(r["line"] for r in readers.read_json_text(spark, f"{tmp_path}/a.jsonl").collect()) == ["alone", "short"]
    sparse = spark.createDataFrame([("b" * 300 if i % 10 == 0 else None, "o" * 60) for i in range(50)], "body_ string, other string")
    assert readers.best_text_column(sparse, by_name=False, missing_is_empty=False) == "body_"
    assert readers.best_text_column(sparse, by_name=False) == "other"


def test_environment_and_volume(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B = 'two'\nC=3\nbad\n")
    env = {"C": "kept"}
    assert readers.read_env(f"{tmp_path}/.env", env) == ["A", "B"] and env == {"A": "1", "B": "two", "C": "kept"}
    assert tuple(readers.generated_volume(spark.createDataFrame([("a b " * 60,), ("c",)], "t string"), "t", goal=2).first()) == (2, 121, 2, True)


def test_verse_from_a_markdown_tree_and_back(spark, tmp_path):
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "a.md").write_text('---\nuid: u1\ngenre: "القسيم"\npoet: فلان\n---\n# عنوان\n\nبيت أول\nبيت ثان\n', encoding="utf-8")
    (tmp_path / "d" / "b.md").write_text("no head at all\n", encoding="utf-8")
    got = poems.from_markdown(readers.read_markdown_tree(spark, f"{tmp_path}/d")).collect()
    assert [(r["genre"], r["poet"], r["uid"], r["title"], r["n_lines"], r["n_words"], r["is_usul"]) for r in got] == [("qasim", "فلان", "u1", "عنوان", 2, 4, True)]
    poems.write_corpus(spark.createDataFrame(got, poems.from_markdown(readers.read_markdown_tree(spark, f"{tmp_path}/d")).schema), f"{tmp_path}/out", "tree")
    one = spark.read.json(f"{tmp_path}/out/corpus.jsonl").first()
    assert one["source"] == "tree" and one["text"] == got[0]["text"]
    made = json.loads(spark.read.text(f"{tmp_path}/out/report.json").first()[0])
    assert made["n_texts"] == 1 and made["by_genre"] == {"qasim": 1} and made["coverage"]["poet"] == {"n": 1, "pct": 100.0}
    assert sorted(spark.read.option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out/corpus.csv", header=True).columns) == sorted(poems.COLUMNS)


def test_fingerprints_give_uids(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps({"references": {"source_fingerprint": f, "source_uid": u}}) for f, u in (("f1", "a"), ("f1", "b"), ("", "c"))))
    index = readers.read_fingerprints(spark, str(tmp_path))
    entries = spark.createDataFrame([("f1", None), ("f2", None)], "text string, uid string")
    assert {r["text"]: r["uid"] for r in poems.attach_uids(entries, index, lambda t: t).collect()} == {"f1": "b", "f2": None}
    with pytest.raises(Exception):
        readers.read_examples(spark, f"{tmp_path}/none").collect()


# ---- collection
@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(f"p{i}", "c", "arabe", f"say {i}") for i in range(4)], "id string, category string, script string, text string")


def test_collect_resumes_retries_and_gives_up(spark, prompts, tmp_path):
    out, naps = f"{tmp_path}/log.jsonl", []
    slow = C.Scripted("slow", [C.RateLimited("wait", 1.5), C.RateLimited("wait"), "ok"])
    dead = C.Scripted("dead", [C.ProviderError("no")])
    spent = C.Scripted("spent", ["ok", C.RateLimited("daily", exhausted=True)])
    found = C.collect(spark, [slow, dead, spent], prompts, out, ["implicite"], sleep=naps.append)
    assert naps == [1.5, C.FALLBACK_DELAY] and found.succeeded == {"slow": 4, "spent": 1} and set(found.abandoned) == {"dead", "spent"}
    assert dead.calls == 3 and spent.calls == 2 and found.calls == 4 + 3 + 2
    assert readers.read_replies(spark, out).count() == 9
    with open(out, "a") as f:
        f.write('{"prompt_id": "cut')
    again = C.collect(spark, [C.Scripted("slow", ["ok"])], prompts, out, ["implicite", "explicite"])
    assert again.calls == 4
    with pytest.raises(KeyError):
        C.collect(spark, [slow], prompts, out, ["odd"])


def test_relay_measures_so_many_models(spark, prompts, tmp_path):
    made = {"a": C.Scripted("a", ["ok", C.RateLimited("x", exhausted=True)]), "b": C.Scripted("b", ["ok"]), "c": C.Scripted("c", ["ok"])}

    def build(spec):
        if spec not in made:
            raise C.ProviderError("unknown")
        return made[spec]

    assert C.relay(spark, ["z", "a", "b", "c"], build, prompts, f"{tmp_path}/r.jsonl", 1, conditions=["implicite"]) == {"z": "unknown", "a": "quota exhausted", "b": "complete"}
    made["a"] = C.Scripted("a2", [C.RateLimited("x", exhausted=True)])
    assert C.relay(spark, ["a", "b"], build, prompts, f"{tmp_path}/s.jsonl", 1, conditions=["implicite"]) == {"a": "account exhausted"}


# ---- commands
def test_commands(spark, model, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    staged, cache = tmp_path / "staged", str(tmp_path / "cache")
    for key, text in (("tsac", POS[0]), ("mac", NEG[0]), ("omcd", NEG[0])):
        (staged / key).mkdir(parents=True)
        name = "a.txt"
        (staged / key / name).write_text("\n".join(f"{text} {chr(0x627 + i % 20)}{chr(0x628 + i % 7)}" for i in range(80)), encoding="utf-8")
    assert cli.main(["data", "fetch", "--only", "tsac,mac,omcd", "--staged", str(staged), "--cache", cache]) == 0
    assert cli.main(["data", "list", "--cache", cache]) == 0
    assert '"vs_moroccan_tw"' in capsys.readouterr().out
    assert cli.main(["data", "build", "--cache", cache, "--contrast", "vs_moroccan_tw", "--out", f"{tmp_path}/built"]) == 0
    assert spark.read.parquet(f"{tmp_path}/built").select("cls", "split").distinct().count() == 4
    path = f"{tmp_path}/m.json.gz"
    cli.main(["data", "train", "--cache", cache, "--contrast", "vs_moroccan_tw", "--out", path])
    assert K.Model.load(spark, path).meta["contrast"] == "vs_moroccan_tw"
    assert cli.main(["data", "validate", "--cache", cache, "--model", path]) in (0, 1)
    assert '"worst": "tsac"' in capsys.readouterr().out
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"id": f"p{i}", "category": "c", "script": "arabe", "text": "?"}) for i in range(3)))
    assert cli.main(["prompts", f"{tmp_path}/p.jsonl"]) == 0
    assert cli.main(["run", "--prompts", f"{tmp_path}/p.jsonl", "--model", "fake:m=ok", "--out", f"{tmp_path}/log.jsonl", "--limit", "2", "--yes"]) == 0
    assert '"calls": 4' in capsys.readouterr().out
    (tmp_path / "docs.txt").write_text("\n".join([POS[0]] * 5), encoding="utf-8")
    assert cli.main(["triage", f"{tmp_path}/docs.txt", "--model", path, "--limit", "3", "--out", f"{tmp_path}/v"]) == 0
    assert spark.read.json(f"{tmp_path}/v").count() == 3
    assert cli.main(["triage", f"{tmp_path}/docs.txt", "--model", path, "--group", "20"]) == 0
    assert cli.main(["data", "budget"]) == 0


def test_markers_have_labels_or_fall_back(spark):
    from lahja.functions import markers as M

    hits = spark.createDataFrame([("quant_barsha", "lexicon"), ("ok_yakhi", "lexicon"), ("win", "function word")], "marker string, category string")
    got = {r["marker"]: (r["label"], r["category_label"]) for r in M.describe(hits).collect()}
    assert got == {"quant_barsha": (M.LABELS["quant_barsha"], "معجم"), "ok_yakhi": ("isn't it", "معجم"), "win": ("win", "function word")}


# ---- stream
def test_units_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"source": s, "id": f"{k}{i}", "text": "w " * 25}) for i in range(2) for s in ("a", None)))
    raw = spark.readStream.schema("source string, id string, text string").option("maxFilesPerTrigger", 1).json(str(folder))
    q = grouped_units(raw, 60).writeStream.format("memory").queryName("units").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("units").collect()
    assert sorted(str(r["source"]) for r in got) == ["None", "None", "a", "a"] and all(r["n_words"] == 75 and r["unit"].endswith("+3") for r in got)
