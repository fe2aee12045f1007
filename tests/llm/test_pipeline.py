"""The pipeline against its stages by brute force, on a fixture in files."""

from __future__ import annotations

import random

import corpus_pipeline
from lahja.llm import bpe, langid

from .test_ops import SPOKEN, brute_leaks, gram_set


def fixture(spark, folder, rows, items):
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    text = lambda g, n: " ".join(rng.choice(SPOKEN[g].split()) + str(rng.randrange(30)) * (rng.random() < 0.3) for _ in range(n))
    items = [(0, text("en", 30)), (1, text("fr", 12))]
    rows = [(i, text(g, 60), g) for i, g in enumerate(list(SPOKEN) * 15)]
    rows += [(100 + i, rows[i][1], "en") for i in range(6)] + [(200 + i, rows[i][1] + " end", "en") for i in range(5, 10)] + [(300, f"{text('en', 10)} {items[0][1]} {text('en', 10)}", "en"), (301, None, "en"), (302, "", "fr"), (None, "the of and with these", "en")]
    sf = fixture(spark, tmp_path / "a", rows, items)
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = [r for r, (lang, _, margin) in zip(rows, model.classify([r[1] for r in rows])) if lang is not None and margin >= langid.MIN_MARGIN]
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(kept, key=order):
        first.setdefault(r[1], r)
    own = list(first.values())
    sets = [gram_set(r[1]) for r in own]
    root = list(range(len(own)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(own)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)), key=lambda i: order(own[i]))
                root[y] = x
    own = [r for i, r in enumerate(own) if top(i) == i]
    bad = {d for d, _ in brute_leaks([(r[0], r[1]) for r in own], items)}
    enc = bpe.encoding(bpe.load_ranks())
    want = sorted((str(r[0]), r[1], enc.encode_ordinary(r[1])) for r in own if r[0] not in bad)
    got = sorted((str(r["doc_id"]), r["text"], r["token_ids"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and bad


def test_pipeline_of_empty_tables_and_its_columns(spark, tmp_path):
    sf = fixture(spark, tmp_path / "b", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, columns named as those inside: each stage keeps what it has no ground to drop."""
    sf = fixture(spark, tmp_path / "c", [], [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa")])
    rng = random.Random(21)
    long = " ".join(rng.choice(SPOKEN["fr"].split()) + str(rng.randrange(999)) for _ in range(30_000))
    own = [(1, long), (1, long), (None, "le la des une maison"), (None, "le la des une maison"), (None, "autre chose ici même"), (2, None), (3, ""), (4, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y")]
    rows = [(i, t, "fr", "s", 1, "f", 2, "r", "k", 3) for i, t in own]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, uid int, row string, key string, cell int")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept[name] = sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in out.collect())
    say = lambda *which: sorted(str((i, (t or "")[:9])) for k, (i, t) in enumerate(own) if k in which)
    assert kept["exact dedup"] == say(0, 2, 4, 5, 6, 7) == kept["n-gram Jaccard join"]
    assert kept["benchmark decontamination"] == say(0, 1, 2, 3, 4, 5, 6)
    assert not {str((2, "")), str((3, ""))} & set(kept["language ID"])
