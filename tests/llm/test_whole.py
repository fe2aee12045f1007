"""The registered queries do the whole job: small tables on which a cut would lose rows."""

from __future__ import annotations

import random

from lahja.llm import queries


def test_op4_counts_every_link(spark, tmp_path):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    near = [*base[:-2], "x", "y"]
    texts = {1: base, 5: base, 9: base, 3: near, 7: near, 11: [f"v{i}" for i in range(40)]}
    texts = {k: " ".join(t) for k, t in texts.items()}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op4_ngram_jaccard(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 4), (3, 1, 4), (5, 1, 4), (7, 1, 4), (9, 1, 4), (11, 11, 0)]
