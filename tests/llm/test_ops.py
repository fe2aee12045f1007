"""Each operator against a brute-force version and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lahja.llm import bpe, chat, decontaminate, exact_dedup, huffman, langid, line_dedup, ngram_join, pii, toxicity
from lahja.llm._text import Words, mix, pretokens, string_hash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, uid int, row string, id int, digit string, language_id string, k int"


def docs(spark, rows):
    """Documents (id, text[, lang]) with columns that clash with names used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None, "x", 1, "r", 7, "d", "l", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, "  \n "), (5, "x" * 200_000)]


# ---- 1 exact dedup
def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 63, 64, 65, 511, 512, 513, 5000)]
    rows = [(i, rng.choice(base) + rng.choice(["", "a", "é"])) for i in range(200)]
    kept = exact_dedup.exact_dedup(docs(spark, rows), first_bytes=8)
    want = {}
    for i, t in rows:
        want[t] = min(i, want.get(t, i))
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == sorted(want.items())
    assert kept.columns == docs(spark, rows).columns
    gone = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_copies(docs(spark, rows)).collect()}
    assert gone == {(i, want[t]) for i, t in rows if want[t] != i}


def test_exact_dedup_edges(spark):
    rows = sorted((r["doc_id"] or 0, r["text"]) if r["text"] else (r["doc_id"], r["text"] or "") for r in exact_dedup.exact_dedup(docs(spark, EDGE + [(6, ""), (7, None), (8, "x" * 200_000)])).collect())
    assert rows == [(1, ""), (2, ""), (3, "a"), (4, "  \n "), (5, "x" * 200_000), (7, "")]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0 == exact_dedup.exact_copies(docs(spark, [])).count()


# ---- 2 byte-level BPE
def test_bpe_equals_tiktoken_and_round_trips(spark):
    enc = bpe.encoding(bpe.load_ranks())
    rng = random.Random(2)
    odd = ["it's we'll I'M", "  two\n\n  lines \t", "été 日本語 ½ 12ab", "a" * 3000, "'s 's", "  x", "😂 ok"]
    rows = [(i, t) for i, t in enumerate(odd + [words(rng, 50) + rng.choice(odd) for _ in range(40)])] + [(100, None), (101, ""), (0, odd[0]), (None, "n")]
    out = bpe.decode(bpe.encode(docs(spark, rows), block_chars=2000)).collect()
    assert len(out) == len(rows)
    by = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["token_ids"]) for r in out), key=str)
    want = sorted(((i is None, i or 0, t or "", None if t is None else enc.encode_ordinary(t)) for i, t in rows), key=str)
    assert by == want
    assert bpe.encode(docs(spark, [])).count() == 0
    local = bpe.encode_local(docs(spark, rows), words=3).collect()
    assert sorted(str(r["token_ids"]) for r in local) == sorted(str(x[3]) for x in want)


def test_bpe_of_a_very_long_text_of_distinct_words(spark):
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(2, 12))) for _ in range(60_000))
    rows = [(1, text), (1, text), (2, None)]
    out = bpe.decode(bpe.encode(docs(spark, rows), block_chars=100_000)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == [(1, text), (1, text), (2, "")]
    assert [r["token_ids"] for r in out if r["doc_id"] == 1][0] == bpe.encoding(bpe.load_ranks()).encode_ordinary(text)


def test_pretokens_follow_the_pattern():
    import regex

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1'sdlrevmt  \n.é") for _ in range(rng.randrange(30))) for _ in range(500)]
    cp, s, e, first = pretokens(texts)
    got = [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(s, e)]
    for i, t in enumerate(texts):
        assert got[first[i] : first[i + 1]] == regex.findall(bpe.PATTERN, t)


# ---- 3 decontamination
def brute_leaks(texts, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in texts:
        for b, i in items:
            w, v = tok(t), tok(i)
            if len(v) < 8:
                if v and v in [tok(line) for line in (t or "").split("\n")]:
                    out.add((d, b))
                continue
            span = min(16, len(v))
            need = span - 3 * span // 16
            for shift in range(-len(v), len(w)):
                same = [0 <= p + shift < len(w) and w[p + shift] == v[p] for p in range(len(v))]
                if any(sum(same[p : p + span]) >= need for p in range(len(v))):
                    out.add((d, b))
                    break
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate((1, 3, 7, 8, 12, 15, 16, 40))] + [(None, words(rng, 9, 5000))]
    rows = []
    for k in range(80):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = "zz" if rng.random() < 0.5 else own[0]
        sep = rng.choice([" ", "\n", "!\n"])
        rows.append((k, f"{words(rng, 20, 5000)}{sep}{' '.join(own).title()}{sep}{words(rng, 20, 5000)}" if k % 3 else words(rng, 60, 5000)))
    rows += [(1000, items[5][1]), (1001, " ".join(items[7][1].split()[:15])), (1002, words(rng, 30_000, 5000) + " " + items[6][1] + " " + words(rng, 9, 5000))]
    repeated = [(None, items[4][1]), (None, items[4][1]), (1000, items[5][1])]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, " -- ")], "item_id bigint, text string")
    found = decontaminate.leaks(docs(spark, rows + repeated + EDGE), bench).collect()
    want = brute_leaks(rows + repeated + EDGE, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) > 20
    assert (1002, 6) in want and (None, 4) in want and any(i is None for _, i in want) and any(i in (0, 1, 2) for _, i in want)
    frame = docs(spark, rows + repeated + EDGE).withColumn("key", F.lit(1)).withColumn("__leak", F.lit(2))
    clean = decontaminate.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    dirty = {t for d, t in rows + repeated + EDGE if any(x == d for x, _ in brute_leaks([(d, t)], items))}
    assert sorted(str((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(str(r) for r in rows + repeated + EDGE if r[1] not in dirty)
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0


def test_masks_are_lossless():
    from itertools import combinations

    for n in range(8, 17):
        span, need = decontaminate.limits(n)
        masks = decontaminate.masks_for(n)
        for lost in combinations(range(span), span - need):
            assert any(not {p + o for o in m} & set(lost) for m in masks for p in range(span - m[-1])), (n, lost)


# ---- 4 n-gram Jaccard join
def gram_set(t, n=3):
    w = [x for x in re.findall(r"[^\W_]+", (t or "").lower())]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components_of(nodes, pairs):
    root = {i: i for i in nodes}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in nodes}


@pytest.mark.parametrize("chunk,bits", [(512, 64), (3, 64), (512, 5)])
def test_jaccard_join_against_brute_force(spark, chunk, bits):
    """Also with cells cut into chunks, and with names so short that different sets share them."""
    rng = random.Random(5)
    rows, seeds = [], [words(rng, n, 60).split() for n in (2, 5, 30, 80, 200)]
    for k in range(90):
        own = list(rng.choice(seeds))
        for _ in range(rng.randrange(1 + len(own) // 10)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(own)))
    extra = [(200, None), (201, "")]
    more = dict(rare=2, chunk=chunk, bits=bits)
    pairs = {(r["id_a"], r["id_b"]): r["jaccard"] for r in ngram_join.near_pairs(docs(spark, rows + extra), expand=True, **more).collect()}
    sets = {i: gram_set(t) for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in want.items() if j >= 0.5}
    assert pairs.keys() == want.keys() and all(abs(pairs[p] - j) < 1e-5 for p, j in want.items())
    root = components_of(sets, want)
    found = ngram_join.near_docs(docs(spark, rows + extra), **more).collect()
    assert sorted(tuple(r) for r in found) == sorted([(i, root[i], sum(i in p for p in want)) for i in sets] + [(200, 200, 0), (201, 201, 0)])
    kept = {r["doc_id"] for r in ngram_join.drop_near(docs(spark, rows), **more).collect()}
    assert kept == set(root.values())


def test_jaccard_join_of_a_hot_group(spark):
    """Near copies of one text, more than two chunks; each pair shares many leaders."""
    rng = random.Random(15)
    base = words(rng, 60, 10_000).split()
    rows = [(i, " ".join([*base[: 50 + i % 3], *words(rng, 6, 10_000).split()])) for i in range(150)]
    sets = {i: gram_set(t) for i, t in rows}
    near = {i: sum(len(s & t) >= 0.5 * len(s | t) for t in sets.values()) - 1 for i, s in sets.items()}
    for chunk in (40, 512):
        found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_docs(docs(spark, rows), chunk=chunk).collect()}
        assert found == {i: (0, near[i]) for i in sets} and min(near.values()) > 100


def test_jaccard_join_edges(spark):
    out = ngram_join.drop_near(docs(spark, EDGE))
    assert sorted(str((r["doc_id"], len(r["text"] or ""))) for r in out.collect()) == sorted(["(1, 0)", "(2, 0)", "(3, 1)", "(4, 4)", "(5, 200000)"])
    assert out.columns == docs(spark, []).columns
    empty = docs(spark, [])
    assert ngram_join.drop_near(empty).count() == ngram_join.near_pairs(empty).count() == ngram_join.near_docs(empty).count() == 0
    found = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in ngram_join.near_docs(docs(spark, EDGE + [(None, "b c"), (None, "b c")])).collect())
    assert found == sorted([("1", "1", 0), ("2", "2", 0), ("3", "3", 2), ("3", "3", 2), ("None", "3", 2), ("4", "4", 0), ("5", "5", 0), ("None", "None", 1), ("None", "None", 1)])
    twice = [(1, "same words here now"), (1, "other words there then"), (2, "same words here now"), (2, "a third one of these"), (None, "same words here now"), (None, "quite alone it is")]
    left = sorted((str(r["doc_id"]), r["text"]) for r in ngram_join.drop_near(docs(spark, twice)).collect())
    assert left == sorted([("1", twice[0][1]), ("1", twice[1][1]), ("2", twice[3][1]), ("None", twice[5][1])])


def thue_morse(n, swap=False):
    out = "a"
    while len(out) < n:
        out += out.translate({97: 98, 98: 97})
    return out[:n].translate({97: 98, 98: 97}) if swap else out[:n]


def test_structured_strings_do_not_meet(spark):
    """Strings of Thue and Morse and their complements collide under any polynomial modulo a power of two."""
    pairs = [(thue_morse(n), thue_morse(n, True)) for n in (1024, 4096)]
    rows = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark, rows))).collect()} == dict(rows)
    enc = bpe.encoding(bpe.load_ranks())
    assert {r["doc_id"]: r["token_ids"] for r in bpe.encode_local(docs(spark, rows)).collect()} == {i: enc.encode_ordinary(t) for i, t in rows}
    assert ngram_join.near_pairs(docs(spark, rows)).count() == 0 and ngram_join.drop_near(docs(spark, rows)).count() == 4
    long = [(k, " ".join([t] * 20)) for k, t in enumerate(pairs[0])]
    bench = spark.createDataFrame([(7, long[0][1])], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, long), bench).collect()] == [(0, 7)]


# ---- 5 chat
def test_preferences(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, t int, k int"
    base = [(1, 0, "system", "s"), (1, 1, "user", "é?"), (1, 2, "assistant", "good"), (2, 0, "user", "u"), (2, 1, "assistant", "a"), (3, 0, "user", "same"), (None, 0, "user", "x"), (4, 0, None, None), (5, 0, "user", "only")]
    other = [(1, 0, "system", "s"), (1, 1, "user", "é?"), (1, 2, "assistant", "bad one"), (1, 3, "user", "again"), (2, 0, "user", "u"), (3, 0, "user", "same"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    frame = lambda rows: spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema)
    out = {r["conv_id"]: r for r in chat.preferences(frame(base), frame(other)).collect()}
    assert sorted(out) == [1, 2, 4]
    one = out[1]
    assert one["n_common"] == 2 and one["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\né?<|im_end|>\n<|im_start|>assistant\n"
    assert one["chosen"] == "good<|im_end|>\n" and [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["good<|im_end|>"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["bad one<|im_end|>"] and one["rejected"].endswith("again<|im_end|>\n")
    assert out[2]["rejected"] == "" and out[2]["rejected_mask"] == [] and out[2]["chosen"] == "<|im_start|>assistant\na<|im_end|>\n"
    assert out[2]["chosen"][out[2]["chosen_mask"][0]["start"] :].startswith("a<|")
    assert out[4]["chosen"] == "<|im_start|>unknown\n<|im_end|>\n"
    ties = chat.preferences(frame(base), frame(base), keep_ties=True).collect()
    assert len(ties) == 5 and all(r["chosen"] == r["rejected"] == "" for r in ties)
    assert chat.preferences(frame([]), frame(other)).count() == 0


def test_preferences_of_very_long_texts(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    long = "wörd " * 60_000
    base = [(1, 0, "user", long), (1, 1, "assistant", long + "a"), (1, 1, "assistant", long + "a")]
    other = [(1, 0, "user", long), (1, 1, "assistant", long + "b"), (1, 2, "assistant", long)]
    r = chat.preferences(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)).first()
    assert r["n_common"] == 1 and r["prompt"].count("wörd") == 60_000
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_mask"]] == [long + "a<|im_end|>"] * 2
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_mask"]] == [long + "b<|im_end|>", long + "<|im_end|>"]


# ---- 6 Huffman
def test_huffman_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 300):
        c = rng.integers(1, 2000, n)
        h = [(int(x), i, [i]) for i, x in enumerate(c)]
        heapq.heapify(h)
        best = np.zeros(n, int)
        while len(h) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(h), heapq.heappop(h)
            best[x + y] += 1
            heapq.heappush(h, (a + b, i, x + y))
        assert (c * huffman.code_lengths(c, 30)).sum() == (c * best).sum()
    lengths = huffman.code_lengths(2.0 ** np.arange(30), 6)
    assert lengths.max() == 6 and (0.5**lengths).sum() <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_huffman_round_trip_and_checkpoints(spark):
    rng = random.Random(6)
    rows = [(i, [int(rng.expovariate(0.02)) for _ in range(rng.choice([1, 127, 128, 129, 1000]))]) for i in range(30)] + [(40, None), (41, []), (None, [1]), (0, [1, 2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, token_ids array<int>, payload string")
    counts = huffman.count_ids(df)
    code = huffman.Code.of(counts)
    assert sum(counts.values()) == sum(len(x or []) for _, x in rows)
    out = huffman.decode(huffman.encode(df, code, block_tokens=300, stride=16), code, stride=16).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: r["block"]):
        if r["doc_id"] not in (0, None):
            got[r["doc_id"]] = None if r["payload"] is None else (got.get(r["doc_id"]) or []) + r["token_ids"]
    assert got == {i: x for i, x in rows if i not in (0, None)}
    plain, flat = df.where("doc_id is not null"), F.udf(lambda x: None if x is None else np.array(x, "<i4").tobytes(), "binary")
    same = huffman.encode(plain.withColumn("token_ids", flat("token_ids")), code).select("doc_id", "block", "payload")
    assert same.exceptAll(huffman.encode(plain, code).select("doc_id", "block", "payload")).isEmpty() and huffman.count_ids(plain.withColumn("token_ids", flat("token_ids"))) == huffman.count_ids(plain)
    big = max(out, key=lambda r: r["n_tokens"] or 0)  # a stretch decodes alone
    k = 5
    part = code.decode([big["payload"]], np.array([16]), np.array([big["checkpoints"][k]]), 16)
    assert part.tolist() == big["token_ids"][16 * k : 16 * k + 16]
    one = huffman.Code.of({7: 3})
    assert one.decode(*(lambda p, b, o: (p, np.array([3]), o[:1], 128))(*one.encode(np.array([7, 7, 7]), np.array([0, 3])))).tolist() == [7, 7, 7]
    assert huffman.encode(df.limit(0), huffman.Code.of(huffman.count_ids(df.limit(0)))).count() == 0


def test_huffman_of_a_document_of_several_blocks(spark):
    rng = random.Random(16)
    ids = [int(rng.expovariate(0.01)) for _ in range(2 * huffman.BLOCK_TOKENS + 77)]
    df = spark.createDataFrame([(1, ids), (1, ids[:5])], "doc_id bigint, token_ids array<int>")
    code = huffman.Code.of(huffman.count_ids(df))
    out = huffman.decode(huffman.encode(df, code), code).collect()
    assert [r["n_tokens"] for r in sorted(out, key=lambda r: (-r["n_tokens"], r["block"]))] == [huffman.BLOCK_TOKENS, huffman.BLOCK_TOKENS, 77, 5]
    long = sorted((r for r in out if r["n_tokens"] != 5), key=lambda r: r["block"])
    assert [i for r in long for i in r["token_ids"]] == ids


def test_huffman_query_gives_the_ids_back(spark, tmp_path):
    from lahja.llm import queries

    rows = [(1, "one two two three"), (2, None), (3, ""), (4, "été " * 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = bpe.encoding(bpe.load_ranks())
    got = {r["doc_id"]: r["token_ids"] for r in queries.op6_token_huffman(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else enc.encode_ordinary(t) for i, t in rows}


# ---- 7 line dedup
def brute_lines(rows, tau=2, per=12):
    inst = [((i is None, i or 0, n), x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip()]
    first: dict = {}
    for at, x in inst:
        first[x] = min(at, first.get(x, at))
    out = set()
    for at, x in inst:
        near = [f for y, f in first.items() if y == x or (abs(len(x) - len(y)) <= tau and line_dedup._plain(list(map(ord, x)), list(map(ord, y))) <= min(tau, min(len(x), len(y)) // per))]
        if min(near) != at:
            out.add((at[1] if not at[0] else None, at[2], min(near)[1], min(near)[2]))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (10, 12, 13, 23, 24, 25, 30, 60, 200)]

    def edit(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        return "".join(x) or "q"

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(6)))) for i in range(60)] + [(70, None), (71, "\n \n")]
    found = {(r["doc_id"], r["line_no"], r["keep_id"], r["keep_line_no"]) for r in line_dedup.near_lines(docs(spark, rows)).collect()}
    want = brute_lines(rows)
    assert found == want and want
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    gone = {(d, n) for d, n, _, _ in want}
    assert left == {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(docs(spark, EDGE))
    assert out.count() == len(EDGE) and out.columns == docs(spark, []).columns
    assert sorted(r["text"] for r in out.collect() if r["doc_id"] in (3, None)) == ["", "", "a"]
    assert line_dedup.near_lines(docs(spark, [])).count() == 0 == line_dedup.dedup_lines(docs(spark, [])).count()


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    xs = ["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(500)]
    ys = ["".join(c for c in x if rng.random() > 0.05) + rng.choice(["", "a", "bb"]) for x in xs]
    want = [min(tau + 1, line_dedup._plain(list(map(ord, x)), list(map(ord, y)))) for x, y in zip(xs, ys)]
    assert line_dedup.distances(xs, ys, tau).tolist() == want


# ---- 8 personal data
def test_pii_on_held_out_texts():
    net = pii.trained()
    held = pii.labelled(99, 100)
    found = pii.find(net, [t for t, _ in held])
    want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans}
    got = {(i, *s) for i, spans in enumerate(found) for s in spans}
    assert len(want & got) / len(want) > 0.85 and len(want & got) / max(1, len(got)) > 0.85


def test_pii_on_templates_that_are_not_trained_on():
    """Sentences and values written by hand; harmless ones have no span."""
    own = [
        ("email", "Bitte an Petra.Schulz@firma-nord.de schreiben", "Petra.Schulz@firma-nord.de"), ("email", "contact: q_a@lists.uni.edu; thanks", "q_a@lists.uni.edu"), ("phone", "appelez le +33 6 12 34 56 78 demain", "+33 6 12 34 56 78"),
        ("phone", "Her number is (212) 736-5000 in the city", "(212) 736-5000"), ("phone", "ring 020 7946 0958 after six", "020 7946 0958"), ("ip", "ping 192.168.17.5 timed out", "192.168.17.5"), ("ip", "route via 10.0.0.138 only", "10.0.0.138"),
        ("card", "paid with 4111 1111 1111 1111 yesterday", "4111 1111 1111 1111"), ("card", "number 5500005555555559 expired", "5500005555555559"), ("account", "the form says 078-05-1120 there", "078-05-1120"), ("account", "to DE89370400440532013000 please", "DE89370400440532013000"),
        ("secret", 'config: token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("secret", "export with d41d8cd98f00b204e9800998ecf8427e inside", "d41d8cd98f00b204e9800998ecf8427e"),
    ]
    found = pii.find(pii.trained(), [t for _, t, _ in own])
    hits = sum((kind, t.index(v), t.index(v) + len(v)) in spans for (kind, t, v), spans in zip(own, found))
    assert hits >= 10, [(t, f) for (_, t, _), f in zip(own, found)]
    plain = ["The committee met in 1987 and again on 12/05/2004.", "Licensed under the Apache License, Version 2.0.", "It costs $12.50 or 15% less at 10:30.", "Donaudampfschifffahrtsgesellschaft und andere", "see http://example.org/page?x=12 for more"]
    assert sum(map(len, pii.find(pii.trained(), plain))) <= 1


def test_pii_windows_and_edges(spark):
    value = "jane.doe42@mail3.example.com"
    long = "plain words here " * 3000
    rows = [(1, long + value + " " + long), (2, None), (3, ""), (4, "no value at all"), (None, f"write to {value} now"), (None, f"write to {value} now")]
    out = pii.spans(docs(spark, rows)).collect()
    assert [(r["doc_id"], r["value"]) for r in out if r["kind"] == "email"].count((None, value)) == 2 and (1, value) in {(r["doc_id"], r["value"]) for r in out}
    assert {r["doc_id"] for r in out} <= {1, None}
    frame = docs(spark, rows)
    red = pii.redact(frame)
    assert red.columns == frame.columns
    red = {r["doc_id"]: r["text"] for r in red.collect()}
    assert red[4] == "no value at all" and red[2] is None and value not in red[1]
    assert pii.spans(docs(spark, [])).count() == 0


def test_pii_value_across_window_seams():
    net = pii.trained()
    value = "jane.doe42@mail3.example.com"
    for pad in range(pii.STRIDE - 30, pii.WIDTH + 10, 7):
        text = ("ab cde " * 200)[:pad] + " " + value + " " + "fgh ij " * 60
        assert ("email", pad + 1, pad + 1 + len(value)) in pii.find(net, [text])[0]


def test_best_path_of_a_text_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    for trial in range(60):
        net = pii.Tagger(trial, hidden=2, tags=3)
        net.p["move"], net.p["begin"] = rng.normal(0, 1, (3, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32)
        sizes = np.array([0, 5, 1, 4])
        e = rng.normal(0, 1, (3, 10)).astype(np.float32)
        e[0] += 4 * (rng.random(10) < 0.5)  # characters that are certain
        got, at = net.best(e, sizes), 0
        for n in sizes.tolist():
            score = lambda p: sum(e[x, at + i] for i, x in enumerate(p)) + (net.p["begin"][p[0]] if p else 0) + sum(net.p["move"][a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            best = max(product(range(3), repeat=n), key=score)
            assert abs(score(best) - score(tuple(got[at : at + n].tolist()))) < 1e-4
            at += n


def test_pii_scores_are_those_of_the_plain_network():
    """Decoding has its own gates, both ways in one step and windows of several lengths; also with weights that reach far."""
    x = np.linspace(-pii.FAR, pii.FAR, 4001)
    v = (pii._ONE + pii._SLOPE * x).astype(np.float32)
    pii._plus_exp(v, np.empty_like(v))
    assert np.abs(1 / v - 1 / (1 + np.exp(-x))).max() < 2e-5
    rng = np.random.default_rng(2)
    sizes = np.array([40, 40, 25, 7, 1])
    cells = rng.integers(0, pii.N_CLASSES, (len(sizes), 40)).astype(np.uint8)
    for big in (1, 100):
        net = pii.Tagger(4)
        net.p |= {k: v * np.float32(big) for k, v in net.p.items() if k[:2] == "wx"}
        got = net.scores(cells, sizes)
        for i, n in enumerate(sizes.tolist()):
            want = net.emissions(cells[i : i + 1, :n])[0][:, 0] - net.p["bias"]
            assert np.abs(got[i, :n, : len(pii.KINDS)] - want).max() < 1e-3


def _scores(net, texts):
    """What the decoding of texts gets."""
    kept = []
    net.best = lambda e, sizes: kept.append(e.copy()) or np.zeros(e.shape[1], np.uint8)
    pii.tags_of(net, pii.codes("".join(texts)), np.array([len(t) for t in texts]))
    return kept[0]


def test_pii_scores_of_a_text_do_not_depend_on_others():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 12.@-") for _ in range(n)) for n in (100, 512, 3, 1500, 470, 960, 1)]
    net = pii.Tagger(3)
    together = _scores(net, texts)
    alone = np.concatenate([_scores(net, [t]) for t in texts], 1)
    assert np.abs(together - alone).max() < 1e-3


def test_pii_decoding_needs_no_tanh_or_exp(monkeypatch):
    """These were half of its CPU seconds; clocks are too unsteady for a test."""
    for name in ("tanh", "exp"):
        monkeypatch.setattr(np, name, None)
    assert np.isfinite(_scores(pii.Tagger(3), ["ab 12.@-" * 100, "", "c"])).all()


def test_a_tagger_is_fitted_from_given_spans():
    texts = [(f"aa {x} bb cc {x} dd", [("card", 3, 7), ("card", 14, 18)]) for x in ("1234", "5678", "9012", "3456")] * 20
    net = pii.fit(texts, epochs=30, batch=16)
    assert pii.find(net, ["aa 7777 bb"])[0] == [("card", 3, 7)] and pii.find(net, ["aa ee bb"])[0] == []


def test_pii_gradient():
    net = pii.Tagger(0, hidden=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.N_CLASSES, (2, 5)), rng.integers(0, len(pii.KINDS), (2, 5))
    _, g = net.gradient(x, y)
    for name in ("move", "out", "whf", "wxb", "begin"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = net.gradient(x, y)[0]
        net.p[name][at] = old - 1e-2
        down = net.gradient(x, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


# ---- 9 language ID
SPOKEN = {"en": "the and of with house river thing water these those", "fr": "le la les des avec maison rivière chose eau ces", "de": "der die und mit haus fluss ding wasser diese jene"}


def test_language_id(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(SPOKEN[g].split()) for _ in range(30)), g) for i, g in enumerate(list(SPOKEN) * 40)]
    train, held = docs(spark, rows[:90]), docs(spark, rows[90:] + [(900, None), (901, ""), (902, "123"), (903, "!!!")])
    model = langid.train(train)
    out = {r["doc_id"]: r for r in langid.identify(held, model).collect()}
    assert all(out[i]["language"] == g for i, _, g in rows[90:])
    assert not out[900]["accepted"] and out[901]["language"] is None and not out[903]["accepted"]
    kept = langid.accepted(held, model)
    assert kept.columns == held.columns and {i for i, _, _ in rows[90:]} <= {r["doc_id"] for r in kept.collect()}
    none = langid.train(docs(spark, [(1, "x y")]))
    assert langid.accepted(held, none).count() == 0 == langid.identify(docs(spark, []), model).count()


def brute_language(texts, own, n=5, penalty=langid.PENALTY):
    """Scores of a text by language, in plain Python."""
    import math

    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    count = {g: {} for g in texts}
    gram = {k: {g: {} for g in texts} for k in range(1, n + 1)}
    for g, ts in texts.items():
        for w in (w for t in ts for w in tok(t)):
            count[g][w] = count[g].get(w, 0) + 1
            for k in range(1, n + 1):
                for i in range(len(w) + 3 - k):
                    x = f" {w} "[i : i + k]
                    gram[k][g][x] = gram[k][g].get(x, 0) + 1
    log = lambda c, g, x: min(penalty, -math.log10(c[g][x] / sum(c[g].values()))) if x in c[g] else penalty

    def score(g, w):
        if any(w in c for c in count.values()):
            return log(count, g, w)
        for k in range(n, 0, -1):
            xs = [x for i in range(len(w) + 3 - k) if any((x := f" {w} "[i : i + k]) in c for c in gram[k].values())]
            if xs:
                return sum(log(gram[k], g, x) for x in xs) / len(xs)
        return penalty

    return {g: sum(score(g, w) for w in tok(own)) / len(tok(own)) for g in texts}


def test_language_scores_against_brute_force():
    """Known words, and words that fall back to n-grams of each length, or know none."""
    texts = {k: [v, v.split()[0]] for k, v in SPOKEN.items()}
    model = langid.fit(texts)
    own = ["water the maison the", "theodore maisonette wasserfall", "housing dieser", "qu xx", "jjj", "漢字 the", "t"]
    for text, (lang, score, margin) in zip(own, model.classify(own)):
        best = sorted((v, g) for g, v in brute_language(texts, text).items())
        assert lang == best[0][1] and abs(score - best[0][0]) < 1e-4 and abs(margin - (best[1][0] - best[0][0])) < 1e-4, text


def test_all_languages_are_learned_from_whole_texts(spark):
    """More languages than any table had room for; a label is told by a word at the end of a very long text; ties and repeats."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in range(12)), f"l{i:03}") for i in range(90)] * 2
    rows += [(500, "qq " * 30_000 + "zzend", "l000"), (501, None, "l001"), (502, "", "l002"), (None, "nowhere", "l003"), (503, "no label", None)]
    model = langid.train(docs(spark, rows))
    assert model.languages == sorted({f"l{i:03}" for i in range(90)})
    found = model.classify([t for _, t, _ in rows[:90]] + ["zzend"])
    assert [x[0] for x in found] == [g for _, _, g in rows[:90]] + ["l000"]
    same = langid.fit({"b": ["one two"], "a": ["one two"]})
    assert same.classify(["one"])[0][0] == "a" and same.classify(["one"])[0][2] == 0
    out = langid.identify(docs(spark, [(1, "one two " * 50_000), (1, "one two " * 50_000), (2, "?")]), same).collect()
    assert len(out) == 3 and not any(r["accepted"] for r in out)
    few = langid.train(docs(spark, rows), rows=30)
    assert len(few.languages) == 90


# ---- 10 toxicity
BAD = ["idiot", "moron", "worthless", "pathetic", "scum", "trash"]


def talk(rng, n, start=0):
    rows, labels = [], []
    for i in range(start, start + n):
        toxic, rude = i % 3 == 0, i % 6 == 0
        own = words(rng, 40, 3000).split()
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(BAD[:2] if rude else BAD[2:]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(rude), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(10)
    rows, labels = talk(rng, 400)
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, rude int, toxic int")
    model = toxicity.train(docs(spark, rows[:300] + [(3, rows[3][1])] * 3), frame(labels[:300] + [(5000, 1, 1), (None, 0, 1), (7, 1, None), (8, None, 0)]))
    assert model.chain == ["rude", "toxic"]
    held = rows[300:] + [(900, None), (901, ""), (902, words(rng, 30_000, 3000)), (902, rows[3][1])]
    out: dict = {}
    for r in toxicity.score(docs(spark, held), model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(out[i][0]["toxic"] == bool(t) for i, _, t in labels[300:]) / 100 > 0.95
    assert sum((out[i][0]["p_rude"] >= 0.5) == bool(q) for i, q, _ in labels[300:]) / 100 > 0.9
    assert not out[900][0]["toxic"] and out[901][0]["p_toxic"] == 0 and len(out[902]) == 2
    empty = toxicity.train(docs(spark, rows), frame([]))
    assert all(r["p_toxic"] == 0 for r in toxicity.score(docs(spark, rows[:3]), empty).collect())
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_chain_against_plain_python(spark):
    """Probabilities of each category from the weights, the earlier ones fed on, word by word."""
    import math

    rng = random.Random(11)
    rows, labels = talk(rng, 90)
    chain = ["other", "rude", "toxic"]
    model = toxicity.fit(toxicity.sketch([t for _, t in rows]), np.array([[float(i % 2), float(q), float(t)] for i, q, t in labels]), chain)
    n = len(model.keys)
    assert [len(model.weights[c]) for c in chain] == [n + 1 + k for k in range(3)] and n
    place = {int(k): i for i, k in enumerate(model.keys)}
    texts = [*[t for _, t in rows[:10]], "idiot idiots Idiot!", "", None]
    got = model.predict(texts)
    for row, text in zip(got, texts):
        own = re.findall(r"[^\W_]+", (text or "").lower())
        marks = {string_hash(w) for w in own} | {int(mix(np.array([string_hash(w[:k])], np.uint64) + np.uint64(k))[0]) for w in own for k in (3, 4, 5, 6) if len(w) >= k}
        before: list = []
        for c in chain:
            w = model.weights[c]
            z = sum(w[place[m]] for m in marks if m in place) + sum(a * b for a, b in zip(w[n:-1], before)) + w[-1]
            before.append(1 / (1 + math.exp(-z)) if own else 0.0)
        assert np.allclose(row, before, atol=1e-9)


def test_later_models_see_out_of_fold_probabilities():
    """A category that texts don't tell is random out of fold, so the next one can't lean on a fit that has seen it."""
    rng = np.random.default_rng(3)
    texts = [f"calm w{i} v{i} u{i}" for i in range(120)]
    noise = rng.integers(0, 2, 120).astype(float)
    model = toxicity.fit(toxicity.sketch(texts), np.column_stack([noise, noise]), ["noise", "toxic"], features=300)
    assert model.weights["toxic"][-2] < 3  # probabilities of a fit that has seen the labels would repeat them and get a great weight


def test_words_are_letters_and_numbers():
    w = Words(["Ünï x_1", None, "", "a-b"])
    assert [w.text(i) for i in range(len(w.start))] == ["ünï", "x", "1", "a", "b"] and np.diff(w.first).tolist() == [3, 0, 0, 2]
