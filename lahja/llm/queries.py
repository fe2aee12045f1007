"""One query per operator, each over its whole table with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._spark import Scratch, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few splits (a file of one row group) is spread first, as these operators are bound by CPU."""
    return spread(Scratch(spark, name), spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_copies

    return exact_copies(_table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT d.doc_id, k.keep_id
FROM documents d JOIN (SELECT text, min(doc_id) AS keep_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) k ON d.text = k.text
WHERE d.doc_id <> k.keep_id
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that decoding gives back."""
    from . import bpe

    return bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Every alignment of every document with every item, by brute force; short items are whole lines.
OP3_SQL = r"""
WITH d AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
           FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
i AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
b AS (SELECT bid, item_id, len(w) AS n, least(16, len(w)) AS span, unnest(w) AS word, unnest(range(len(w))) AS pos FROM i WHERE len(w) >= 8),
m AS (SELECT rid, doc_id, bid, item_id, span, d.pos - b.pos AS shift, b.pos AS pos FROM d JOIN b ON d.word = b.word),
c AS (SELECT doc_id, item_id, span, count(*) OVER (PARTITION BY rid, bid, shift ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS n FROM m),
l AS (SELECT doc_id, regexp_extract_all(line, '[\p{L}\p{N}]+') AS w FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, item_id, n FROM c WHERE n >= span - (3 * span) // 16 UNION ALL SELECT l.doc_id, i.item_id, len(i.w) FROM l JOIN i ON l.w = i.w WHERE len(i.w) BETWEEN 1 AND 7)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS matched FROM f GROUP BY doc_id, item_id
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the lowest document that it is connected with by links, and the number of its links."""
    from .ngram_join import near_docs

    return near_docs(_table(spark, sf_dir, "documents"))


#: All pairs of distinct gram sets by brute force, and the closure of their links.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) END AS grams FROM w),
c AS (SELECT row_number() OVER () AS k, grams, len(grams) AS n, count(*) AS weight, min(doc_id) AS low FROM g WHERE grams IS NOT NULL GROUP BY grams),
x AS (SELECT k, n, unnest(grams) AS gram FROM c),
p AS (SELECT a.k AS ka, b.k AS kb FROM x a JOIN x b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5),
r AS (SELECT k, k AS j FROM c UNION SELECT r.k, p.kb FROM r JOIN p ON p.ka = r.j),
t AS (SELECT r.k, min(o.low) AS top FROM r JOIN c o ON o.k = r.j GROUP BY r.k),
l AS (SELECT ka AS k, sum(weight) AS links FROM p JOIN c ON c.k = p.kb GROUP BY ka),
s AS (SELECT c.grams, t.top, c.weight - 1 + coalesce(l.links, 0) AS links FROM c JOIN t USING (k) LEFT JOIN l USING (k))
SELECT g.doc_id, CASE WHEN coalesce(s.links, 0) = 0 THEN g.doc_id ELSE s.top END AS class_id, CAST(coalesce(s.links, 0) AS BIGINT) AS n_links FROM g LEFT JOIN s ON g.grams = s.grams
"""


def op5_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the replies of its later half replaced by its first reply."""
    from . import chat

    turns = _table(spark, sf_dir, "conversations")
    own = W.partitionBy("conv_id")
    reply = F.col("role") == "assistant"
    first = F.min_by(F.when(reply, F.col("text")), F.when(reply, F.col("turn"))).over(own)
    worse = turns.withColumn("text", F.when(reply & (2 * F.col("turn") >= F.max("turn").over(own)), first).otherwise(F.col("text")))
    pairs = chat.preferences(turns, worse)
    return pairs.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


OP5_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(turn) AS top, arg_min(text, turn) FILTER (role = 'assistant') AS reply FROM t GROUP BY conv_id),
s AS (SELECT t.*, CASE WHEN role = 'assistant' AND 2 * turn >= top THEN reply ELSE text END AS other FROM t JOIN a USING (conv_id)),
d AS (SELECT conv_id, min(turn) AS apart FROM s WHERE text <> other GROUP BY conv_id),
x AS (SELECT s.*, apart, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS r FROM s JOIN d USING (conv_id)),
y AS (SELECT *, coalesce(sum(len(c)) FILTER (turn >= apart) OVER w, 0) - 22 + 13 + len(role) AS c0, coalesce(sum(len(r)) FILTER (turn >= apart) OVER w, 0) - 22 + 13 + len(role) AS r0
      FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(count(*) FILTER (turn < apart) AS INTEGER) AS n_common,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (turn < apart), '') || '<|im_start|>assistant' || chr(10) AS prompt,
  substr(string_agg(c, '' ORDER BY turn) FILTER (turn >= apart), 23) AS chosen, substr(string_agg(r, '' ORDER BY turn) FILTER (turn >= apart), 23) AS rejected,
  string_agg(CAST(c0 AS BIGINT) || ':' || CAST(c0 + len(text) + 10 AS BIGINT), ' ' ORDER BY turn) FILTER (turn >= apart AND role = 'assistant') AS chosen_mask,
  string_agg(CAST(r0 AS BIGINT) || ':' || CAST(r0 + len(other) + 10 AS BIGINT), ' ' ORDER BY turn) FILTER (turn >= apart AND role = 'assistant') AS rejected_mask
FROM y GROUP BY conv_id
"""


def op6_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the token ids of every document, and the ids that decoding gives back."""
    from . import bpe, huffman

    ids = Scratch(spark, "huffman").write(bpe.encode_local(_table(spark, sf_dir, "documents"), packed=True))
    code = huffman.Code.of(huffman.count_ids(ids))
    return huffman.decode(huffman.encode(ids, code), code)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import near_lines

    return near_lines(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import spans

    return spans(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_decontaminate": op3_decontaminate,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_chat_preferences": op5_chat_preferences,
        "op6_token_huffman": op6_token_huffman,
        "op7_line_dedup": op7_line_dedup,
        "op8_pii": op8_pii,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_chat_preferences": OP5_SQL}
