"""DuckDB fragments of the column functions, written independently of them: no lookarounds, no backreferences."""

from __future__ import annotations

from ..functions import normalize as N
from ..functions import translit as T
from ..functions.markers import DISCRIMINANT, MARKERS
from ..operators.segments import ACCENT
from .views import ARABIC, LATIN
from ..sources.entities import ENTITIES, PREFIXES, SUFFIXES


def strings(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


_RUNS = LATIN + ARABIC + "0123456789ءآأؤإئةثذصضطظعغىپچڥگ.,!?;:-'\"()%#*$&éèêëàâùûüçôöîïäßñáíóúœæـ "


def elongation(t: str) -> str:
    """Runs of each character of the views; texts without any (nearly all words) skip the chain."""
    esc = lambda c: "\\" + c if c in ".?*$()" else c.replace("'", "''")
    chars = sorted(set(_RUNS))
    chain = t
    for c in chars:
        chain = f"regexp_replace({chain}, '{esc(c)}{{3,}}', '{(c * 2).replace(chr(39), chr(39) * 2)}', 'g')"
    return f"CASE WHEN regexp_matches({t}, '{'|'.join(esc(c) + '{3}' for c in chars)}') THEN {chain} ELSE {t} END"


def light(t: str) -> str:
    t = rf"regexp_replace(replace(coalesce({t}, ''), '{N.TATWEEL}', ''), '[{N.MARKS}]', '', 'g')"
    return f"translate({t}, '{N.DIGITS_FROM}', '{N.DIGITS_TO}')"


def letters(t: str) -> str:
    return f"translate({t}, '{N.LETTERS_FROM}', '{N.LETTERS_TO}')"


def norm(t: str) -> str:
    return squeeze(letters(light(t)))


def only_arabic(t: str) -> str:
    return squeeze(rf"regexp_replace({t}, '[^\x{{0621}}-\x{{064A}}{N.MAGHREBI}0-9 ]', ' ', 'g')")


def words(t: str) -> str:
    return f"list_filter(string_split({squeeze(t)}, ' '), lambda x: x <> '')"


def n_words(normal: str) -> str:
    return f"len(list_filter(string_split({normal}, ' '), lambda x: x <> ''))"


def count(t: str, rx: str) -> str:
    return f"len(regexp_extract_all({t}, '{rx}'))"


def arabizi(t: str) -> str:
    w = f"regexp_extract_all(lower({t}), '[a-z0-9'']+')"
    digit = f"len(list_filter({w}, lambda x: regexp_matches(x, '[a-z][2-9]|[2-9]''?[a-z]')))"
    stop = f"len(list_filter({w}, lambda x: x IN ({strings(T.STOPWORDS)})))"
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, greatest(CAST({digit} AS DOUBLE) / len({w}) * 3.0::DOUBLE, CAST({stop} AS DOUBLE) / len({w}) * 2.5::DOUBLE)) END"


AR, LA, ALNUM = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]", "[A-Za-z]", r"[\p{L}\p{N}]"


def to_arabic(t: str, key: str, source: str, g: str = "ڨ") -> str:
    """CTEs that end in tr(key, out): tokens from left to right with their neighbours' characters."""
    names = {f"{k}'": v for k, v in T.QUOTED.items()} | T.DIGRAPHS | dict(zip(T.SINGLES_FROM, T.SINGLES_TO)) | {"x": "كس", "g": g}
    mapped = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in names.items())
    keys = "|".join([f"{k}''" for k in T.QUOTED] + list(T.DIGRAPHS))
    cons = r"^[\p{L}2-9]$"
    consonant = lambda c: f"(regexp_matches({c}, '{cons}') AND {c} NOT IN ('a','e','i','o','u'))"
    return f"""tr0 AS (SELECT {key}, regexp_extract_all(translate({t}, '{T._UPPER}', '{T._LOWER}'), '(?s)(?:{keys}|.)') AS k FROM {source}),
tr1 AS (SELECT {key}, unnest(k) AS tok, unnest(range(1, len(k) + 1)) AS i, unnest(list_prepend('', list_transform(k[1:-2], lambda x: right(x, 1)))) AS prev, unnest(list_append(list_transform(k[2:], lambda x: left(x, 1)), '')) AS next FROM tr0 WHERE len(k) > 0),
tr AS (SELECT {key}, string_agg(CASE WHEN tok IN ('a', 'e', 'o') AND {consonant('prev')} AND {consonant('next')} THEN ''
  WHEN tok = 'e' THEN CASE WHEN regexp_matches(prev, '[\\p{{L}}\\p{{N}}]') THEN '' ELSE 'ا' END
  ELSE CASE tok {mapped} ELSE tok END END, '' ORDER BY i) AS out FROM tr1 GROUP BY {key})"""


def to_arabizi(t: str) -> str:
    t = rf"regexp_replace(replace(coalesce({t}, ''), '{N.TATWEEL}', ''), '[{N.MARKS}]', '', 'g')"
    for k, v in T.BACK_LONG.items():
        if k != "":
            t = f"replace({t}, '{k}', '{v}')"
    t = f"replace({t}, 'ش', 'ch')"
    pairs = [(a, b) for a, b in zip(T.BACK_FROM, T.BACK_TO) if b != ""] + [(T.BACK_ALEF, "a")]
    return f"translate({t}, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"


def marker(normal: str, name: str) -> str:
    """How often a marker occurs: whole words, as a word end is a change to or from letters and digits."""
    rx = MARKERS[name][0]
    if name == "negation_ma_sh":
        return rf"len(regexp_extract_all(' ' || replace({normal}, ' ', '  ') || ' ', '[^\p{{L}}\p{{N}}_]ما(?:  )?[^\s]{{1,12}}ش[^\p{{L}}\p{{N}}_]'))"
    if name == "progressive_qaed":
        rx = r"قاعد.*"
    return rf"len(list_filter(regexp_extract_all({normal}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '{rx}')))"


def n_discriminant(normal: str) -> str:
    return " + ".join(f"CAST({marker(normal, n)} > 0 AS INTEGER)" for n in sorted(DISCRIMINANT))


def strip_punctuation(t: str) -> str:
    return squeeze(rf"regexp_replace(coalesce({t}, ''), '[^\p{{L}}\p{{N}}_\s]|\p{{Nd}}', ' ', 'g')")


IN_ENTITIES = f"IN ({strings(ENTITIES)})"


def entities(source: str, key: str, text: str) -> str:
    """CTEs that end in en(key, i, w, entity): every word, and the entity that it names."""
    prefix = " ".join(f"WHEN starts_with(nw, '{p}') AND len(nw) >= {len(p) + 3} THEN substr(nw, {len(p) + 1})" for p in PREFIXES)
    suffix = " ".join(f"WHEN ends_with(head, '{s}') AND len(head) >= {len(s) + 3} THEN left(head, len(head) - {len(s)})" for s in SUFFIXES)
    return f"""en0 AS (SELECT {key}, unnest(k) AS w, unnest(range(len(k))) AS i FROM (SELECT {key}, {words(text)} AS k FROM {source})),
en1 AS MATERIALIZED (SELECT {key}, i, w, {letters(light('w'))} AS lw FROM en0),
en2 AS MATERIALIZED (SELECT {key}, i, w, {only_arabic(elongation('lw'))} AS nw FROM en1),
en3 AS MATERIALIZED (SELECT *, CASE {prefix} ELSE nw END AS head FROM en2),
en4 AS MATERIALIZED (SELECT *, CASE {suffix} ELSE head END AS root FROM en3),
en AS (SELECT {key}, i, w, CASE WHEN nw {IN_ENTITIES} THEN nw WHEN root {IN_ENTITIES} THEN root END AS entity FROM en4)"""


#: classifier on documents: fr against es
MODEL = f"""mn AS (SELECT doc_id, lang = 'fr' AS p, {norm('text')} AS t FROM documents WHERE lang IN ('fr', 'es')),
mc AS (SELECT doc_id, p, string_split(' ' || replace(t, ' ', '_') || ' ', '') AS c FROM mn),
mg AS (SELECT doc_id, p, unnest(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS gram FROM mc),
mk AS (SELECT gram, sum(CAST(p AS INT)) AS cp, sum(CAST(NOT p AS INT)) AS cn FROM mg GROUP BY gram),
mz AS (SELECT sum(cp) AS tp, sum(cn) AS tn, count(*) AS v FROM mk),
mw0 AS (SELECT gram, cp, cn, CAST(round((ln((cp + 0.5::DOUBLE) / (tp + 0.5::DOUBLE * v)) - ln((cn + 0.5::DOUBLE) / (tn + 0.5::DOUBLE * v))) * 1e9::DOUBLE) AS BIGINT) AS w FROM mk, mz),
mw AS (SELECT * FROM mw0 ORDER BY abs(w) * ln(1 + cp + cn) DESC, gram LIMIT 60000),
mr AS (SELECT doc_id, p, CAST(sum(coalesce(w, 0)) AS DOUBLE) / count(*) / 1e9::DOUBLE AS raw FROM mg LEFT JOIN mw USING (gram) GROUP BY doc_id, p),
mh AS (SELECT raw FROM (SELECT raw, row_number() OVER (ORDER BY raw) AS i, count(*) OVER () AS n FROM mr WHERE p) WHERE i = least(n, CAST(floor(0.9::DOUBLE * n) AS BIGINT) + 1)),
ml AS (SELECT min(raw) AS low FROM mr WHERE NOT p),
mp AS (SELECT low - 0.1::DOUBLE * greatest(raw - low, 1e-6::DOUBLE) AS lo, raw AS hi FROM mh, ml),
ms AS (SELECT doc_id, p, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw - lo) / (hi - lo))) AS score FROM mr, mp),
mj AS (SELECT t, round((tp - pb) / tp::DOUBLE - (tn - nb) / tn::DOUBLE, 12) AS j FROM (SELECT score AS t, sum(sum(CAST(p AS INT))) OVER () AS tp, sum(sum(CAST(NOT p AS INT))) OVER () AS tn,
  coalesce(sum(sum(CAST(p AS INT))) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(sum(CAST(NOT p AS INT))) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM ms GROUP BY score)),
mt AS (SELECT t AS threshold, j FROM mj ORDER BY j DESC, t LIMIT 1)"""


def blocks(source: str, key: str, text: str, name: str = "bl") -> str:
    """CTEs that end in ``name``(key, block, t): 60-word blocks of each text."""
    w = words("line")
    return f"""{name}l AS (SELECT {key}, unnest(string_split_regex({text}, '\\r\\n|\\n|\\r')) AS line, unnest(range(len(string_split_regex({text}, '\\r\\n|\\n|\\r')))) AS li FROM {source}),
{name}p AS (SELECT {key}, li, pi, CASE WHEN len(w) <= 60 THEN line ELSE array_to_string(w[pi * 60 + 1 : pi * 60 + 60], ' ') END AS t FROM (SELECT {key}, li, line, w, unnest(range(greatest(1, CAST(ceil(len(w) / 60.0) AS INT)))) AS pi FROM (SELECT {key}, li, line, {w} AS w FROM {name}l))),
{name}n AS (SELECT {key}, t, n, row_number() OVER (PARTITION BY {key} ORDER BY li, pi) AS i FROM (SELECT {key}, li, pi, t, {n_words(norm('t'))} AS n FROM {name}p) WHERE n > 0),
{name}r AS (SELECT {key}, i, n AS cum, 0 AS block FROM {name}n WHERE i = 1 UNION ALL SELECT p.{key}, p.i, CASE WHEN r.cum >= 60 THEN p.n ELSE r.cum + p.n END, CASE WHEN r.cum >= 60 THEN r.block + 1 ELSE r.block END FROM {name}r r JOIN {name}n p ON p.{key} = r.{key} AND p.i = r.i + 1),
{name} AS (SELECT {key}, block, string_agg(t, chr(10) ORDER BY i) AS t, max(cum) AS n FROM {name}r JOIN {name}n USING ({key}, i) GROUP BY {key}, block HAVING max(cum) >= 30)"""


def scores(source: str, keys: str, text: str, name: str = "sc") -> str:
    """CTEs that end in ``name``(keys, score) by the model."""
    return f"""{name}c AS (SELECT {keys}, string_split(' ' || replace({norm(text)}, ' ', '_') || ' ', '') AS c FROM {source}),
{name}g AS (SELECT {keys}, unnest(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS gram FROM {name}c),
{name}s AS (SELECT {keys}, CAST(sum(coalesce(w, 0)) AS DOUBLE) / count(*) / 1e9::DOUBLE AS raw FROM {name}g LEFT JOIN mw USING (gram) GROUP BY {keys}),
{name} AS (SELECT {keys}, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw - lo) / (hi - lo))) AS score FROM {name}s, mp)"""


def prepared(source: str, key: str, text: str) -> str:
    """CTEs that end in pr(key, t, translit)."""
    ar, la = count(text, AR), count(text, LA)
    latin = f"{la} >= 0.6::DOUBLE * ({ar} + {la} + greatest(0, {count(text, ALNUM)} - {ar} - {la})) AND {la} > 0"
    return f"""pl AS (SELECT {key}, {text} AS t, ({latin}) AND ({arabizi(text)}) >= 0.15 AS translit FROM {source}),
{to_arabic('t', key, '(SELECT * FROM pl WHERE translit)')},
pr AS (SELECT pl.{key}, CASE WHEN translit THEN coalesce(tr.out, '') WHEN regexp_matches(coalesce(pl.t, ''), '\\S') THEN pl.t ELSE '' END AS t, coalesce(translit, false) AS translit FROM pl LEFT JOIN tr ON tr.{key} = pl.{key})"""


#: languages of Latin words
def label(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '[a-zà-ÿ][2-9]|[2-9]''?[a-zà-ÿ]') OR {w} IN ({strings(T.STOPWORDS)}) THEN 'arabizi' WHEN {w} IN ({strings(T.FRENCH)}) OR regexp_matches({w}, '{ACCENT}') THEN 'fr' END"
