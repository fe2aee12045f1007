"""Latin-script (Arabizi) to Arabic and back, and how likely a text is Arabizi."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import letter_facts, script_ratio, strip_diacritics, strip_tatweel

#: Keys of several characters; the quoted digits are what follows a bare digit's letter.
QUOTED = dict(zip("32679", "غءظخظ"))
DIGRAPHS = {"sch": "ش"} | dict(zip("ch sh kh gh th dh ph ou aa ee ii oo ss".split(), "ششخغثذفوايي" + "وس"))
SINGLES_FROM = "abcdfghijklmnopqrstuvwyz" + "23456789"
SINGLES_TO = "ابكدفڨهيجكلمنوبقرستوڥويز" + "ءعذخطحغق"
#: Arabic letters of one Latin character, then of two.
BACK_FROM = "اأةىإءؤئبتجح" + "خدرزسشصطعفقكلمنهويڨڥپ"
BACK_TO = "aaaai222btj7" + "5drzs" + "\ue001" + "st3f9klmnhwigvp"
BACK_LONG = {"ث": "th", "ذ": "dh", "ض": "dh", "ظ": "dh", "غ": "gh", "چ": "ch", "\ue001": "ch"}
BACK_ALEF = "آ"
STOPWORDS = tuple(sorted("""3aslema 3lach 9adech 9adeh a7na alech aslema barcha barsha behi behy brabi chneya chnia chnowa chwaya chwiya ekaka eli
elli enti entouma enty ey fama famma hakka hiya houma houwa ken kifach labas labes mahouch manich mech mouch naam sa7a sahha taw tawa wa9tech win
ya3ni yaani yezzi""".split()))  # fmt: skip
FRENCH = tuple(sorted("""aussi avec avoir bien bon bonjour chez dans de des du elle elles est et etre faire fait il ils je la le les mais meme merci
nous on ou pas plus pour que qui quoi salut sans sont sur tous tout toute tres tu un une voila vous was même très voilà être""".split()))  # fmt: skip
STOPWORDS_SET, FRENCH_SET = frozenset(STOPWORDS), frozenset(FRENCH)
LATIN_DOMINANT, ARABIZI = 0.60, 0.15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CONSONANT = "[\\p{L}2-9&&[^aeiou]]"


def to_arabic(text: Column, g_as_qaf: bool = False) -> Column:
    """Deterministic transliteration. Every ASCII letter has an Arabic counterpart, so lower-casing those loses nothing.

    Short vowels are marked where they stand first: deleting them at once would bring letters together that are no
    digraph. Digraphs are enclosed in one pass from left to right and replaced after that.
    """
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, f"(?<={_CONSONANT})[aeo](?={_CONSONANT})", "\ue000")
    t = F.regexp_replace(t, "([32679]'|sch|[cskgtdp]h|ou|aa|ee|ii|oo|ss)", "\ue001$1\ue002")
    for key, to in QUOTED.items():
        t = F.replace(t, F.lit(f"\ue001{key}'\ue002"), F.lit(f"{to}\ue003"))
    for key, to in DIGRAPHS.items():
        t = F.replace(t, F.lit(f"\ue001{key}\ue002"), F.lit(to))
    t = F.regexp_replace(t, "(?<![\\p{L}\\p{N}\ue000])e", "ا")
    t = F.replace(F.translate(t, SINGLES_FROM + "e\ue000\ue003", SINGLES_TO), F.lit("x"), F.lit("كس"))
    return F.translate(t, "ڨ", "ق") if g_as_qaf else t


def to_arabizi(text: Column) -> Column:
    t = F.translate(strip_diacritics(strip_tatweel(F.coalesce(text, F.lit("")))), BACK_FROM + BACK_ALEF, BACK_TO + "a")
    for key, to in BACK_LONG.items():
        t = F.replace(t, F.lit(key), F.lit(to))
    return t


def arabizi_score(text: Column) -> Column:
    """Words with a digit between letters, or known function words, among all; 0 to 1."""
    found = letter_facts(text)
    n, digits, stops = found[3], found[4], found[5]
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(digits / n * 3.0, stops / n * 2.5)))


def is_arabizi(text: Column, threshold: float = ARABIZI) -> Column:
    return arabizi_score(text) >= threshold


def prepare(reply: Column) -> Column:
    """struct<text, transliterated>: Latin-script dialect is transliterated, blank text is empty."""
    blank = ~F.coalesce(reply, F.lit("")).rlike("(?U)[^\\s]")
    latin = (script_ratio(reply)["latin"] >= LATIN_DOMINANT) & is_arabizi(reply)
    return F.struct(F.when(blank, F.lit("")).when(latin, to_arabic(reply)).otherwise(reply).alias("text"), (~blank & latin).alias("transliterated"))
