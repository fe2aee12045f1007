"""Orthographic normalisation that leaves the dialect's words alone.

Normal forms and counts of letters are made a batch at a time, word by word (``batch``); where lambdas leave no room
for a Python function (``compose=False``), Catalyst expressions do the same without NFKC.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from . import batch

LEVELS = ("light", "standard", "aggressive")
TATWEEL = "\u0640"
MARKS = "\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}"
DIGITS_FROM = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10))
DIGITS_TO = "0123456789" * 2
#: alef forms, alef maqsura, ta marbuta, hamza carriers
LETTERS_FROM, LETTERS_TO = "\u0623\u0625\u0622\u0671\u0649\u0629\u0624\u0626", "\u0627\u0627\u0627\u0627\u064a\u0647\u0648\u064a"
FOLD_FROM, FOLD_TO = "\u0635\u0637\u0636\u0638\u0629\u0647", "\u0633\u062a\u062f\u0630\u0627\u0627"
MAGHREBI = "\u067e\u0686\u06a4\u06a5\u06a8\u06af"
WHITE = "(?U)[\\s\\x1C-\\x1F]+"
#: Characters that NFKC leaves as they are, wherever they stand.
_STABLE = "[^\\x00-\\x7F\\xAB\\xBB\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\xFF\\x{060C}\\x{061B}\\x{061F}\\x{0621}-\\x{0652}\\x{0660}-\\x{0669}\\x{066E}-\\x{0674}\\x{0679}-\\x{06BF}\\x{06F0}-\\x{06FF}\\x{2013}\\x{2014}\\x{2018}-\\x{201D}]"


_FORMS = {k: F.arrow_udf(f, StringType()) for k, f in (("light", batch.light), ("standard", batch.standard), ("aggressive", batch.aggressive))}
_verse = F.arrow_udf(batch.verse, StringType())
#: Arabic, Latin, all letters and digits; Latin words, those with a digit between letters, known function words.
letter_facts = F.arrow_udf(batch.letter_facts, ArrayType(IntegerType()))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(_STABLE), text)), text, F.lit(""))


def strip_tatweel(text: Column) -> Column:
    return F.translate(text, TATWEEL, "")


def strip_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, f"[{MARKS}]", "")


def unify_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def unify_orthography(text: Column) -> Column:
    return F.translate(text, LETTERS_FROM, LETTERS_TO)


def reduce_elongation(text: Column) -> Column:
    """Runs of three or more of a character become two; line feeds stay."""
    return F.regexp_replace(text, "([^\\n])\\1{2,}", "$1$1")


def fold_for_arabizi(text: Column) -> Column:
    """Arabic letters that Latin script can't tell apart become one."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalize(text: Column, level: str = "standard", compose: bool = True) -> Column:
    """Normal form; null gives "". ``compose=False`` leaves NFKC out, for use inside lambdas or on text that has it."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {LEVELS}")
    if compose:
        return _FORMS[level](text)
    out = F.coalesce(text, F.lit(""))
    out = unify_digits(strip_diacritics(strip_tatweel(out)))
    if level != "light":
        out = unify_orthography(out)
    if level == "aggressive":
        out = F.regexp_replace(reduce_elongation(out), f"[^\\x{{0621}}-\\x{{064A}}{MAGHREBI}0-9 ]", " ")
    return squeeze(out)


def split_words(text: Column) -> Column:
    """Words between white space; [] for a text without."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def tokenize(text: Column, level: str = "standard", compose: bool = True) -> Column:
    return F.filter(F.split(normalize(text, level, compose), " "), lambda w: w != "")


def words_of(normal: Column) -> Column:
    """How many words text in normal form has."""
    return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1)


def count_words(text: Column, compose: bool = True) -> Column:
    return words_of(normalize(text)) if compose else F.size(tokenize(text, "standard", compose))


def script_ratio(text: Column) -> Column:
    """struct<arabic, latin, other>: shares among the letters and digits, all 0 without any."""
    found = letter_facts(text)
    ar, la = found[0], found[1]
    other = F.greatest(F.lit(0), found[2] - ar - la)
    total = ar + la + other
    share = lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0))
    return F.struct(share(ar).alias("arabic"), share(la).alias("latin"), share(other).alias("other"))


def arabic_ratio(text: Column) -> Column:
    """Arabic characters among those that aren't white space."""
    t = F.coalesce(text, F.lit(""))
    dense = F.length(F.regexp_replace(t, "(?U)[\\s\\x1C-\\x1F]", ""))
    return F.when(dense > 0, F.regexp_count(t, F.lit("[\\x{0600}-\\x{06FF}]")) / dense).otherwise(F.lit(0.0))


def poem_normalize(text: Column) -> Column:
    """The variant for verse: only plain Arabic letters, ASCII digits and blanks stay."""
    return _verse(text)
