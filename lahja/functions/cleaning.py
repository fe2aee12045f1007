"""Cleaning of wiki markup, social media lines, model output and training text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import batch
from .normalize import count_words, normalize, squeeze
from ..sources.entities import ENTITIES, PREFIXES, SUFFIXES

#: (pattern, replacement) in order; the template step is unrolled, as one that finds nothing changes nothing.
WIKI_STEPS = [
    ("(?s)<!--.*?-->", " "), ("(?s)<ref[^>]*>.*?</ref>", " "), ("<ref[^>]*/>", " "),
    *[("\\{\\{[^{}]*\\}\\}", " ")] * 8,
    ("(?s)\\{\\|.*?\\|\\}", " "), ("\\[\\[(?:[^\\[\\]|]*:)[^\\[\\]]*\\]\\]", " "), ("\\[\\[[^\\[\\]|]*\\|([^\\[\\]]*)\\]\\]", "$1"), ("\\[\\[([^\\[\\]]*)\\]\\]", "$1"),
    ("\\[https?://\\S+\\s+([^\\]]*)\\]", "$1"), ("\\[https?://\\S+\\]", " "), ("<[^>]+>", " "),
    ("(?m)^\\s*={2,}.*?={2,}\\s*$", " "), ("'''", ""), ("''", ""), ("(?m)^[*#:;]+", " "),
]
NOISE = "@[\\p{L}\\p{N}_]+|#\\S+|https?://\\S+|www\\.\\S+|(?<![\\p{L}\\p{N}_])RT(?![\\p{L}\\p{N}_])"
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE00}-\\x{FE0F}\\x{1F1E6}-\\x{1F1FF}\\x{2190}-\\x{21FF}\\x{2B00}-\\x{2BFF}]+"
LABEL = "^\\s*-?[01]\\s*[;,\\t]\\s*|^\\s*-?[01]\\s+(?=\\S)"
LEAK = "\\n\\s*(?:user|assistant|system)(?![\\p{L}\\p{N}_])"
FOREIGN = "[^\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}A-Za-z0-9\\s.,;:!?()\\[\\]\\-\u2013\u2014\u00ab\u00bb\"'/%+]"


def strip_wikitext(text: Column) -> Column:
    for pattern, to in WIKI_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return text


def clean_social(line: Column) -> Column:
    """Mentions, tags, addresses, emoji and runs of punctuation go."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), NOISE, " "), EMOJI, " ")
    return squeeze(F.regexp_replace(out, "([^\\p{L}\\p{N}_\\s])\\1{2,}", "$1"))


def clean_line(line: Column, min_words: int = 4) -> Column:
    """``clean_social``, null below so many words."""
    out = clean_social(line)
    return F.when((out != "") & (count_words(out) >= min_words), out)


def strip_label(line: Column) -> Column:
    return F.regexp_replace(line, LABEL, "")


def strip_punctuation(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}_\\s]|\\p{Nd}", " "))


def stem(token: Column) -> Column:
    """At most one prefix and one suffix off, the longest that leaves three characters."""
    head = F.regexp_replace(token, "^(?:" + "|".join(f"{p}(?=.{{3}})" for p in PREFIXES) + ")", "")
    return F.regexp_replace(head, "(?:" + "|".join(f"(?<=.{{3}}){s}" for s in SUFFIXES) + ")$", "")


def is_entity(token: Column) -> Column:
    """For tokens of text in NFKC."""
    own = normalize(token, "aggressive", compose=False)
    return (own != "") & (own.isin(*ENTITIES) | stem(own).isin(*ENTITIES))


def entity_of(token: Column) -> Column:
    """The entity that a token names, null otherwise."""
    own = normalize(token, "aggressive", compose=False)
    return F.when(own.isin(*ENTITIES), own).when(stem(own).isin(*ENTITIES), stem(own))


_without_entities = F.arrow_udf(batch.without_entities, StringType())


def strip_entities(text: Column, compose: bool = True) -> Column:
    """Words that name entities go; the rest, in NFKC, is joined by blanks."""
    if compose:
        return _without_entities(text)
    words = F.split(squeeze(F.coalesce(text, F.lit(""))), " ")
    return F.array_join(F.filter(words, lambda w: ~is_entity(w)), " ")


def clean_for_training(text: Column) -> Column:
    """Punctuation first, else a name with punctuation isn't recognised."""
    return strip_entities(strip_punctuation(text))


def clean_reply(text: Column) -> Column:
    """Cut where the template leaks; only the alphabets in use stay."""
    return squeeze(F.regexp_replace(F.element_at(F.split(text, LEAK, 2), 1), FOREIGN, " "))
