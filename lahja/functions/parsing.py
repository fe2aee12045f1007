"""Small grammars: quota messages of providers, prompts of the verse corpus, positions on the human scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TASKS = [
    ("انظم القسيم", "qasim", "القسيم"), ("انظم الملزومة", "malzuma", "الملزومة"), ("انظم الموقف", "mawqif", "الموقف"), ("انظم المسدّسة", "musaddas", "المسدّسة"),
    ("انظم أغنية شعبية تونسية", "song", "أغنية"), ("انظم لغزًا شعبيًّا تونسيًّا", "riddle", "لغز"), ("انظم رباعية شعبية تونسية", "quatrain", "رباعية/مقطوعة"), ("انظم نصًّا شعبيًّا تونسيًّا", "unclassified", "غير محدّد"),
]
USUL = ("qasim", "malzuma", "mawqif", "musaddas")
PROSE = "^اكتب تعريفًا نثريًّا موجزًا بـ«(.+?)»"
FIELDS = {"gharad": "في غرض «(.+?)»", "wazn_sub": "الميزان الفرعي «(.+?)»", "region": "بنَفَس أهل «(.+?)»"}
CONTINUE = "واجعل مطلعه هذا الشطر بنصّه"
#: Medians and quantiles of human narrative: low anchor, high anchor, encyclopedic, 10 %, 25 %, 75 %.
LOW, HIGH, ENCYCLOPEDIC = 0.8308, 0.9184, 0.7814
P10, Q1, Q3 = 0.8542, 0.8982, 0.9372
QUOTAS = {
    "google": ("RESOURCE_EXHAUSTED|429", "retry in ([\\d.]+)s", "PerDay|limit: 0\\b"),
    "openrouter": ("(?s).", "(?i)(?:retry|try again) (?:in|after) ([\\d.]+)\\s*s", "(?i)per day|daily|free-models-per-day"),
    "xai": ("(?s).", "(?i)(?:retry|try again) (?:in|after) ([\\d.]+)\\s*s", "(?i)per day|daily|quota|credit|billing|insufficient"),
}


def _found(text: Column, rx: str) -> Column:
    """First group of the first match, null without one."""
    return F.when(text.rlike(rx), F.regexp_extract(text, rx, 1))


def parse_prompt(prompt: Column) -> Column:
    """struct<genre, genre_ar, title, gharad, wazn_sub, region, mode>; null where the prompt isn't of the grammar."""
    head = F.trim(F.regexp_replace(F.element_at(F.split(prompt, "\n", 2), 1), "\\.+$", ""))
    prose = prompt.rlike(PROSE)
    genre, arabic = F.when(prose, F.lit("prose")), F.when(prose, F.lit("نثر"))
    for task, key, name in TASKS:
        genre, arabic = genre.when(head.startswith(task), F.lit(key)), arabic.when(head.startswith(task), F.lit(name))
    meta = [F.when(~prose, _found(prompt, rx)).alias(k) for k, rx in FIELDS.items()]
    mode = F.when(~prose, F.when(prompt.contains(CONTINUE), F.lit("continue")).otherwise(F.lit("compose")))
    return F.when(genre.isNotNull(), F.struct(genre.alias("genre"), arabic.alias("genre_ar"), _found(prompt, PROSE).alias("title"), *meta, mode.alias("mode")))


def classify_quota(message: Column, provider: str = "google") -> Column:
    """struct<limited, retry_after, exhausted>."""
    when, delay, daily = QUOTAS[provider]
    limited = message.rlike(when)
    return F.struct(limited.alias("limited"), F.when(limited, _found(message, delay).cast("double")).alias("retry_after"), (limited & message.rlike(daily)).alias("exhausted"))


def position(score: Column) -> Column:
    """0 at the low anchor, 1 at the high one; not clamped."""
    return (score - LOW) / (HIGH - LOW)


def zone(pos: Column) -> Column:
    at = lambda s: (s - LOW) / (HIGH - LOW)
    return F.when(pos < at(P10), "low").when(pos < at(Q1), "below_typical").when(pos <= at(Q3), "centre").when(pos.isNotNull(), "high")


SPREAD = {k: round((v - LOW) / (HIGH - LOW), 4) for k, v in (("p10", P10), ("q1", Q1), ("q3", Q3))}
