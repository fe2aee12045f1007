"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal roles and texts) is found and rendered once as the prompt, followed by the
header of an assistant turn where both sides go on with one; what is left of each side is its completion. A
completion is masked: its trainable spans are the contents of assistant turns with their end marker; headers and the
turns of others are not trained on.

Both sides are gathered in one aggregation on the conversation, a single shuffle however many turns there are; the
prefix, the renderings and the masks are array expressions of the JVM. A task holds one conversation at a time.

Defined results: turns are ordered by turn (null last), then role and text, so that tied or repeated turns have an
order. A null role is "unknown", a null text is empty; null conversation ids name nothing and are left out. A
conversation that lacks a side is left out. Equal sides express no preference: they are left out unless
``keep_ties`` (then both completions are empty). If one side is a prefix of the other, its completion is empty.
Empty tables give empty results; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, START, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _turns(df: DataFrame, side: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    own = F.struct(F.col(f"`{turn}`").isNull().alias("last"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return df.select(F.col(f"`{conv}`").alias("conv"), F.lit(side == "chosen").alias("chosen"), own.alias("t")).where("conv is not null")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEADER), t["role"], F.lit(START), t["text"], F.lit(END))), "")


def _completion(turns: Column, opened: Column) -> Column:
    """The rendering of the turns after the prompt; without its first header if the prompt has it."""
    head = F.length(F.concat(F.lit(HEADER), F.lit(TRAINED), F.lit(START)))
    return F.when(opened, F.substr(render(turns), head + 1)).otherwise(render(turns))


def _spans(turns: Column, opened: Column) -> Column:
    """(start, end) of the trainable characters of a completion, end exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(F.concat(F.lit(HEADER), t["role"], F.lit(START)))
        end = start + F.length(t["text"]) + F.lit(len(END))
        own = F.struct(start.alias("start"), (end - F.lit(1)).alias("end"))  # the marker without its line break
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(turns, zero, step)["spans"]
    shift = F.when(opened, F.length(F.lit(HEADER + TRAINED + START))).otherwise(F.lit(0))
    return F.transform(found, lambda s: F.struct((s["start"] - shift).alias("start"), (s["end"] - shift).alias("end")))


def preferences(chosen: DataFrame, rejected: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_ties: bool = False) -> DataFrame:
    """(conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask), a row for each conversation."""
    both = _turns(chosen, "chosen", conv, turn, role, text).union(_turns(rejected, "rejected", conv, turn, role, text))
    side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("chosen") == flag, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    own = both.groupBy("conv").agg(side(True).alias("c"), side(False).alias("r")).where("size(c) > 0 and size(r) > 0")
    own = own.withColumn("least", F.least(F.size("c"), F.size("r")))
    apart = F.array_min(F.filter(F.sequence(F.lit(1), F.col("least")), lambda i: F.element_at("c", i) != F.element_at("r", i)))
    own = own.withColumn("k", F.coalesce(apart - 1, F.col("least")))
    if not keep_ties:
        own = own.where("k < greatest(size(c), size(r))")
    own = own.select("conv", "k", F.slice("c", 1, F.col("k")).alias("p"), F.expr("slice(c, k + 1, size(c))").alias("c"), F.expr("slice(r, k + 1, size(r))").alias("r"))
    first = lambda x: F.coalesce(F.get(x, F.lit(0))["role"] == TRAINED, F.lit(False))
    own = own.withColumn("opened", first("c") & first("r"))
    opened = F.col("opened")
    prompt = F.concat(render(F.col("p")), F.when(opened, F.lit(HEADER + TRAINED + START)).otherwise(F.lit("")))
    return own.select(
        F.col("conv").alias(conv), F.col("k").cast("int").alias("n_common"), prompt.alias("prompt"),
        *[_completion(F.col(x), opened).alias(name) for x, name in (("c", "chosen"), ("r", "rejected"))],
        *[_spans(F.col(x), opened).alias(f"{name}_mask") for x, name in (("c", "chosen"), ("r", "rejected"))],
    )


def mask_text(mask: Column) -> Column:
    """A mask as text: "start:end start:end"."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ")
