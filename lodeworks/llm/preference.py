"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once, as the prompt; the rest of either side is a completion with
the character spans that a loss may count: the assistant's turns with their end marks, not the other turns or heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conversations from which a borrowed reply can come: those of one range of ids.
RING = 512
HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"


def turns_of(conversations: DataFrame, ring: int = RING) -> DataFrame:
    """(ring, conv_id, turns): each conversation's turns in order of turn, then role, then text; nulls come first.

    Rows without conv_id go. A null role is ``unknown``, a null text is empty. A conversation is one training example,
    so it is gathered whole; rings are ranges of ids and hold at most ``ring`` conversations.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / ring).alias("ring"),
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    return rows.repartition("ring").groupBy("ring", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def borrowed(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """(pair_id, chosen, rejected): rejected is the conversation with its last reply taken from the next one of its
    ring (of the last, the first). Without a reply there is no other side: rejected is null."""
    mine = F.transform("turns", lambda t: t["role"] == role)
    last = F.when(F.array_contains(mine, True), F.size("turns") - F.array_position(F.reverse(mine), True) + 1).otherwise(0)
    t = turns.withColumn("at", last.cast("int")).withColumn("reply", F.when(F.col("at") > 0, F.get("turns", F.col("at") - 1)["text"]))
    w = Window.partitionBy("ring", F.col("at") > 0).orderBy("conv_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("other", F.coalesce(F.lead("reply").over(w), F.first("reply").over(whole)))
    swapped = F.transform("turns", lambda x, i: F.when(i == F.col("at") - 1, F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.col("other").alias("text"))).otherwise(x))
    return t.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("at") > 0, swapped).alias("rejected"))


def _clean(text: Column) -> Column:
    """A text that can't be taken for marks of the format."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _clean(t["role"]), F.lit(BODY), _clean(t["text"]), F.lit(END))), "")


#: Turns whose spans are added up in one go: appending to an array copies it, so long arrays are made of short ones.
_BLOCK = 256


def spans(turns: Column, role: str = "assistant") -> Column:
    """(begin, end) of what the loss counts in ``render(turns)``: texts of the role with their end marks.

    The running length is carried from turn to turn and from block to block of turns.
    """

    def one(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_clean(turn["role"])) + len(HEAD) + len(BODY)
        end = begin + F.length(_clean(turn["text"])) + len(END)
        new = F.when(turn["role"] == role, F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], new).alias("spans"))

    def block(state: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(turns, k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(state["at"].alias("at"), none.alias("spans")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(state["spans"], p["spans"]).alias("spans")))[0]

    none = F.array().cast("array<struct<begin:int,end:int>>")
    blocks = F.sequence(F.lit(0), F.floor(F.size(turns) / _BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("spans")), block)["spans"]


def format_pairs(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) for pairs of (pair_id, chosen,
    rejected) arrays of (turn, role, text).

    Turns are common as far as role and text agree. Sides that are equal, or a side that is the beginning of the
    other, leave an empty completion without spans. A null side is an empty one; then nothing is common.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a, b = F.coalesce("chosen", none), F.coalesce("rejected", none)
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, False)
    p = pairs.select("pair_id", a.alias("a"), b.alias("b"), F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int").alias("prompt_turns"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    p = p.select("pair_id", "prompt_turns", render(F.slice("a", 1, F.col("prompt_turns"))).alias("prompt"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return p.select("pair_id", "prompt_turns", "prompt", render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"), spans(F.col("a"), role).alias("chosen_spans"), spans(F.col("b"), role).alias("rejected_spans"))
