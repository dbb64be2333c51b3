"""Preference pairs: the common turns once as a prompt, and two masked completions.

A conversation is an array of turns (role, text). The longest run of turns with which both
chosen and rejected begin is rendered once, as the prompt; what follows in each is its
completion, and its mask lists the spans [start, end) of characters that a model learns:
the text and the end marker of assistants' turns.

DataFrame operations only. Cases: a null conversation is an empty one; equal ones have all
turns in the prompt and empty completions; a null role is "user", a null text is empty, and
both count as such when turns are compared; in ``turns``, rows that agree in all four
columns count once, a null turn number comes first, ties go by role and text, and rows
with a null conversation id make one conversation; an empty table gives an empty table;
other columns stay as they are. One conversation is one row, as its prompt is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, AFTER = "<|im_start|>", "<|im_end|>", "\n"
LEARNED = "assistant"


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_set(one))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _sound(conversation: str) -> Column:
    filled = lambda x: F.struct(F.coalesce(x["role"], F.lit("user")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))
    return F.coalesce(F.transform(F.col(conversation), filled), F.array().cast("array<struct<role:string,text:string>>"))


def _open(x: Column) -> Column:
    return F.concat(F.lit(BEGIN), x["role"], F.lit(AFTER))


def render(conversation: Column) -> Column:
    """All turns as one string."""
    return F.array_join(F.transform(conversation, lambda x: F.concat(_open(x), x["text"], F.lit(END + AFTER))), "")


def mask(conversation: Column) -> Column:
    """Spans of the rendered string that are learned."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.char_length(_open(x))
        end = begin + F.char_length(x["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(AFTER)).alias("at"), F.when(x["role"] == LEARNED, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(conversation, start, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The other columns of ``pairs``, and n_prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    made = {"n_prefix_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"}
    rest = [c for c in pairs.columns if c not in made | {chosen, rejected}]
    held = F.struct(*[pairs[c] for c in rest]) if rest else F.struct(F.lit(0))
    both = pairs.select(held.alias("_rest"), _sound(chosen).alias("_a"), _sound(rejected).alias("_b"))
    same = F.array_position(F.zip_with("_a", "_b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    counted = both.withColumn("n_prefix_turns", F.when(same > 0, same - 1).otherwise(F.size("_a")).cast("int"))
    n = F.col("n_prefix_turns")
    after = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    cut = counted.select("_rest", "n_prefix_turns", F.slice("_a", F.lit(1), n).alias("_p"), after("_a").alias("_a"), after("_b").alias("_b"))
    return cut.select(*[F.col("_rest")[c].alias(c) for c in rest], "n_prefix_turns", render(F.col("_p")).alias("prompt"), render(F.col("_a")).alias("chosen"), render(F.col("_b")).alias("rejected"), mask(F.col("_a")).alias("chosen_mask"), mask(F.col("_b")).alias("rejected_mask"))


def replayed(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected) from (key, turns) without preference labels: chosen runs to the last
    assistant's turn; rejected has in its place the conversation's first reply once more, or
    nothing if there was one only. Conversations without a reply make no pair."""
    replies = F.filter("turns", lambda x: x["role"] == LEARNED)
    last = F.aggregate(F.transform("turns", lambda x, i: F.when(x["role"] == LEARNED, i)), F.lit(-1), lambda a, i: F.greatest(a, F.coalesce(i, F.lit(-1))))
    some = conversations.withColumn("_replies", replies).withColumn("_last", last).where(F.col("_last") >= 0)
    other = F.struct(F.lit(LEARNED).alias("role"), F.when(F.size("_replies") > 1, F.get("_replies", F.lit(0))["text"]).otherwise("").alias("text"))
    return some.select(key, F.slice("turns", F.lit(1), F.col("_last") + 1).alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_last")), F.array(other)).alias("rejected"))
