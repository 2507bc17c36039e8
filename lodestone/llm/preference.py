"""Preference formatting: a chosen and a rejected conversation to one prompt and two masked completions.

The prompt is the longest common prefix of turns, rendered once. Each
completion renders the turns after it, with a loss mask of character ranges:
only what the assistant says counts. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn (fixed values of the chat format).
START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))))


def _mask(turns: Column) -> Column:
    """[start, end) of the assistant's texts in the rendered turns, with the end mark, as the part that is learnt."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(_head(turn))
        end = start + F.char_length(turn["text"]) + len(END)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def _common_prefix(a: Column, b: Column) -> Column:
    """Turns at the start of both arrays that are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order; null roles and texts are empty, turns without a conversation are left out.

    Turns with one number go by role, then text; repeated turns stay repeated.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), turn.alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv").agg(turns.alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair, chosen, rejected as arrays of (role, text)) to the columns of a preference row.

    n_prompt_turns, prompt, chosen_completion, chosen_mask, rejected_completion,
    rejected_mask. A missing side is an empty conversation; of equal
    conversations both completions are empty.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair", F.coalesce("chosen", empty).alias("a"), F.coalesce("rejected", empty).alias("b"))
    cut = sides.withColumn("n", _common_prefix(F.col("a"), F.col("b")))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))

    cut = cut.select("pair", "n", F.slice("a", 1, F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "pair",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen_completion"),
        _mask(F.col("a")).alias("chosen_mask"),
        _render(F.col("b")).alias("rejected_completion"),
        _mask(F.col("b")).alias("rejected_mask"),
    )


def pairs_by_number(df: DataFrame, **columns: str) -> DataFrame:
    """(pair, chosen, rejected): conversation 2k is chosen and 2k + 1 rejected in pair k; a missing one is null."""
    rows = conversations(df, **columns)
    pair = F.expr("(conv - pmod(conv, 2)) div 2").cast("long")
    side = F.pmod("conv", F.lit(2)) == 0
    rows = rows.select(pair.alias("pair"), side.alias("first"), "turns")
    return rows.groupBy("pair").agg(F.max(F.when(F.col("first"), F.col("turns"))).alias("chosen"), F.max(F.when(~F.col("first"), F.col("turns"))).alias("rejected"))


def mask_text(mask: Column) -> Column:
    """A mask as text: start-end pairs, comma-separated."""
    return F.concat_ws(",", F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
