"""Preference samples: one prompt, two masked completions.

The prompt is the longest common prefix of turns of the chosen and the rejected
conversation. Roles and texts must be equal (null equals null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order. A conversation is one training sample, so its turns fit a row."""
    return (
        turns.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    )


def pair_ids(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): which conversations are compared.

    Conversations 2k and 2k + 1 are two answers to compare, the first one is chosen. Besides,
    conversations that open with the same turn are compared with the fullest of them (most
    turns, then most characters, then the least conv_id), which is chosen. A group of n gives
    n - 1 pairs, so a very common opening adds rows in proportion; no pair comes twice.
    """
    opening = F.sha2(F.concat_ws("\x1f", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    rank = F.struct(F.size("turns").alias("n"), chars.alias("chars"), (-F.col("conv_id")).alias("low"))
    rows = convs.select("conv_id", opening.alias("opening"), rank.alias("rank"))
    best = rows.groupBy("opening").agg(F.max("rank").alias("top"), F.count("*").alias("members")).where("members > 1").select("opening", (-F.col("top.low")).alias("chosen_id"))
    alike = rows.join(best, "opening").where("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
    ids = convs.select("conv_id")
    odd = ids.where("conv_id % 2 <> 0").select((F.col("conv_id") - 1).alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    return alike.union(odd.join(ids, F.col("chosen_id") == F.col("conv_id"), "left_semi")).distinct()


def preference_pairs(convs: DataFrame) -> DataFrame:
    """The pairs of ``pair_ids`` with the turns of both sides."""
    side = lambda s: convs.select(F.col("conv_id").alias(f"{s}_id"), F.col("turns").alias(s))
    return pair_ids(convs).join(side("rejected"), "rejected_id").join(side("chosen"), "chosen_id").select("chosen_id", "rejected_id", "chosen", "rejected")


def safe(text: Column) -> Column:
    """Control marks inside a text lose their meaning: ``<|`` becomes ``< |``."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit(CLOSE + "\n"), safe(turn["text"]), F.lit(OPEN + "end" + CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """``start-end`` of the assistant's words and end marks in the rendered turns, as code points, joined by ``;``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc, turn):
        head = F.length(safe(turn["role"])) + F.lit(len(OPEN + CLOSE) + 1)
        end = acc["at"] + F.length(rendered(turn))
        span = F.concat((acc["at"] + head).cast("string"), F.lit("-"), (end - 1).cast("string"))
        more = F.when(acc["spans"] == "", span).otherwise(F.concat(acc["spans"], F.lit(";"), span))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", more).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt, completions, loss spans of each (chosen_id, rejected_id, chosen, rejected).

    If one conversation begins with the whole other one, that other completion is empty;
    identical conversations give two empty completions. ``status`` tells: pair, prefix or
    identical. Null roles are ``none``, null texts are empty, turns without a conv_id belong
    to no conversation, repeated turns stay repeated, an empty table gives no rows. Other
    columns are not looked at. Texts are used whole.
    """
    short = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    rows = pairs.withColumn("prefix", F.when(first > 0, first - 1).otherwise(short).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("prefix") + 1, F.size(c))
    rows = rows.select(
        "chosen_id", "rejected_id", F.col("prefix").alias("prompt_turns"), F.slice("chosen", F.lit(1), F.col("prefix")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r")
    )
    return rows.select(
        "chosen_id", "rejected_id", "prompt_turns",
        F.when((F.size("c") > 0) & (F.size("r") > 0), "pair").when(F.size("c") + F.size("r") > 0, "prefix").otherwise("identical").alias("status"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen_text"), loss_spans(F.col("c")).alias("chosen_loss"),
        render(F.col("r")).alias("rejected_text"), loss_spans(F.col("r")).alias("rejected_loss"),
    )
