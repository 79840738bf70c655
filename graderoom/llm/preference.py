"""Preference formatting: one shared prompt and two masked completions per pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import materialise, with_global_index

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = "array<struct<role:string,text:string>>"


def _plain(text: Column) -> Column:
    """Null is empty; a text cannot hold the markers of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """[start, end) in characters of the rendered turns whose text is learned; all else is masked."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(_head(t))
        last = first + F.length(t["text"])
        here = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct(
            (last + len(CLOSE)).alias("at"),
            F.when(t["role"] == trained_role, F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def gather_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order (role, text).

    A null role is 'unknown', a null text empty; turns that repeat a number follow each other by
    role and text; a null turn number comes first. Nothing says which rows without a conv_id belong
    together, so each is a conversation of its own, with a null conv_id.
    """
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("turn"),
                F.coalesce("role", F.lit("unknown")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text")))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    alone = turns.where("conv_id is null").select("conv_id", F.array(F.struct(
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turns"))
    return known.union(alone)


def format_preferences(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Render pairs: columns ``chosen`` and ``rejected`` (arrays of struct(role, text)).

    n_common is the number of turns of the longest common prefix (equal role and text); prompt
    renders it once. chosen_text and rejected_text render what follows; chosen_spans and
    rejected_spans mark the characters of ``trained_role`` turns in them, the rest is masked. A
    null side has no turns: the prompt is then empty and the other side is rendered whole. Equal
    sides give empty completions. All other columns are kept; result columns replace columns of the
    same name.
    """
    empty = F.array().cast(TURN)
    clean = {side: F.transform(
        F.coalesce(F.col(side).cast(TURN), empty),
        lambda t: F.struct(
            _plain(F.coalesce(t["role"], F.lit("unknown"))).alias("role"), _plain(t["text"]).alias("text")))
        for side in ("chosen", "rejected")}
    same = F.transform(
        F.arrays_zip(F.col("_c"), F.col("_r")),
        lambda z: F.coalesce((z["_c"]["role"] == z["_r"]["role"]) & (z["_c"]["text"] == z["_r"]["text"]), F.lit(False)))
    first_other = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    common = F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")

    def after(name: str) -> Column:
        return F.slice(F.col(name), F.col("n_common") + 1, F.greatest(F.size(name), F.lit(1)))

    return (
        pairs.drop("n_common", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans")
        .withColumns({"_c": clean["chosen"], "_r": clean["rejected"]})
        .withColumn("n_common", common)
        .withColumns({
            "prompt": _render(F.slice("_c", F.lit(1), F.col("n_common"))),
            "_c_rest": after("_c"), "_r_rest": after("_r")})
        .withColumns({
            "chosen_text": _render(F.col("_c_rest")), "rejected_text": _render(F.col("_r_rest")),
            "chosen_spans": _spans(F.col("_c_rest"), trained_role),
            "rejected_spans": _spans(F.col("_r_rest"), trained_role)})
        .drop("_c", "_r", "_c_rest", "_r_rest")
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Pair conversations that stand next to each other in the order of their turns' digests.

    ``conversations`` has conv_id, turns and a number ``_conv`` of its own for each row, by which the
    turns are joined. Conversations with equal opening turns are neighbours, so pairs share as long a
    prefix as their group allows. The order is a distributed numbering, not a window over a group: an
    opening shared by a third of all conversations spans many ranges. Numbers 2i and 2i + 1 form pair
    i, the smaller conv_id as chosen and a null one as rejected; with an odd count the last has no
    rejected side.
    """
    opening = F.transform("turns", lambda t: F.md5(F.concat_ws("\n", t["role"], t["text"])))
    slim = conversations.select("_conv", "conv_id", F.array_join(F.slice(opening, 1, 3), "").alias("_open"), F.md5(
        F.array_join(opening, "")).alias("_all"))
    numbered = with_global_index(slim, ["_open", "_all", "conv_id"], "_at", "preference-order")
    side = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "_conv")
    ids = numbered.groupBy(F.expr("_at div 2").alias("pair_id")).agg(
        F.min(side).alias("_first"), F.when(F.count(F.lit(1)) > 1, F.max(side)).alias("_second"))
    ids = ids.select("pair_id", F.col("_first.conv_id").alias("chosen_id"), F.col("_second.conv_id").alias("rejected_id"),
                     F.col("_first._conv").alias("_c_conv"), F.col("_second._conv").alias("_r_conv"))
    return (
        ids.join(conversations.select(F.col("_conv").alias("_c_conv"), F.col("turns").alias("chosen")), "_c_conv", "left")
        .join(conversations.select(F.col("_conv").alias("_r_conv"), F.col("turns").alias("rejected")), "_r_conv", "left")
        .drop("_c_conv", "_r_conv")
    )


def preferences_from_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Preference rows of a whole table of turns (conv_id, turn, role, text); none if it is empty."""
    # written once, so that a conversation keeps its number
    numbered = gather_turns(turns).withColumn("_conv", F.monotonically_increasing_id())
    conversations = materialise(numbered, "preference-turns")
    return format_preferences(pair_neighbours(conversations), trained_role)
