"""Preference formatting: chosen and rejected conversations rendered as one prompt and two masked completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rendering of a turn; what lies between is the turn's text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversation_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id and ``turns``, an array of (turn, role, text) by turn, ties by role and text.

    Nulls come first and stay; repeated rows are repeated turns; other columns are ignored.
    """
    turn = F.struct("turn", "role", "text")
    return conversations.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns with equal role and text."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    pairs = F.arrays_zip(F.slice(chosen, 1, shorter).alias("a"), F.slice(rejected, 1, shorter).alias("b"))
    differs = F.array_position(F.transform(pairs, lambda p: _same(p["a"], p["b"])), False)
    return F.when(differs > 0, differs - 1).otherwise(shorter).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _masked(turns: Column) -> Column:
    """Pieces of a completion, each with whether it is trained on: an assistant's text and end mark are, the rest is not."""

    def pieces(turn: Column) -> Column:
        trained = F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False))
        return F.array(
            F.struct(_head(turn).alias("text"), F.lit(False).alias("trained")),
            F.struct(_body(turn).alias("text"), trained.alias("trained")),
        )

    return F.flatten(F.transform(turns, pieces))


def _rest(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def _text_of() -> Callable[[Column], Column]:
    return lambda piece: piece["text"]


def format_pairs(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """``chosen`` and ``rejected`` turn arrays per row to ``prompt``, ``n_prefix`` and, for each side,
    ``*_completion`` (text) and ``*_pieces`` (text and loss mask, in order).

    The longest common prefix of turns is rendered once, as prompt. A null side has no turns;
    a null role or text renders as empty; equal conversations have empty completions.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    rows = pairs.select(
        F.col(id_col).alias(id_col), F.coalesce("chosen", none).alias("_a"), F.coalesce("rejected", none).alias("_b")
    )
    rows = rows.withColumn("n_prefix", common_prefix(F.col("_a"), F.col("_b")))
    n = F.col("n_prefix")
    rows = rows.select(
        id_col,
        "n_prefix",
        render(F.slice("_a", 1, n)).alias("prompt"),
        _masked(_rest(F.col("_a"), n)).alias("chosen_pieces"),
        _masked(_rest(F.col("_b"), n)).alias("rejected_pieces"),
    )
    for side in ("chosen", "rejected"):
        text = F.array_join(F.transform(f"{side}_pieces", _text_of()), "")
        rows = rows.withColumn(f"{side}_completion", text)
    return rows


def trained_text(pieces: Column) -> Column:
    """The text a completion is trained on."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["trained"]), _text_of()), "")


def _to_last_answer(turns: Column) -> Column:
    """Turns up to the last one of the trained role; all turns where there is none."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1))
    return F.slice(turns, 1, F.coalesce(F.array_max(places), F.size(turns)))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations: ``pair_id``, ``chosen`` up to its last answer, ``rejected`` with the text of
    that answer taken from the conversation of the next id; without such a conversation the answer is left out.

    A conversation without answers ends with its last turn. Conversations with a null id are one, and get no
    other's text.
    """
    turns = conversation_turns(conversations).select("conv_id", _to_last_answer(F.col("turns")).alias("turns"))
    last = F.element_at("turns", -1)
    others = turns.select((F.col("conv_id") - 1).alias("conv_id"), F.struct(last["text"].alias("text")).alias("other"))
    rows = turns.join(others, "conv_id", "left")
    before = F.slice("turns", 1, F.size("turns") - 1)
    answer = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("other.text").alias("text"))
    return rows.select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.when(F.col("other").isNull(), before).otherwise(F.concat(before, F.array(answer))).alias("rejected"),
    )
