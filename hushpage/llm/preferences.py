"""Preference formatting: pairs of a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns is rendered once as the prompt. What follows in either conversation is its
completion, with a mask in runs of characters: only the words of the scored roles, and the marker that ends
their turn, count for the loss. Everything is an expression on arrays of turns, so formatting needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """The text with markers in it broken up, so that no text can begin or end a turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", r"< |$1| >")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), _plain(F.regexp_replace(turn["role"], r"[\r\n]+", " ")), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _plain(t["text"]), F.lit(END + "\n"))), "")


def _mask(turns: Column, scored: tuple[str, ...]) -> Column:
    """Runs of characters (length, scored) that cover the rendered turns: header, words with end marker, line end."""

    def runs(t: Column) -> Column:
        body = F.length(_plain(t["text"])) + len(END)
        return F.array(
            F.struct(F.length(_header(t)).alias("length"), F.lit(False).alias("scored")),
            F.struct(body.alias("length"), t["role"].isin(*scored).alias("scored")),
            F.struct(F.lit(1).alias("length"), F.lit(False).alias("scored")),
        )

    return F.flatten(F.transform(turns, runs))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns that both arrays begin with."""
    differ = F.array_position(F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.size(chosen)).otherwise(differ - 1).cast("int")


def format_preferences(
    pairs: DataFrame,
    id_col: str = "pair_id",
    chosen_col: str = "chosen",
    rejected_col: str = "rejected",
    scored: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(id, n_chosen, n_rejected, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of every row.

    The conversations are arrays of structs with the strings ``role`` and ``text``. The numbers count turns. A mask
    covers its completion exactly. Equal conversations have two empty completions, and where one begins the
    other, one is empty. Null arrays count as empty, a null turn, role or text as empty strings; an
    empty role is not scored. Repeated rows and null ids are formatted like others, an empty table gives no
    rows. Only the three named columns are read, so other columns may have any name.
    """

    def clean(name: str) -> Column:
        turns = F.transform(
            F.col(name), lambda t: F.struct(*(F.coalesce(t[field], F.lit("")).alias(field) for field in ("role", "text")))
        )
        return F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))

    both = pairs.select(F.col(id_col).alias("id"), clean(chosen_col).alias("c"), clean(rejected_col).alias("r"))
    both = both.withColumn("common", common_turns(F.col("c"), F.col("r")))
    left = {name: F.slice(name, F.col("common") + 1, F.size(name)) for name in ("c", "r")}
    return both.select(
        F.col("id").alias(id_col),
        F.size("c").alias("n_chosen"),
        F.size("r").alias("n_rejected"),
        F.col("common").alias("n_common"),
        _rendered(F.slice("c", F.lit(1), F.col("common"))).alias("prompt"),
        _rendered(left["c"]).alias("chosen"),
        _rendered(left["r"]).alias("rejected"),
        _mask(left["c"], scored).alias("chosen_mask"),
        _mask(left["r"], scored).alias("rejected_mask"),
    )


def answer_swaps(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of every conversation: it is chosen over itself with another's last answer.

    Conversations 2 i and 2 i + 1 lend each other their last assistant turn, so one exchange by i brings them
    together. The rejected one ends with the lent turn; where none can be lent, it ends before. A conversation without assistant
    turns is rejected as it is. Turns go by ``turn``, nulls first, ties by role and text; repeated rows are turns
    of their own. Rows with a null ``conv_id`` belong to no conversation. An empty table gives no rows. A pair becomes one row,
    so two conversations together must fit into one, as a document's text must.
    """
    turn = F.struct("turn", "role", "text")
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    rows = turns.where("conv_id IS NOT NULL")
    couples = rows.groupBy(F.col("conv_id").bitwiseAND(F.lit(-2)).alias("even")).agg(
        F.sort_array(F.collect_list(F.when(~odd, turn))).alias("a"), F.sort_array(F.collect_list(F.when(odd, turn))).alias("b")
    )
    ways = F.array(
        F.struct(F.col("even").alias("pair_id"), F.col("a").alias("own"), F.col("b").alias("other")),
        F.struct((F.col("even") + 1).alias("pair_id"), F.col("b").alias("own"), F.col("a").alias("other")),
    )
    each = couples.select(F.inline(ways)).where(F.size("own") > 0)
    last = F.array_max(F.transform("own", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)))
    answers = F.filter("other", lambda t: t["role"] == "assistant")
    lent = F.slice(answers, F.greatest(F.size(answers), F.lit(1)), F.lit(1))
    each = each.withColumn("last", last)
    swapped = F.when(F.col("last") > 0, F.concat(F.slice("own", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), lent)).otherwise(F.col("own"))
    return each.select("pair_id", F.col("own").alias("chosen"), swapped.alias("rejected"))
