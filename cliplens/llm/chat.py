"""Chat formatting from every participant's point of view.

A dialogue is rendered once for each of its speakers: that one is the
assistant, whose text is to be learned, the others are users with their names.
Long dialogues are cut into parts of a bounded number of turns, so that no row
holds a dialogue of any length; the parts of one point of view follow one
another by number and together are the whole dialogue.

The place of a turn is found without bringing a dialogue together: turns are
range-partitioned in order, numbered inside each partition, and the counts of
the partitions before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplens.session import materialize

PART_TURNS = 64
SYSTEM = "system"
NOBODY = "unknown"


def place_turns(turns: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """``turns`` with ``__at``, the place of each in its dialogue from 0, and ``__speakers``.

    The order is total up to rows alike in all columns. A dialogue that spans
    many partitions is handled piece by piece.
    """
    ranged = materialize(
        turns.repartitionByRange(F.col(conv).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
        .withColumn("__piece", F.spark_partition_id()), "turns")
    pieces = ranged.groupBy(conv, "__piece").agg(
        F.count("*").alias("__n"), F.collect_set("__speaker").alias("__some"))
    all_pieces = Window.partitionBy(conv)
    before = all_pieces.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        F.col(conv).alias("__conv"), F.col("__piece").alias("__of"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__some").over(all_pieces)))).alias(
            "__speakers"))
    inside = Window.partitionBy(conv, "__piece").orderBy(
        *[F.col(c).asc_nulls_first() for c in order])
    placed = ranged.withColumn("__row", F.row_number().over(inside))
    return placed.join(starts, placed[conv].eqNullSafe(starts["__conv"]) & (
        placed["__piece"] == starts["__of"])).withColumn(
        "__at", F.col("__start") + F.col("__row") - 1)


def _message(turn: Column, speaker: Column, opening: str, closing: str) -> tuple[Column, Column]:
    """Head and body of one message as ``speaker`` sees it."""
    own = turn["name"].eqNullSafe(speaker)
    head = F.when(own, F.lit(opening + "assistant\n")).when(
        turn["name"].isNull() & turn["system"], F.lit(opening + "system\n")).otherwise(
        F.concat(F.lit(opening + "user name="), F.coalesce(turn["name"], F.lit(NOBODY)), F.lit("\n")))
    return head, F.concat(turn["text"], F.lit(closing + "\n"))


def render_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text",
                        part_turns: int = PART_TURNS, opening: str = "<|im_start|>",
                        closing: str = "<|im_end|>") -> DataFrame:
    """(conv, speaker, part, first_turn, n_turns, rendered, masks): one row for each part.

    Speakers are the distinct roles of a dialogue but "system". ``masks`` are the
    character ranges of ``rendered`` that the speaker said, end mark included,
    which are to be learned; ``first_turn`` is the place of the part's first turn.

    Turns are in order of turn (NULL first), role and text; ties beyond that are
    alike in all that is rendered. A NULL or blank role is the user "unknown" and
    no speaker of its own; a NULL text is an empty message. Marks inside texts
    and names are broken by a backslash, so that they end nothing; line feeds in
    names become spaces. Turns of NULL dialogue form one dialogue. A dialogue
    without speakers gives no rows. Other columns of ``turns`` are not looked at.
    """
    def safe(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(opening), F.lit(opening[:1] + "\\" + opening[1:])),
                         F.lit(closing), F.lit(closing[:1] + "\\" + closing[1:]))

    role = F.trim(F.regexp_replace(F.coalesce(F.col(role_col), F.lit("")), r"\s+", " "))
    said = turns.select(
        F.col(conv_col).alias("__conv_id"), F.col(turn_col).alias("__turn"),
        F.when((role != "") & (role != SYSTEM), safe(role)).alias("__speaker"),
        (role == SYSTEM).alias("__system"),
        safe(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    placed = place_turns(said, "__conv_id", ["__turn", "__speaker", "__system", "__text"])
    parts = placed.groupBy("__conv_id", F.expr(f"__at div {part_turns}").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("__at").alias("at"), F.col("__speaker").alias("name"),
            F.col("__system").alias("system"), F.col("__text").alias("text")))).alias("turns"),
        F.first("__speakers").alias("speakers"))
    seen = parts.select("__conv_id", "part", "turns", F.explode("speakers").alias("speaker"))

    def add(state: Column, turn: Column) -> Column:
        head, body = _message(turn, F.col("speaker"), opening, closing)
        start = state["length"] + F.length(head)
        end = start + F.length(body) - 1  # the line feed after the end mark is not learned
        mine = turn["name"].eqNullSafe(F.col("speaker"))
        return F.struct(
            (start + F.length(body)).alias("length"),
            F.when(mine, F.concat(state["masks"], F.array(F.struct(
                start.alias("start"), end.alias("end"))))).otherwise(state["masks"]).alias("masks"))

    masks = F.aggregate(
        "turns", F.struct(F.lit(0).alias("length"),
                          F.array().cast("array<struct<start:int,end:int>>").alias("masks")),
        add, lambda state: state["masks"])
    rendered = F.concat_ws("", F.transform("turns", lambda t: F.concat(
        *_message(t, F.col("speaker"), opening, closing))))
    return seen.select(
        F.col("__conv_id").alias(conv_col), "speaker", "part",
        F.element_at("turns", 1)["at"].alias("first_turn"),
        F.size("turns").cast("bigint").alias("n_turns"),
        rendered.alias("rendered"), masks.alias("masks"))
