"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant, all others
as named users, and system messages as they are. Only the assistant's words and end mark are
trained on. A rendered dialogue is a sequence of messages, one row each, with its place in the dialogue's
text; so a conversation of any length is spread over rows, never gathered into one.

Everything is DataFrame functions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "unknown"
#: Turns of a conversation that are ordered together.
STRETCH = 1024


def _written(name: Column) -> Column:
    """A speaker's name as it stands in a rendered message; percent codes can be read back."""
    for mark in "%\n<>":
        name = F.replace(name, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return F.when(name == UNNAMED, f"%{ord(UNNAMED[0]):02X}{UNNAMED[1:]}").otherwise(F.coalesce(name, F.lit(UNNAMED)))


def perspectives(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation, participant and message.

    Columns: conv_id, perspective (whose view it is), turn, role, name, rendered, trained, offset (where the message
    begins in the rendered dialogue), mask_start and mask_end (the stretch that is trained on, in the dialogue's
    characters; null where there is none). Messages are ordered by turn (null turns last), then by speaker
    and text.

    ``system`` is no participant; a conversation without others gives no rows. A null speaker is a participant named
    "unknown"; one who really has that name is written "%75nknown". A null text is empty; a null conversation is a conversation like others; a repeated row is a message of its own.
    Marks that occur in a text are broken up, and line breaks, "<", ">" and "%" in a name are written as percent codes, which
    keeps different names apart, so that no message can forge another. Other columns play no part.
    """
    said = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        _written(F.col(speaker).cast("string")).alias("speaker"),
        F.replace(text_or_empty(text), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    views = (
        said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    is_system = F.col("speaker") == SYSTEM
    role = F.when(is_system, SYSTEM).when(own, "assistant").otherwise("user")
    seen = said.join(views, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    seen = seen.select(
        "conv_id", "perspective", "turn", "speaker", "text", role.alias("role"),
        F.when(role == "user", F.col("speaker")).alias("name"),
        F.floor(F.col("turn") / STRETCH).alias("stretch"),
    )
    head = F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", head)
    seen = seen.withColumn("rendered", F.concat("head", "text", F.lit(END + "\n")))
    dialogue = ["conv_id", "perspective"]
    lengths = seen.groupBy(*dialogue, "stretch").agg(F.sum(F.length("rendered")).alias("length"))
    before = Window.partitionBy(*dialogue).orderBy(F.col("stretch").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select(
        *(F.col(c).alias(f"l_{c}") for c in (*dialogue, "stretch")), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start")
    )
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in (*dialogue, "stretch")]
    within = (
        Window.partitionBy(*dialogue, "stretch").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = seen.withColumn("inside", F.coalesce(F.sum(F.length("rendered")).over(within), F.lit(0)))
    placed = inside.join(lengths, same[0] & same[1] & same[2]).withColumn("offset", (F.col("start") + F.col("inside")).cast("long"))
    trained = F.col("role") == "assistant"
    begin = F.col("offset") + F.length("head")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "rendered", trained.alias("trained"), "offset",
        F.when(trained, begin).alias("mask_start"),
        F.when(trained, begin + F.length("text") + len(END)).alias("mask_end"),
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """The rendered messages put together: (conv_id, perspective, part, text, masks), masks as (start, end) in the dialogue.

    A dialogue is one row unless its turns pass a multiple of ``STRETCH``; further parts are rows of their own, in order.
    """
    piece = F.struct("offset", "rendered", "mask_start", "mask_end")
    return (
        rendered.groupBy("conv_id", "perspective", F.floor(F.col("turn") / STRETCH).alias("part"))
        .agg(F.sort_array(F.collect_list(piece)).alias("p"))
        .select(
            "conv_id", "perspective", "part", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"),
            F.transform(
                F.filter("p", lambda x: x["mask_start"].isNotNull()),
                lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")),
            ).alias("masks"),
        )
    )
