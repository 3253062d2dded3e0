"""Chat formatting: every participant's view of a dialogue, with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bucket_offsets

#: Speakers that take no view of their own; they are rendered under their own name in every view.
NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
RUN_TURNS = 256


def turn_key(turn: Column) -> Column:
    """Sort place of a turn, null last."""
    return F.coalesce(turn.cast("long"), F.lit((1 << 62)))


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv, view, turn, role, name, segment, mask, start, end): each dialogue once per participant.

    In the view of a participant their own turns are ``assistant`` with mask 1, those of others
    ``user`` with their name, narrators ``system`` by name; masks are 0 there. A view's segments in
    order of ``start`` are its rendered text; ``start`` and ``end`` are character offsets in it.
    Turns and views meet by an equi-join on the dialogue, one row per turn and view; offsets are
    two-level sums over runs of RUN_TURNS turn numbers, so no task needs a dialogue whole.

    A null speaker is the participant "unknown", a null text is empty, a null turn stands last, a
    null dialogue id is a dialogue of its own. Ties in turn stand by speaker and text; repeated rows
    are rendered as often. A dialogue of narrators alone has no view, an empty table no rows. Texts and
    dialogues may be of any length; only the four columns are read, so others may have any name.
    """
    turns = df.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.concat(F.lit("#"), F.col(conv_col).cast("string")), F.lit("")).alias("_c"),
        F.col(turn_col).alias("turn"), turn_key(F.col(turn_col)).alias("_t"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    views = turns.select("_c", F.col("speaker").alias("view")).where(~F.col("view").isin(*NARRATORS)).distinct()
    own = F.col("speaker") == F.col("view")
    narrator = F.col("speaker").isin(*NARRATORS)
    role = F.when(own, "assistant").when(narrator, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~narrator, F.col("speaker"))
    seen = turns.join(views, "_c").withColumns({"role": role, "name": name, "mask": own.cast("int")})
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("segment", F.concat(head, "text", F.lit(CLOSE))).withColumns({
        "_n": F.char_length("segment").cast("long"), "_b": F.floor(F.col("_t") / RUN_TURNS)})
    before = bucket_offsets(seen, ["_c", "view"], "_b", {"_before": F.sum("_n")})
    run = Window.partitionBy("_c", "view", "_b").orderBy("_t", "speaker", "text")
    upto = F.col("_before") + F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0))
    placed = seen.join(before, ["_c", "view", "_b"]).withColumn("end", upto)
    return placed.select("conv", "view", "turn", "role", "name", "segment", "mask",
                         (F.col("end") - F.col("_n")).alias("start"), "end")


def rendered(views: DataFrame) -> DataFrame:
    """(conv, view, text, masked): whole texts and the (start, end) spans to train on, for dialogues
    that fit one row."""
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "mask", "segment")))
    return views.groupBy("conv", "view").agg(parts.alias("p")).select(
        "conv", "view", F.array_join("p.segment", "").alias("text"),
        F.expr("transform(filter(p, x -> x.mask = 1), x -> struct(x.start, x.end))").alias("masked"))
