"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
all others as named users; system turns are the setting, not a participant. Loss masks are character ranges of the
rendered text: exactly the contents and end marks of the speaker's own turns.

One row per (conversation, speaker, part). A part holds up to ``part_turns`` consecutive turns, so a conversation of any
length is never gathered in one task; parts continue each other and ``offset`` is where a part begins in the
whole dialogue. Ordering: turn, then role, then text; a null turn comes first. Repeated rows are repeated turns. A null
role is the participant ``unknown``; a null text is empty; rows with a null conversation belong to none and are left out.
A conversation of system turns only has no participant and no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.skew import running

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def perspectives(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system: str = "system",
    part_turns: int = 256,
) -> DataFrame:
    """conversation, speaker, part, offset, rendered, mask: array of (begin, end) within ``rendered``, n_turns, n_own."""
    base = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    # numbered in two levels; the bucket follows the order, so a long conversation is cut by its turns
    bucket = F.coalesce(F.floor(F.col("t") / part_turns).cast("long"), F.lit(-(1 << 62)))
    numbered = running(base, ["c"], bucket, [F.col("t").asc_nulls_first(), F.col("r"), F.col("x")], number="n")
    parts = numbered.withColumn("part", F.floor((F.col("n") - 1) / part_turns).cast("int"))
    gathered = parts.groupBy("c", "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "r", "x"))), lambda v: F.struct(v["r"].alias("r"), v["x"].alias("x"))).alias("v")
    )  # part_turns turns at most
    speakers = base.where(F.col("r") != system).select("c", F.col("r").alias("s")).distinct()
    shown = gathered.join(speakers, "c")

    def name(v):
        return F.when(v["r"] == system, F.lit(system)).when(v["r"] == F.col("s"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), v["r"]))

    heads = F.transform("v", lambda v: F.concat(F.lit(BEGIN), name(v), F.lit("\n")))
    shown = shown.withColumn("h", heads)
    pieces = F.zip_with("h", "v", lambda h, v: F.concat(h, v["x"], F.lit(END)))
    shown = shown.withColumn("p", pieces)
    # ends of the pieces: a running sum of their lengths
    ends = F.aggregate(
        "p", F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.char_length(p))),
    )
    shown = shown.withColumn("e", F.when(F.size("p") > 0, ends))
    spans = F.transform(
        "v",
        lambda v, i: F.struct(
            (F.get("e", i) - F.char_length(v["x"]) - len(END)).alias("begin"), (F.get("e", i) - 1).alias("end"), v["r"].alias("r")
        ),
    )
    own = F.filter(spans, lambda m: (m["r"] == F.col("s")) & (m["r"] != system))
    mask = F.transform(own, lambda m: F.struct(m["begin"], m["end"]))
    shown = shown.select(
        F.col("c").alias(conversation), F.col("s").alias("speaker"), "part", F.array_join("p", "").alias("rendered"), mask.alias("mask"), F.size("v").alias("n_turns")
    )
    before = Window.partitionBy(conversation, "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("rendered").cast("long")).over(before), F.lit(0))
    return shown.withColumn("offset", offset).withColumn("n_own", F.size("mask"))
