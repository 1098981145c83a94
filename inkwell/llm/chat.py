"""Multi-party dialogues, rendered once for every participant.

For each participant the dialogue is shown with that speaker as the assistant
and the others as named users; the mask marks what the assistant says, which is
what a model is to learn. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Speakers that set the scene and take no part.
SCENE = ("system",)
#: Turn numbers that one rendered segment spans, and rows that it holds, at most.
SEGMENT_TURNS, SEGMENT_ROWS = 256, 1024
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    """``text`` with a backslash put into all that looks like a marker's begin or
    end. A run of backslashes there grows by one, so it can be undone."""
    text = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(text, r"\|(\\*)>", r"|\\$1>")


def perspectives(turns: DataFrame, segment_turns: int = SEGMENT_TURNS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Every dialogue of ``turns(conv_id, turn, role, text)`` from the view of
    each of its participants.

    Returns rows of ``conv_id, assistant, segment, n_turns, text, mask, part``; the
    rendering of a dialogue for a participant is the concatenation of its texts
    in the order of segment and part. A turn is shown as ``<|role|>``
    (``system``, ``assistant``, or ``user name=NAME``), a line feed, its text,
    ``<|end|>`` and a line feed; in names and texts markers are ``escaped``.
    ``mask`` is the array of ``struct(start, stop)``, in characters of ``text``,
    of the assistant's texts with their end marks. Participants are all roles
    but ``system``.

    So that no row or task holds a whole long conversation, its rendering is cut
    between turns: at multiples of ``segment_turns`` turn numbers, counted from
    its first turn, and a segment of more than ``segment_rows`` rows (one turn
    number may have any number of rows) into parts of that many. Nothing is left
    out and the concatenation has every turn. Order is by turn, then role, then
    text, in parts as in whole segments. Repeated rows are turns each. A null role is the participant ``unknown``, a null text is empty,
    a null turn counts as number 0; rows with a null conv_id form one
    conversation. A conversation with a system turn only
    gives no row; neither does an empty table; other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    begins = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("turn").alias("_first"))
    casts = rows.filter(~F.col("role").isin(*SCENE)).select(F.col("conv_id").alias("_c"), F.col("role").alias("assistant")).distinct()
    segment = F.expr(f"(turn - _first) div {int(segment_turns)}")
    placed = rows.join(begins, rows.conv_id.eqNullSafe(begins._c)).withColumn("segment", segment).select("conv_id", "segment", "turn", "role", "text")
    segments = _gathered(placed.withColumns({"part": F.lit(0).cast("long"), "times": F.lit(1)}))
    sizes = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    sizes = sizes.join(begins, sizes.conv_id.eqNullSafe(begins._c)).groupBy("conv_id", segment.alias("segment"))
    large = checkpointed(sizes.agg(F.sum("n").alias("n")).filter(F.col("n") > segment_rows).select(F.col("conv_id").alias("_l"), F.col("segment").alias("_s")))
    if not large.isEmpty():
        here = placed.conv_id.eqNullSafe(large._l) & (placed.segment == large._s)
        few = placed.join(large, here, "left_anti").withColumns({"part": F.lit(0).cast("long"), "times": F.lit(1)})
        segments = _gathered(few.unionByName(_parts(placed.join(large, here, "left_semi"), segment_rows)))
    # Participants meet whole segments, not turns.
    one = segments.join(casts, segments.conv_id.eqNullSafe(casts._c)).select("conv_id", "segment", F.col("part").cast("int").alias("part"), "turns", "assistant")
    role = "case when t.role = assistant then 'assistant' when t.role in ({}) then t.role else concat('user name=', t.name) end".format(
        ", ".join(f"'{x}'" for x in SCENE)
    )
    shown = one.withColumn(
        "_parts",
        F.expr(f"transform(turns, t -> struct(concat('<|', {role}, '|>\\n') as head, concat(t.text, '<|end|>\\n') as body, t.role = assistant as own))"),
    )
    mask = """aggregate(_parts, struct(cast(array() as array<struct<start:int,stop:int>>) as spans, 0 as at), (a, p) -> struct(
        if(p.own, concat(a.spans, array(struct(a.at + length(p.head) as start, a.at + length(p.head) + length(p.body) as stop))), a.spans) as spans,
        a.at + length(p.head) + length(p.body) as at), a -> a.spans)"""
    return shown.select(
        "conv_id",
        "assistant",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(_parts, p -> concat(p.head, p.body)), '')").alias("text"),
        F.expr(mask).alias("mask"),
        "part",
    )


def _gathered(rows: DataFrame) -> DataFrame:
    """One row per conversation, segment and part, its turns in order."""
    turn = F.struct("turn", "role", F.col("text").alias("plain"), escaped(F.col("text")).alias("text"), escaped(F.col("role")).alias("name"), "times")
    found = rows.groupBy("conv_id", "segment", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return found.withColumn("turns", F.expr("flatten(transform(turns, t -> array_repeat(t, t.times)))"))


def _parts(rows: DataFrame, segment_rows: int) -> DataFrame:
    """``rows`` of large segments with the part that each belongs to: the number of
    rows before it in the segment's order, divided by ``segment_rows``. Equal rows
    are counted first, and go to as many parts as they fill; the rows before come
    from sums over ranges of the order (cut by the texts' first characters), so
    no segment is worked on as one."""
    counted = rows.groupBy("conv_id", "segment", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("_k", F.struct("conv_id", "segment"))
    dealt = checkpointed(counted.repartitionByRange("_k", "turn", "role", F.left("text", F.lit(64))).withColumn("_r", F.spark_partition_id()))
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_k", "_r").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_k", "_r").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(ranges, ["_k", "_r"]).withColumn("_stop", F.col("_before") + F.sum("n").over(inside)).withColumn("_start", F.col("_stop") - F.col("n"))
    size = int(segment_rows)
    found = placed.withColumn("part", F.explode(F.expr(f"sequence(_start div {size}, (_stop - 1) div {size})")))
    times = F.least("_stop", (F.col("part") + 1) * size) - F.greatest("_start", F.col("part") * size)
    return found.select("conv_id", "segment", "turn", "role", "text", "part", times.cast("int").alias("times"))
