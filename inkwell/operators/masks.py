"""CMP3, CMP4: the masked passes of a picture, planned as tables: which words are
hidden together, what each pass hides, and whose score it gives. Keys name a
picture; ``index`` orders its words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from . import boxes as B
from .lineage import checkpointed


def conflicts(boxes: DataFrame, image: str, index: str, radius: int | None) -> DataFrame:
    """WIN15, WIN16: ``image, index, other``: the words with a smaller index that a
    word must not share a pass with, as their boxes overlap or, with a radius,
    their centres lie within it; each pair once."""
    rows = boxes.select(image, index, "x0", "y0", "x1", "y1")
    pair = [F.col(f"a.{image}"), F.col(f"a.{index}"), F.col(f"b.{index}").alias("other")]
    later = F.col(f"a.{index}") > F.col(f"b.{index}")
    found = B.overlapping_boxes(rows, [image]).filter(later).select(*pair)
    if radius is None:
        return found
    return found.unionByName(B.near_pairs(rows, image, radius).filter(later).select(*pair)).distinct()


def first_fit(words: DataFrame, pairs: DataFrame, image: str, index: str, strip: Column) -> DataFrame:
    """WIN15, WIN16: ``image, index, group_id``: in the order of ``index`` each word
    takes the first group that none of its ``pairs(image, index, other)`` is in.

    A group depends on those of earlier words, so a picture is worked on strip by
    strip: ``strip``, a whole number from 0 that must not fall along the index,
    cuts it into pieces that a task can hold, and the strips of one number, of
    all pictures, are one round. What earlier strips have taken comes from a
    join. A picture of one strip takes one round. Words without pairs go to group 0; an index must not repeat
    within a picture."""
    kinds = dict(words.dtypes)
    words = words.select(image, index, strip.cast("int").alias("_strip"))
    place = words.withColumnsRenamed({index: "other", "_strip": "_there"})
    links = pairs.join(words, [image, index]).join(place, [image, "other"])
    own = links.filter("_strip = _there").groupBy(image, index).agg(F.collect_set("other").alias("_own"))
    rounds = checkpointed(words.join(own, [image, index], "left"))
    across = checkpointed(links.filter("_strip > _there").select(image, index, "other", "_strip"))

    def assign(table: pa.Table) -> pa.Table:
        order = table.column(index).to_pylist()
        group: dict = {}
        for i, own, taken in sorted(zip(order, table.column("_own").to_pylist(), table.column("_taken").to_pylist(), strict=True), key=lambda r: r[0]):
            used = {group[j] for j in own or ()}.union(taken or ())
            g = 0
            while g in used:
                g += 1
            group[i] = g
        return pa.table([table.column(image), table.column(index), pa.array([group[i] for i in order], pa.int32())], names=[image, index, "group_id"])

    schema = f"`{image}` {kinds[image]}, `{index}` {kinds[index]}, group_id int"
    last, done = rounds.agg(F.max("_strip")).first()[0], None
    for r in range(0 if last is None else last + 1):
        now = rounds.filter(F.col("_strip") == r)
        if done is None:
            now = now.withColumn("_taken", F.lit(None).cast("array<int>"))
        else:
            known = across.filter(F.col("_strip") == r).join(done.withColumnRenamed(index, "other"), [image, "other"])
            now = now.join(known.groupBy(image, index).agg(F.collect_set("group_id").alias("_taken")), [image, index], "left")
        found = now.groupBy(image, "_strip").applyInArrow(assign, schema)
        done = found if done is None else done.unionByName(found)
        if r < last:
            done = checkpointed(done)
    return words.sparkSession.createDataFrame([], schema) if done is None else done


def hidden(boxes: DataFrame, groups: DataFrame, image: str, index: str, radius: int) -> DataFrame:
    """GEO5, SET5: ``image, group_id, index``: the words that each pass hides: those
    of its group and all whose centres lie within ``radius`` of one of them."""
    rows = boxes.select(image, index, "x0", "y0", "x1", "y1")
    context = B.near_pairs(rows, image, radius).select(F.col(f"a.{image}"), F.col(f"a.{index}").alias("_of"), F.col(f"b.{index}"))
    own = groups.withColumnRenamed(index, "_of")
    return context.join(own, [image, "_of"]).select(image, "group_id", index).distinct()


def scattered(groups: DataFrame, passes: DataFrame, image: str, index: str) -> DataFrame:
    """Masked scores of words: of ``passes(image, group_id, index, ...)``, which a
    model gives for all words of a picture in each pass, those of a word in the
    pass of its own group. A word that the model gives no score in that pass has
    no row."""
    return passes.join(groups, [image, index, "group_id"])


def scattered_arrays(groups: str, passes: Column) -> Column:
    """The same of a picture in one row: of ``passes``, by group the scores of all
    words, each word's in the pass of its own group."""
    return S.bound(passes, lambda p: F.transform(groups, lambda g, at: F.get(F.get(p, g), at)))
