"""How quality filters overlap: what each removes at every place of every order.

Exact repeats are found by sorting: rows are range-sorted by a fingerprint of
the text, the text and the id, each row is compared with its predecessor, and
the few runs of equal texts that may cross a border between two ranges are
settled from a small table. Every document then is a mask of the filters that
it fails, and masks are counted by part; all orders follow from those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, prepare

#: Filters whose orders are all listed, at most (720 orders).
MOST_FILTERS = 6


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions of a text, by letter: A, under 200 words; B, fewer
    than half of the words distinct; C, over 2 % of its characters ``[A-Z]``;
    D, holds any of ``#$%&*|``. Words are maximal runs of what is no ASCII white
    space and differ by case."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text", then: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, keep, then, repeat`` of every row of ``docs``: whether its text
    is that of a row with a smaller id.

    Rows with equal id and text don't repeat each other; a null text is empty; a
    row with a null id repeats nothing and is repeated by nothing. ``then`` are
    columns computed from ``text`` once the rows are sorted, so that sampling for
    the ranges doesn't compute them. A hot text is spread over as many ranges as
    its rows fill, as the id is part of the order. Ranges are cut by fingerprint
    and id, so no text gets to the driver; different texts of one fingerprint
    are told apart by the text itself.
    """
    prepare(docs.sparkSession)
    then = then or {}
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("_print", F.xxhash64("text"))
    last = F.col("_id").asc_nulls_last()
    rows = rows.repartitionByRange(F.col("_print"), last).sortWithinPartitions(F.col("_print"), F.col("text"), last)
    carried = [f"_{i}" for i in range(len(keep))] + [f"_t{i}" for i in range(len(then))]
    rows = rows.select("_id", "_print", "text", *carried[: len(keep)], *[c.alias(n) for n, c in zip(carried[len(keep) :], then.values(), strict=True)])
    types = dict(rows.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        lead, print_, text, first, run, ending = None, None, None, None, place, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, prints, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            known, own = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            same = np.zeros(n, bool)
            same[0] = print_ == prints[0] and texts[0].as_py() == text
            same[1:] = (prints[1:] == prints[:-1]) & pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            lead = prints[0] if lead is None else lead
            # Row in which each row's run begins; -1 is the run left open by the last batch.
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            has_first = np.where(begin < 0, first is not None, known[begin])
            least = np.where(begin < 0, first if first is not None else 0, own[begin])
            runs = run + np.cumsum(~same)
            repeat = known & has_first & (own > least)
            unsettled = known & ~repeat & (prints == lead)
            yield pa.RecordBatch.from_arrays(
                [ids, *batch.columns[3:], pa.array(repeat), pa.array(runs, mask=~unsettled), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names
            )
            # Runs of the fingerprint that the range begins or ends with may go on beyond it.
            for i in np.flatnonzero(~same & known & ((prints == prints[-1]) | (prints == lead))):
                ending[int(runs[i])] = (int(prints[i]), texts[i].as_py(), int(own[i]))
            ending = {k: v for k, v in ending.items() if v[0] in (lead, prints[-1])}
            if begin[n - 1] >= 0:
                first = int(own[begin[n - 1]]) if known[begin[n - 1]] else None
            print_, text, run = prints[-1], texts[n - 1].as_py(), int(runs[-1])
        if ending:
            m = len(ending)
            print_, text, first = zip(*ending.values(), strict=True)
            empty = [pa.nulls(m, schema_of[c]) for c in ("_id", *carried)]
            yield pa.RecordBatch.from_arrays([*empty, pa.nulls(m, pa.bool_()), pa.array(list(ending), pa.int64()), pa.array(print_, pa.int64()), pa.array(text, pa.string()), pa.array(first, pa.int64())], names)

    names = ["_id", *carried, "_repeat", "_run", "_print", "_text", "_first"]
    schema_of = {f.name: f.type for f in to_arrow_schema(rows.select("_id", *carried).schema)}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("_id", *carried)) + ", _repeat boolean, _run long, _print long, _text string, _first long"
    found = checkpointed(rows.mapInArrow(compare, schema))
    borders = found.filter("_text IS NOT NULL").select("_run", "_print", "_text", "_first")
    least = borders.groupBy("_print", "_text").agg(F.min("_first").alias("_least"))
    settled = borders.join(least, ["_print", "_text"]).select("_run", "_least")
    plain = found.filter("_text IS NULL").select("_id", *carried, "_repeat", "_run")
    late = plain.filter("_run IS NOT NULL").join(settled, "_run").withColumn("_repeat", F.col("_id") > F.col("_least"))
    whole = plain.filter("_run IS NULL").drop("_run").unionByName(late.drop("_run", "_least"))
    return whole.select(F.col("_id").alias("doc_id"), *[F.col(c).alias(n) for c, n in zip(carried, [*keep, *then], strict=True)], F.col("_repeat").alias("repeat"))


def failures(docs: DataFrame, rules: dict[str, Column], part: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs``: a bit for every rule that
    its text fails, the first rule's lowest, and the highest where a smaller id has
    the same text. Rules are conditions on a column ``text`` without
    nulls; a rule that comes out null is not failed; a null part is empty."""
    bits = [F.coalesce(rule, F.lit(False)).cast("int") * (1 << i) for i, rule in enumerate(rules.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    found = repeats(rows, "part", then={"mask": mask})
    return found.select("doc_id", "part", (F.col("mask") + F.col("repeat").cast("int") * (1 << len(rules))).alias("mask"))


def interactions(masks: DataFrame, labels: DataFrame, letters: str) -> DataFrame:
    """The audit of ``masks(doc_id, part, mask)``, bit i of a mask being the
    failure of filter ``letters[i]``.

    Returns a row per part, order of the filters (``filter_order``) and step: the
    documents of the part ``kept`` after it, ``removed`` by its filter,
    ``redundant`` (failing it, removed before), ``unique_fails`` (failing it
    only), ``good_lost`` and ``toxic_lost`` (removed here with a label quality or
    toxic of 1) and ``shapley`` (removed by its filter, summed over all orders).

    Rows are documents, repeated ones too. A document has a label if any row of
    ``labels`` with its id says so; null ids have none. Equal rows are counted
    before they meet their labels and masks before parts, so neither a hot id nor
    a hot part is gathered; an empty table gives no row.
    """
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders to list")
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(flags, rows.doc_id == flags._id, "left")
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    # At most 2 ** len(letters) cells a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bit = lambda x: F.expr(f"shiftleft(1, instr('{letters}', {x}) - 1)")
    steps = steps.withColumn("_own", bit("substring(filter_order, step, 1)"))
    steps = steps.withColumn("_before", F.expr(f"aggregate(filter(split(substring(filter_order, 1, step - 1), ''), x -> x <> ''), 0, (a, x) -> a | shiftleft(1, instr('{letters}', x) - 1))"))
    zero = F.lit(0).cast("long")
    total = lambda count, when: F.aggregate("cells", zero, lambda a, c: a + F.when(when(c["mask"]), count(c)).otherwise(zero))
    own, before = F.col("_own"), F.col("_before")
    fails = lambda m: m.bitwiseAND(own) != 0
    left = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & left(m)
    # A document that fails k filters falls to each of them in the same share of the orders.
    share = lambda c: c["n"] * (F.lit(factorial(len(letters))) / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("long")
    n = lambda c: c["n"]
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: left(m) & ~fails(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & ~left(m)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``interactions`` of the ``text_rules`` A to D and of E, a text that a
    smaller doc_id has too, by ``part``."""
    return interactions(failures(docs, text_rules(F.col("text")), part), labels, "ABCDE")
