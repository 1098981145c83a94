"""FIL10, WIN17, WIN3, SNK3, SNK8: collecting content items as a stream of answers,
with the count, the attempts and the empty streak of each category as state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ITEMS = "category string, content_id string, place long, item string"
STATE = "kept long, attempts long, empty int"


def advanced(state: tuple[int, int, int], answers: Iterable[list[str]], wanted: int, most_attempts: int, most_empty: int) -> tuple[tuple[int, int, int], list[str]]:
    """State and new items after further answers. A category is over once it has
    what is wanted, has asked as often as it may, or that many answers in a row
    were empty; what comes later is not looked at."""
    (kept, attempts, empty), new = state, []
    for items in answers:
        if kept >= wanted or attempts >= most_attempts or empty >= most_empty:
            break
        taken = list(items)[: wanted - kept]
        kept, attempts, empty, new = kept + len(taken), attempts + 1, 0 if len(items) else empty + 1, new + taken
    return (kept, attempts, empty), new


def collected(answers: DataFrame, wanted: int, max_retries: int = 10, most_empty: int = 3) -> DataFrame:
    """``category, content_id, place, item`` from a stream ``answers(category,
    ordinal, items array<string>)``: up to ``wanted`` items of each category,
    numbered ``{category}_{n:04d}`` from 0, from at most ``wanted * max_retries``
    answers. Answers of one trigger are taken by ordinal; null items are an
    empty answer; a null category is one of its own, named so."""
    filled = answers.selectExpr("coalesce(category, 'null') AS category", "ordinal", "coalesce(items, array()) AS items")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = tuple(state.get) if state.exists else (0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("ordinal", kind="stable")
        after, new = advanced(before, rows["items"], wanted, wanted * max_retries, most_empty)
        state.update(after)
        at = range(before[0], after[0])
        yield pd.DataFrame({"category": key[0], "content_id": [f"{key[0]}_{n:04d}" for n in at], "place": list(at), "item": new}).astype({"place": "int64"})

    return filled.groupBy("category").applyInPandasWithState(step, ITEMS, STATE, "append", GroupStateTimeout.NoTimeout)


def save(items: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each trigger's items to a folder named by its number, over what an
    attempt that failed has left there: a restart from ``checkpoint`` neither
    loses nor repeats an item."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/trigger={batch}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
