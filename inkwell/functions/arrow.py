"""String functions that are folds over long arrays: Arrow batches, linear or
bit-parallel, for what higher-order functions would copy at every step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

SPANS = ArrayType(StructType().add("start", IntegerType()).add("stop", IntegerType()))


def edit_distance(a: list, b: list) -> int:
    """Of two sequences, all cells of a column of the usual table at once."""
    if not len(a) or not len(b):
        return len(a) or len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        same = masks.get(x, 0)
        flat = same | down
        mixed = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(mixed | up) & full, up & mixed
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(flat | plus) & full, plus & flat
    return score


def rows_of(*columns: pa.Array) -> Iterator[tuple]:
    """Row by row, so that no more than one row's items are Python objects."""
    return zip(*((x.as_py() for x in c) for c in columns), strict=True)


@F.arrow_udf(IntegerType())
def token_distance(h: pa.Array, r: pa.Array) -> pa.Array:
    """Edit distance of two arrays of words; null where either is null."""
    return pa.array((None if x is None or y is None else edit_distance(x, y) for x, y in rows_of(h, r)), pa.int32())


@F.arrow_udf(IntegerType())
def char_distance(h: pa.Array, r: pa.Array) -> pa.Array:
    """Edit distance of two strings by characters; null where either is null. A
    whole column of cells is one step, so long texts cost a tenth of what cell by
    cell does."""
    return pa.array((None if x is None or y is None else edit_distance(x, y) for x, y in rows_of(h, r)), pa.int32())


@F.arrow_udf(ArrayType(IntegerType()))
def running_offsets(lengths: pa.Array) -> pa.Array:
    """WIN5: where each item of an array of lengths begins if one place lies
    between neighbours; null stays null. Higher-order functions would copy the
    array for every item."""
    counts = pc.fill_null(lengths.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = pc.fill_null(lengths.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, stops = np.cumsum(step), np.cumsum(counts)
    before = np.concatenate([[0], ends])
    starts = before[:-1] - np.repeat(before[stops - counts], counts)
    offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32), mask=np.append(~lengths.is_valid().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32)))


def spans_of(words: list[str], s: str) -> list[tuple[int, int]] | None:
    at, out = 0, []
    for w in words:
        begin = s.find(w, at)
        if begin < 0:
            return None
        at = begin + len(w)
        out.append((begin, at))
    return out


def span_lists(found: Iterator[list[tuple[int, int]] | None]) -> pa.Array:
    """Lists of ``SPANS``, null for None, as numbers row by row."""
    counts, parts, null = [0], [np.empty((0, 2), np.int32)], []
    for spans in found:
        null.append(spans is None)
        parts.append(np.array(spans or [], np.int32).reshape(-1, 2))
        counts.append(len(parts[-1]))
    start, stop = np.concatenate(parts).T
    offsets = pa.array(np.cumsum(counts).astype(np.int32), mask=np.append(null, False).astype(bool))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "stop"]))


@F.arrow_udf(SPANS)
def forward_spans(words: pa.Array, s: pa.Array) -> pa.Array:
    """WIN13: where each word lies in the string, each searched for from the end
    of the one before; null if one is not found."""
    return span_lists(None if x is None or y is None else spans_of(x, y) for x, y in rows_of(words, s))


def proportional(n: int, tokens: int) -> list[tuple[int, int]]:
    """WIN14: so many spans in even shares of the tokens, none empty."""
    return [(i * tokens // n, max(i * tokens // n + 1, (i + 1) * tokens // n)) for i in range(n)]


def aligned(words: list[str], text: str, starts: np.ndarray, stops: np.ndarray, n: int) -> list[tuple[int, int]]:
    found = spans_of(words[:n], text)
    if found is None or len(found) < n:
        return proportional(n, len(starts))
    if not found:
        return []
    begin, end = np.array(found).T
    low, high = np.searchsorted(stops, begin, "right"), np.searchsorted(starts, end, "left")
    return [(int(a), int(b)) if b > a else (0, 1) for a, b in zip(low, high, strict=True)]


@F.arrow_udf(SPANS)
def aligned_spans(words: pa.Array, text: pa.Array, starts: pa.Array, stops: pa.Array, n: pa.Array) -> pa.Array:
    """STR29, WIN13, JN8, WIN14: the tokens, ``[start, stop)``, of each of ``n``
    words. Words beyond ``n`` are cut off; each word is searched for from the end
    of the one before, and takes the tokens whose characters it shares (the first
    token, if there is none). Where there are fewer words than ``n`` or one isn't
    found, the tokens are shared out evenly. ``starts`` and ``stops`` are the
    tokens' characters in order; anything null gives null."""
    return span_lists(None if None in (w, t, a, b, k) else aligned(w, t, np.array(a, np.int64), np.array(b, np.int64), k) for w, t, a, b, k in rows_of(words, text, starts, stops, n))


def lines_of(words: list[str], width: int) -> list[str]:
    lines: list[list[str]] = []
    room = -1
    for w in words:
        for piece in [w[i : i + width] for i in range(0, len(w), width)] or [w]:
            if room >= len(piece) + 1:
                lines[-1].append(piece)
                room -= len(piece) + 1
            else:
                lines.append([piece])
                room = width - len(piece)
    return [" ".join(x) for x in lines]


def wrapped(words, width: int):
    """STR20: lines of at most ``width`` characters, filled greedily; a longer
    word stands alone, cut into pieces of that width."""

    @F.arrow_udf(ArrayType(StringType()))
    def fill(words: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        found = [pa.array([None if x is None else lines_of(x, width)], kind) for (x,) in rows_of(words)]
        return pa.concat_arrays(found) if found else pa.array([], kind)

    return fill(words)
