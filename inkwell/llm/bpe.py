"""Byte-level BPE with a segment tree over pair ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices

#: Pieces longer than this, or too few of one size, are merged one at a time.
LOCKSTEP_SIZE = 64
#: Encoded pieces that a worker remembers.
CACHE_PIECES = 300_000
NONE = np.int64(1 << 60)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes, blank, rank."""
    lines = map(bytes.split, Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


class Codec:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.base = len(self.tokens) + 1
        self.pairs = {
            ranks[t[:i]] * self.base + ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        if not len(self.pair_keys):
            return np.full(len(key), NONE)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece. ``tree`` keeps ``rank * size + position`` of the
        least pair, so the root is the leftmost pair of the least rank."""
        n = len(piece)
        size = 1 << max(n - 1, 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, base, pairs = int(NONE), self.base, self.pairs
        tree = [none] * (2 * size)

        def value(i: int) -> int:
            j = after[i]
            rank = pairs.get(ids[i] * base + ids[j]) if j < n else None
            return none if rank is None else rank * size + i

        def update(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                v = min(tree[i], tree[i ^ 1])
                i >>= 1
                if tree[i] == v:
                    break
                tree[i] = v

        for i in range(n):
            tree[size + i] = value(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (least := tree[1]) < none:
            p = least % size
            q = after[p]
            ids[p], r = least // size, after[q]
            after[p] = r
            if r < n:
                before[r] = p
            ids[q] = -1
            update(q, none)
            update(p, value(p))
            if before[p] >= 0:
                update(before[p], value(before[p]))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The same for pieces of at most ``size`` bytes (a power of two), all
        in step: each round merges every piece's least pair."""
        count, levels = len(pieces), size.bit_length() - 1
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        live = np.arange(size) < lengths[:, None]
        ids = np.full((count, size + 1), -1, np.int64)
        ids[:, :size] = np.where(live, self.byte_ids[raw], -1)
        after = np.minimum(np.arange(1, size + 1), lengths[:, None])
        after = np.concatenate([after, np.full((count, 1), size)], 1)
        after[np.arange(count), lengths - 1] = size
        before = np.tile(np.arange(-1, size), (count, 1))
        tree = np.full((count, 2 * size), NONE)
        x, y = np.nonzero(live[:, 1:])
        rank = self._ranks_of(ids[x, y], ids[x, y + 1])
        tree[x, size + y] = np.where(rank < NONE, rank * size + y, NONE)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        rows = np.arange(count)
        while len(rows := rows[tree[rows, 1] < NONE]):
            least = tree[rows, 1]
            p = least % size
            q = after[rows, p]
            r, o = after[rows, q], before[rows, p]
            ids[rows, p], ids[rows, q] = least // size, -1
            after[rows, p] = r
            before[rows, r] = p
            rank = np.where(r < size, self._ranks_of(ids[rows, p], ids[rows, r]), NONE)
            tree[rows, size + q] = NONE
            tree[rows, size + p] = np.where(rank < NONE, rank * size + p, NONE)
            has = o >= 0
            prev = np.where(has, o, p)
            rank = self._ranks_of(ids[rows[has], prev[has]], ids[rows[has], p[has]])
            tree[rows[has], size + prev[has]] = np.where(rank < NONE, rank * size + prev[has], NONE)
            nodes = [size + q, size + p, size + prev]
            for _ in range(levels):
                nodes = [i >> 1 for i in nodes]
                for i in nodes:
                    tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])
        ids = ids[:, :size]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of ``pieces`` (packed, little-endian) into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            else:
                groups.setdefault(1 << max(len(data) - 1, 1).bit_length(), []).append((piece, data))
        for size, found in groups.items():
            if size > LOCKSTEP_SIZE or len(found) < 16:
                for piece, data in found:
                    self.cache[piece] = np.array(self.merge_one(data), "<u4").tobytes()
                continue
            for i in range(0, len(found), 4096):
                part = found[i : i + 4096]
                self.cache.update(zip((p for p, _ in part), self.merge_many([d for _, d in part], size), strict=True))

    def _packed(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, pieces))

    def _by_words(self, parts: list[list[str]]) -> None:
        """Puts what lies between blanks, with the blank before it, into
        ``words``; None where white space touches an end, since that is split
        together with its neighbours."""
        words = self.words
        new = {p for x in parts for p in x[1:] if p not in words}
        split = {p: self.split(" " + p) if p and not p[0].isspace() and not p[-1].isspace() else None for p in new}
        self.learn({y for x in split.values() if x for y in x}.difference(self.cache))
        words.update((p, self._packed(x) if x else None) for p, x in split.items())

    def encode_batch(self, texts: list[str], blanks_lead: bool = False) -> list[bytes]:
        """Packed ids of every text. With ``blanks_lead`` a match holds a blank
        as its first character only, unless it is all white space; then words
        are looked up whole."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        out: list[bytes | None] = [None] * len(texts)
        if blanks_lead:
            parts = [t.split(" ") for t in texts]
            self._by_words(parts)
            get = self.words.__getitem__
            for i, x in enumerate(parts):
                found = list(map(get, x[1:]))
                first = x[0]
                if None not in found and not (first and first[-1].isspace()) and (first or len(x) == 1):
                    pieces = self.split(first)
                    self.learn(set(pieces).difference(self.cache))
                    out[i] = self._packed(pieces) + b"".join(found)
        rest = [i for i, x in enumerate(out) if x is None]
        pieces = [self.split(texts[i]) for i in rest]
        self.learn(set().union(*pieces).difference(self.cache))
        for i, x in zip(rest, pieces, strict=True):
            out[i] = self._packed(x)
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(source, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (source.id, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source.value, pattern)
    return _codecs[key]


class _Source:
    """A broadcast vocabulary with an id that workers can key on."""

    def __init__(self, spark, path: str):
        ranks = load_ranks(path)
        self.shared, self.id = spark.sparkContext.broadcast(ranks), f"{path}:{len(ranks)}:{hash(frozenset(ranks.items()))}"

    @property
    def value(self) -> dict[bytes, int]:
        return self.shared.value


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, blanks_lead: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids``, and the columns
    of ``docs`` that ``keep`` names.

    Each match of ``pattern`` is encoded by itself with the ranks in
    ``ranks_path`` (read on the driver and broadcast: a vocabulary has a fixed
    size); special tokens are ordinary text. ``ids`` is array<int>, or with
    ``packed`` binary of little-endian unsigned 32-bit integers. ``blanks_lead``
    states that the pattern lets a blank only begin a match (see
    ``Codec.encode_batch``); the ids are the same. A null text
    counts as empty and has no ids; repeated rows and null ids stay; other
    columns are not read.
    """
    prepare(docs.sparkSession)
    source = _Source(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source, pattern)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                part, ids = batch.slice(start, len(texts)), codec.encode_batch(texts, blanks_lead)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                column = pa.array(ids, pa.binary())
                if not packed:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4"))
                    column = pa.ListArray.from_arrays(offsets, flat)
                yield pa.RecordBatch.from_arrays([part.column(0), counts, column, *part.columns[2:]], ["doc_id", "n_tokens", "ids", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`") for c in keep])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}{kept}")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``tokens(doc_id, n_tokens, ids binary)`` with ``decoded``, the bytes that
    the packed ids stand for. Null ids decode to nothing."""
    source = _Source(tokens.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                decoded = pa.array([codec.decode(x.as_py() or b"") for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )
