"""Repeated passages by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepare, text_slices

#: A cut where the top CUT_BITS of the rolling hash are zero: 2**CUT_BITS bytes
#: on average. The hash spans the last 32 bytes, so cuts depend on nothing else.
CUT_BITS = 5
LEAST, MOST = 8, 4096
#: Where no cut falls for so many bytes (a run of one word may have none at all),
#: fewer bits are enough for one, by and by.
GAP, FEWER_BITS = 160, (3, 1)
#: Words of a run of repeated chunks that make a passage.
PASSAGE_WORDS = 20
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR[b] << age over the last 32 bytes,
    by doubling the span five times."""
    h = GEAR[data]
    for k in range(5):
        age = 1 << k
        shifted = np.zeros_like(h)
        shifted[age:] = h[:-age] << np.uint32(age)
        h = h + shifted
    return h


def compact(data: bytes) -> tuple[bytes, np.ndarray]:
    """``data`` with every run of ASCII white space as one blank, and where each
    of its bytes, and its end, lies in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    kept = np.flatnonzero(~(blank[1:] & blank[:-1]))
    kept = np.r_[0, kept + 1] if len(raw) else kept
    return np.where(blank, np.uint8(32), raw)[kept].tobytes(), np.r_[kept, len(raw)]


def _places(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Ends of the bytes where a cut may fall."""
    found = np.flatnonzero((h >> np.uint32(32 - CUT_BITS) == 0) & whole) + 1
    for bits in FEWER_BITS:
        edges = np.r_[0, found, len(h)]
        wide = np.flatnonzero(np.diff(edges) > GAP)
        if not len(wide):
            break
        more = [np.flatnonzero((h[a:b] >> np.uint32(32 - bits) == 0) & whole[a:b]) + a + 1 for a, b in zip(edges[wide], edges[wide + 1], strict=True)]
        found = np.union1d(found, np.concatenate(more))
    return found


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last at its end. A cut falls before
    the first byte of a character, at least LEAST and at most MOST bytes (and
    what completes a character) after the last one."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    whole = np.r_[(raw[1:] & 0xC0) != 0x80, True]
    out, last = [], 0
    for end in [*_places(gear(raw), whole).tolist(), n]:
        while end - last > MOST:
            last += MOST
            while not whole[last - 1]:
                last += 1
            out.append(last)
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, start, stop, words, digest`` of every chunk of every
    text: the text's hash, byte offsets into its UTF-8, words that begin in it,
    128-bit digest."""
    return _packed(docs, id_col, text_col).select("doc_id", "text_key", "start", *_extent(), "digest")


def _extent() -> tuple[Column, Column]:
    """A chunk's stop and words from its start and extent."""
    return (F.col("start") + F.shiftrightunsigned("extent", 13)).alias("stop"), F.col("extent").bitwiseAND(8191).cast("int").alias("words")


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, start, extent, digest``, which is what is shuffled:
    the extent is the length in bytes (white space makes it any) times 8192 and
    the words (which a chunk of MOST bytes has fewer of)."""
    prepare(docs.sparkSession)
    schema = "doc_id long, text_key long, start long, extent long, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for done, part in text_slices(batch.column(2)):
                own, starts, stops, words, digests = [], [], [], [], []
                for i, text in enumerate(part):
                    data, at = compact(text.encode())
                    ends = cuts(data)
                    if not ends:
                        continue
                    begins = [0, *ends[:-1]]
                    own += [done + i] * len(ends)
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins, ends, strict=True)]
                    real = at[ends].tolist()
                    starts += [0, *real[:-1]]
                    stops += real
                    blank = np.frombuffer(data, np.uint8) == 32
                    words += np.add.reduceat(~blank & np.r_[True, blank[:-1]], begins, dtype=np.int32).tolist()
                take = pa.array(own, pa.int32())
                start = np.array(starts, np.int64)
                extent = (np.array(stops, np.int64) - start) * 8192 + np.array(words, np.int64)
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(extent), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "start", "extent", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, least_words: int = PASSAGE_WORDS, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that occur in more than one document.

    Texts are cut by content, white space counting as single blanks; chunks with
    equal digests are the same chunk, and
    a run of neighbouring chunks that occur elsewhere too counts if
    ``least_words`` words begin in it; it is broken into passages where chunks
    that occur before meet chunks that occur here first. With ``within``, what one
    document repeats counts too. Returns ``doc_id, start, stop, n_words,
    n_chunks, first_doc_id, removed`` per passage: byte offsets into the UTF-8
    text, the smallest doc_id that holds one of its chunks, and whether the
    dedup removes it (every chunk occurs before, in an earlier document or
    earlier in this one), so that the first occurrence of every chunk stays; and
    ``text_key``, by which the texts of one doc_id are told apart.

    Repeated rows with one doc_id are one document read twice, and rows of one
    doc_id with different texts are parts of one document: neither repeats
    anything. Rows with a null id, null and empty texts have no passage. Digests
    are pre-aggregated before the shuffle, and the join back to the chunks is
    one that AQE splits where a chunk is very frequent; no group is gathered.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    chunks = _packed(rows, "doc_id", "text")
    # Across documents the ids alone say what is shared and who has it first.
    place = F.struct("doc_id", "start") if within else F.col("doc_id")
    many = checkpointed(chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last"))
    first = F.col("first.doc_id") if within else F.col("first")
    shared = chunks.join(many, "digest").select("doc_id", "text_key", "start", *_extent(), first.alias("first_doc_id"), (F.col("first") == place).alias("new"))
    w = Window.partitionBy("doc_id", "text_key").orderBy("start", "stop")
    runs = shared.distinct().withColumn("gap", F.coalesce((F.lag("stop").over(w) < F.col("start")).cast("int"), F.lit(1)))
    turn = F.greatest("gap", (F.lag("new").over(w) != F.col("new")).cast("int"))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.sum("gap").over(up_to)).withColumn("turn", turn).withColumn("part", F.sum("turn").over(up_to))
    parts = runs.groupBy("doc_id", "text_key", "run", "part").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("n_words"),
        F.count("*").alias("n_chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
        (~F.first("new")).alias("removed"),
    )
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "text_key", "run"))
    return parts.withColumn("_words", words).filter(F.col("_words") >= least_words).drop("run", "part", "_words")


def without_repeats(docs: DataFrame, least_words: int = PASSAGE_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cleared of the passages that the dedup removes;
    other columns and rows stay, whatever their names. Each text is cut by its
    own passages, from its UTF-8 bytes, by built-in functions."""
    spans = (
        repeated_passages(docs, least_words, text_col=text_col)
        .filter("removed")
        .groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
        .select(F.struct("i", "k").alias("own"), "s")
    )
    kept = F.expr(
        """array_join(transform(sequence(0, size(s)), n -> decode(substring(b,
             cast(if(n = 0, 0, s[greatest(n - 1, 0)].stop) as int) + 1,
             cast(if(n = size(s), length(b), s[least(n, size(s) - 1)].start) - if(n = 0, 0, s[greatest(n - 1, 0)].stop) as int)), 'UTF-8')), '')"""
    )
    text = F.col(f"d.`{text_col}`")
    whole = docs.select(F.struct("*").alias("d"))
    joined = whole.join(spans, (F.col("d.doc_id").cast("long") == F.col("own.i")) & (F.xxhash64(text) == F.col("own.k")), "left")
    cut = joined.withColumn("b", F.encode(text, "UTF-8")).withColumn("t", F.when(F.col("s").isNull(), text).otherwise(kept))
    return cut.select(*[F.col("t").alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns])
