"""Token ids of documents in Arrow files of equal-length sequences.

A data file is in Arrow's IPC file format: record batches of a fixed number of
sequences, each a row of two fixed-size lists, ``ids`` (unsigned, of 16 bits
where the vocabulary has no more, else of 32) and ``mask`` (bits: true for an
id, false for padding). As all but the last batch have the same
size, sequence i is row ``i % batch`` of batch ``i // batch``, and a memory map
of the file gives it without copying. Beside each data file lies one with the
documents' places in it. Documents follow one another without gaps, over the
borders of sequences; a file's last sequence is padded.

Files are written by tasks under names of their own, and count once they stand
in the manifest, a Parquet table in the same folder that Spark commits when all
tasks are done: what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: Ids of a sequence, sequences of a record batch.
LENGTH, BATCH = 2048, 128
#: Bytes of text that are cut into words at once; words whose ids a task remembers.
PIECE, KNOWN = 1 << 20, 1 << 19
#: ASCII symbols that no contraction begins with.
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))
MANIFEST = "part int, file string, n_ids long, n_docs long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Words(dict):
    """Ids of words, as packed little-endian integers, by a tokenizer that never
    looks across ASCII white space, such as one that drops it: each word is
    encoded by the library when it is first asked for. Once ``known`` words are
    there, only those asked for again stay.

    ``folds`` says that the tokenizer puts all to lower case and never merges a
    letter with a symbol: ASCII letters with symbols at their end are then two
    words. (Symbols but the apostrophe, which begins contractions; words that
    may hold a special token stay whole.)"""

    def __init__(self, path: str, folds: bool = False, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.library, self.folds, self.known, self.older = Tokenizer.from_file(path), folds, known, {}
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(SYMBOLS).lower() if self.folds and b"<|" not in word else word
            if core != word and core[-1:].isalpha():
                ids = self[core] + (self[word[len(core) :]] if len(word) > len(core) else b"")
            else:
                ids = self.pack(self.library.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) >= self.known:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text."""
        return b"".join([b"".join(map(self.__getitem__, part.split())) for part in pieces(text)])


@lru_cache(maxsize=2)
def words_of(path: str, folds: bool) -> Words:
    """The words that a worker knows, kept from task to task."""
    return Words(path, folds)


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about ``size`` bytes; a run
    without any is not cut."""
    at = 0
    while len(text) - at > size:
        blanks = [p for c in b" \n\t\r\v\f" if (p := text.rfind(bytes((c,)), at, at + size)) > at]
        if not blanks:
            blanks = [p for c in b" \n\t\r\v\f" if (p := text.find(bytes((c,)), at + size)) > 0]
            if not blanks:
                break
            blanks = [min(blanks)]
        yield text[at : max(blanks)]
        at = max(blanks)
    yield text[at:]


class Writer:
    """One data file and its index. Holds at most one batch of sequences."""

    def __init__(self, where: str, name: str, length: int, batch: int, kind: np.dtype, about: dict):
        if length % 8:
            raise ValueError("a sequence's mask has whole bytes")
        self.system, folder = fs.FileSystem.from_uri(where)
        self.length, self.batch, self.kind, self.n_ids, self.n_docs, self.held = length, batch, kind, 0, 0, bytearray()
        meta = {"inkwell": json.dumps({**about, "length": length, "batch": batch})}
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))], metadata=meta)
        self.system.create_dir(folder, recursive=True)
        self.files = [self.system.open_output_stream(f"{folder}/{name}{end}") for end in (".arrow", ".docs.arrow")]
        self.data, self.index = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, INDEX), strict=True))

    def write(self, doc_ids: pa.Array, ids: Iterator[bytes]) -> None:
        sizes, width = [], self.kind.itemsize
        full = self.length * self.batch * width
        for x in ids:
            sizes.append(len(x) // width)
            for at in range(0, len(x), full):
                self.held += x[at : at + full]
                if len(self.held) >= full:
                    self._flush(full)
        ends = self.n_ids + np.cumsum(sizes, dtype=np.int64)
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=INDEX))
        self.n_ids, self.n_docs = int(ends[-1]), self.n_docs + len(sizes)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.held[:size]), self.kind)
        del self.held[:size]
        rows = -(-len(ids) // self.length)
        mask = np.ones(len(ids), bool)
        if rows * self.length > len(ids):
            ids, mask = (np.concatenate([x, np.zeros(rows * self.length - len(x), x.dtype)]) for x in (ids, mask))
        self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        for x in (self.data, self.index, *self.files):
            x.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, length: int = LENGTH, batch: int = BATCH, folds: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the whole texts of ``docs`` by the tokenizer file ``tokenizer``
    (no special tokens added, ``end`` after each document) and writes them to
    ``folder``, which all executors share, in ascending order of ``id_col``.

    A null text is empty and has its end id only; null ids come first; rows of one
    id are ordered by a hash of the text and the text, and each is a document.
    Rows are dealt by ranges of id and hash, so no id is gathered, and each task
    streams its range into one file. ``folds`` is a property of the tokenizer, see
    ``Words``. An empty table gives an empty manifest.
    Strings of special tokens within texts become those tokens, as the library
    does by default.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    about = {"end": end, "tokenizer": tokenizer.rpartition("/")[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, words, part = None, None, TaskContext.get().partitionId()
        for rows in batches:
            if not rows.num_rows:
                continue
            if writer is None:
                words = words_of(tokenizer, folds)
                ending = words.pack([end])
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = Writer(folder, name, length, batch, np.dtype(f"<{words.code}"), about)
            writer.write(rows.column(0), (words.ids(t) + ending for t in _utf8(rows.column(1))))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([part], pa.int32()), [name], [writer.n_ids], [writer.n_docs]], names=["part", "file", "n_ids", "n_docs"])

    rows.mapInArrow(run, MANIFEST).write.mode("errorifexists").parquet(f"{folder}/_manifest")


def _utf8(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


@dataclass(frozen=True)
class Shard:
    """A committed file: its name and what lies before it."""

    file: str
    start: int
    first_sequence: int


def shards(spark: SparkSession, folder: str) -> list[Shard]:
    """The files of the manifest in order: a few words for each file."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").collect())
    if not rows:
        return []
    length = SequenceFile(folder, rows[0].file).length
    starts = accumulate((r.n_ids for r in rows), initial=0)
    sequences = accumulate((-(-r.n_ids // length) for r in rows), initial=0)
    return [Shard(r.file, s, q) for r, s, q in zip(rows, starts, sequences)]


class SequenceFile:
    """Random access to a data file. On a local or mounted folder the file is
    mapped into memory, and what is returned are views of the map."""

    def __init__(self, folder: str, name: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{name}"
        local = isinstance(self.system, fs.LocalFileSystem)
        self.open = pa.memory_map if local else self.system.open_input_file
        self.reader = pa.ipc.open_file(self.open(f"{self.path}.arrow"))
        about = json.loads(self.reader.schema.metadata[b"inkwell"])
        self.length, self.batch, self.end = about["length"], about["batch"], about["end"]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence."""
        found, at = self.reader.get_batch(i // self.batch), i % self.batch * self.length
        ids, mask = (found.column(k).flatten().slice(at, self.length) for k in (0, 1))
        return ids.to_numpy(), mask

    def documents(self) -> Iterator[pa.RecordBatch]:
        """``doc_id, start, n_tokens``, places counted within the file."""
        index = pa.ipc.open_file(self.open(f"{self.path}.docs.arrow"))
        for i in range(index.num_record_batches):
            yield index.get_batch(i)

    def parts(self) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
        """Batches of ``documents``, with the ids of each document as views of
        the batches that hold them."""
        size, at, ids = self.length * self.batch, -1, None
        for docs in self.documents():
            out = []
            for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                views = []
                for b in range(start // size, (start + n - 1) // size + 1 if n else 0):
                    if b != at:
                        at, ids = b, self.reader.get_batch(b).column(0).flatten().to_numpy()
                    views.append(ids[max(start - b * size, 0) : start + n - b * size])
                out.append(views)
            yield docs, out


def read(spark: SparkSession, folder: str, schema: str, per_document: Callable[[list[np.ndarray]], tuple]) -> DataFrame:
    """``doc_id, start, n_tokens`` of all documents in the files of ``folder``,
    ``start`` counting all ids of the folder, and the columns ``schema`` that
    ``per_document`` computes from a document's ids, given as views of the
    files. A task reads one file at a time, a batch in memory at a time."""
    files = shards(spark, folder)
    names = ["doc_id", "start", "n_tokens", *(c.split()[0] for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for rows in batches for i in rows.column(0).to_pylist()):
            for docs, ids in SequenceFile(folder, files[i].file).parts():
                own = [pa.array(x) for x in zip(*map(per_document, ids), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column(0), pc.add(docs.column(1), files[i].start), docs.column(2), *own], names)

    places = spark.range(0, len(files), 1, max(len(files), 1))
    return places.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def crc32(ids: list[np.ndarray]) -> tuple[int]:
    """Unsigned CRC-32 of ids as little-endian 32-bit integers."""
    crc = 0
    for x in ids:
        crc = zlib.crc32(x.astype("<u4", copy=False), crc)
    return (crc,)


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """``sequence, ids, mask``: every equal-length sequence with its number in
    the folder, for a trainer that reads by Spark."""
    files = shards(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for rows in batches for i in rows.column(0).to_pylist()):
            file = SequenceFile(folder, files[i].file)
            for b in range(file.reader.num_record_batches):
                found = file.reader.get_batch(b)
                number = pa.array(np.arange(found.num_rows, dtype=np.int64) + files[i].first_sequence + b * file.batch)
                ids, mask = (pa.ListArray.from_arrays(np.arange(found.num_rows + 1, dtype=np.int32) * file.length, found.column(k).flatten().cast(t)) for k, t in ((0, pa.int64()), (1, pa.bool_())))
                yield pa.RecordBatch.from_arrays([number, ids, mask], ["sequence", "ids", "mask"])

    places = spark.range(0, len(files), 1, max(len(files), 1))
    return places.mapInArrow(run, "sequence long, ids array<long>, mask array<boolean>")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the checkpoint folder, which driver and executors share."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
