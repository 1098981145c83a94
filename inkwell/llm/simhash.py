"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, checkpointed, connected_components, prepare

SEED = 42
#: Segment width: two segments of 32 bits, so that a pair within RADIUS bits
#: differs in at most one bit of one of them.
HALF = 32
RADIUS = 3
#: Runs up to this length are compared by offsets, all runs at once.
SHORT_RUN = 12
#: A key with more fingerprints is divided before it is dealt out.
HOT_KEY = 4096
#: Runs above this length are divided by bytes within their task.
LONG_RUN = 20_000
#: Masks of 3 of the 6 parts of a half: of two halves within RADIUS bits, at
#: least 3 parts are equal.
PARTS = [0x3F << 26, 0x3F << 20, 0x1F << 15, 0x1F << 10, 0x1F << 5, 0x1F]
MASKS = [a | b | c for a, b, c in combinations(PARTS, 3)]
#: For links by similarity: bands of minima that make a candidate if equal. A
#: pair of similarity 0.8 is missed in 1 of 350 cases (1 - 0.8**ROWS)**BANDS.
BANDS, ROWS = 32, 8
#: Shingles of the sets that one task compares at a time.
TASK_SHINGLES = 1_000_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles of ``text``, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    Fewer words than ``width`` make one shingle, no words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)),
        np.uint64,
        len(words) - width + 1,
    )


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (fp as a signed long) for every row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of ``text``, sorted."""
    return np.unique(shingle_hashes(text, width))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the band and of the minima of its ROWS
    hash functions over ``shingles``; no shingles are one set like any other."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    a |= np.uint64(1)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024] * a + b).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its two segments and under each segment with one
    set bit cleared: of two segments one bit apart, one clears to the other."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        rep = batch.column(1).to_numpy()
        keys, rows = [], []
        at = np.arange(len(fp))
        for table, shift in enumerate((HALF, 0)):
            segment = (fp >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(table << HALF)
            keys.append(segment | tag)
            rows.append(at)
            for bit in range(HALF):
                has = np.flatnonzero(segment & np.uint64(1 << bit))
                keys.append((segment[has] & ~np.uint64(1 << bit)) | tag)
                rows.append(has)
        key, row = np.concatenate(keys).view(np.int64), np.concatenate(rows)
        for i in range(0, len(key), 65_536):
            r = row[i : i + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i : i + 65_536]), pa.array(fp[r].view(np.int64)), pa.array(rep[r])], ["key", "fp", "rep"]
            )


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the graph of the pairs within
    ``radius`` bits: found nodes leave the rest, so a dense group is cheap."""
    rest, found = np.arange(len(fp)), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            new = []
            for x in front:
                near = _apart(fp[rest], fp[x]) <= radius
                if near.any():
                    got = rest[near]
                    found += [(int(x), int(y)) for y in got]
                    new.append(got)
                    rest = rest[~near]
                    if not len(rest):
                        break
            front = np.concatenate(new) if new else front[:0]
    return found


def _run_edges(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    if len(fp) <= LONG_RUN:
        yield from _forest(fp, radius)
        return
    # 3 bits spoil 3 bytes at most, so of any four bytes one is equal
    parts = [(fp >> np.uint64(8 * k)) & np.uint64(255) for k in range(8)]
    for part in sorted(parts, key=lambda x: -len(np.unique(x)))[:4]:
        order = np.argsort(part, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield from ((int(group[a]), int(group[b])) for a, b in _forest(fp[group], radius))


def _match(radius: int):
    """Links within the runs of equal keys of a partition sorted by key."""

    def flush(key, fp, rep) -> pa.RecordBatch:
        us, vs = [], []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        longest = min(SHORT_RUN, int(sizes.max(initial=1)))
        short = np.repeat(sizes <= SHORT_RUN, sizes)
        for d in range(1, longest):
            i = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
            i = i[_apart(fp[i], fp[i + d]) <= radius]
            us.append(rep[i])
            vs.append(rep[i + d])
        for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
            pairs = np.array(list(_run_edges(fp[s : s + n], radius)), np.int64).reshape(-1, 2)
            us.append(rep[s + pairs[:, 0]])
            vs.append(rep[s + pairs[:, 1]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []  # parts of the run that is still open
        for batch in batches:
            key, fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and (not left or left[-1][0][-1] == key[-1]):
                left.append((key, fp, rep))
                continue
            whole = [*left, (key[:last], fp[:last], rep[:last])]
            key_, fp_, rep_ = (np.concatenate([x[i] for x in whole]) for i in range(3))
            if len(key_):
                yield flush(key_, fp_, rep_)
            left = [(key[last:], fp[last:], rep[last:])]
        if left:
            key, fp, rep = (np.concatenate([x[i] for x in left]) for i in range(3))
            yield flush(key, fp, rep)

    return run


def _without_hot_keys(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the keys of more than HOT_KEY fingerprints divided by parts
    of the other half; what shares a hot key and is near shares one of these."""
    hot = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY).select("key", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return keyed
    other = F.expr(f"if(shiftright(key, {HALF}) & 1 = 0, fp & {(1 << HALF) - 1}L, shiftrightunsigned(fp, {HALF}))")
    finer = F.array(*[F.xxhash64("key", F.lit(m), other.bitwiseAND(F.lit(m).cast("long"))) for m in MASKS])
    keys = F.when(F.col("hot"), finer).otherwise(F.array("key"))
    return keyed.join(hot, "key", "left").select(F.explode(keys).alias("key"), "fp", "rep")


def print_classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component_id`` for every distinct fingerprint of ``fps(doc_id, fp)``.

    Equal fingerprints are pre-aggregated to their smallest doc_id, so copies
    never meet in a pair. Every distinct fingerprint is put under each 32-bit
    segment and the segment's radius-1 ball; a segment that very many share is
    divided further by parts of the other one. What shares a key is compared
    over all 64 bits, and each run of keys yields a spanning forest, not all
    its pairs. ``component_id`` is the smallest doc_id reachable over links of
    at most ``radius`` (3 at most) differing bits.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("two segments with one-bit balls cover 3 differing bits at most")
    reps = checkpointed(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    keyed = _without_hot_keys(reps.mapInArrow(_probe, "key long, fp long, rep long"))
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_match(radius), "u long, v long")
    with batch_rows(fps.sparkSession, 65_536):  # rows of three numbers
        edges = checkpointed(edges)
    found = connected_components(edges)
    return reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for ``fps(doc_id, fp)``, by ``print_classes``;
    a row with a null id has a null component."""
    fps = checkpointed(fps)
    return fps.join(print_classes(fps, radius), "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document.

    Returns ``doc_id, fingerprint (16 hex digits), component_id``, one row per
    input row. Null and empty texts have fingerprint zero and link like any
    other; a row with a null id keeps its fingerprint but joins no class (null
    component); repeated rows stay; other columns are not read.
    """
    found = components(fingerprints(docs, width, id_col, text_col), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the graph of the pairs of ``sets``
    (sorted hashes) of a Jaccard similarity of ``similarity`` or more. A set
    leaves the rest by such a link only. Sets are counted through the lists of
    those that hold a shingle, so what shares none costs nothing."""
    sizes = np.array([len(x) for x in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(values, kind="stable")
    holder = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    bounds = np.searchsorted(values[order], np.arange(values.max(initial=-1) + 2))
    starts = np.r_[0, np.cumsum(sizes)]
    rest, found, left = np.ones(len(sets), bool), [], len(sets)

    def linked(x: int) -> np.ndarray:
        if not sizes[x]:
            return np.flatnonzero(rest & (sizes == 0))
        both = np.zeros(len(sets), np.int64)
        for i in range(starts[x], starts[x + 1], 256):
            own = values[i : min(i + 256, starts[x + 1])]
            runs = bounds[own + 1] - bounds[own]
            at = np.arange(runs.sum()) + np.repeat(bounds[own] - np.cumsum(runs) + runs, runs)
            both += np.bincount(holder[at], minlength=len(sets))
        return np.flatnonzero(rest & (both >= similarity * (sizes + sizes[x] - both)))

    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first], left, front = False, left - 1, [first]
        while front and left:
            got = linked(x := front.pop())
            rest[got] = False
            left -= len(got)
            found += [(x, int(y)) for y in got]
            front += got.tolist()
    return found


def _signatures(width: int):
    """``doc_id, fp, size, print, keys`` of every row: a digest of its shingle set,
    the set's size, the text's SimHash and the set's band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            fps = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            sizes = [len(x) for x in sets]
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            keys = [band_keys(x).view(np.int64) for x in sets]
            arrays = [batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "size", "print", "keys"])

    return run


def _sets(width: int):
    """``rep, fp, s``: the shingle set of every text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t.as_py(), width).tobytes() for t in part.column(1)]
                fps = [xxhash.xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["rep", "fp", "s"])

    return run


def _verified(similarity: float):
    """Links within the groups of ``key, rep, s`` of a partition sorted by key."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(set_links(sets, similarity), np.int64).reshape(-1, 2)
        own = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            for k, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != group and ids:
                    yield links(ids, sets)
                    ids, sets = [], []
                group = k
                ids.append(i)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
        if ids:
            yield links(ids, sets)

    return run


def _led(similarity: float):
    """Links of ``rep, s`` to ``leader, ls`` of the same row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, ls in zip(batch.column(1), batch.column(3), strict=True):
                x, y = (np.frombuffer(b.as_py(), np.uint64) for b in (s, ls))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["u", "v"])

    return run


def _large_groups(members: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Further links within the groups ``members(key, blocks, rep, s)`` that are
    too large for a task: ``u, v``, which with ``edges`` connect all that the
    groups' similar pairs connect.

    First every member is held against its group's smallest, then against the
    member that the first round linked most often, which is the original where
    all are copies of one. Groups that are of one class by then are done; of the
    others every two blocks are compared, each pair of blocks in a task.
    """
    members = checkpointed(members)
    for order in (F.lit(0), F.coalesce("links", F.lit(0))):
        links = edges.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        first = members.join(links, "rep", "left").groupBy("key").agg(F.max_by(F.struct("rep", "s"), F.struct(order.alias("o"), -F.col("rep"))).alias("l"))
        led = members.join(first, "key").select("rep", "s", F.col("l.rep").alias("leader"), F.col("l.s").alias("ls")).filter("rep <> leader")
        edges = checkpointed(edges.unionByName(led.mapInArrow(_led(similarity), "u long, v long")))
    found = connected_components(edges)
    own = members.select("key", "blocks", "rep").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    open_ = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    rest = members.join(open_, "key", "left_semi").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, cast(blocks as int) - 1), j -> xxhash64(key, least(i, j), greatest(i, j)))")
    paired = rest.select(F.explode(pairs).alias("key"), "rep", "s").repartition("key").sortWithinPartitions("key")
    return edges.unionByName(paired.mapInArrow(_verified(similarity), "u long, v long"))


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` by links of texts whose sets of ``width``-word
    shingles have a Jaccard similarity of ``similarity`` or more; ``fp`` is a
    digest of the set.

    Candidates come from SimHash fingerprints by multi-index hashing, as those of
    ``near_duplicates`` (links of at most RADIUS bits), and, as a similarity of 0.8
    may spoil more bits than any index of segments can enumerate, from MinHash over
    the sets, in 32 bands of 8 minima. What shares a class of fingerprints or a
    band is a group, in which links are searched for on the whole sets;
    groups with the same members are one, and a group of more than TASK_SHINGLES
    is worked on in blocks by many tasks. Texts of equal sets are one document, as
    are rows of one id, which links if any of its texts does. Null and empty
    texts have the empty set and link with each other; rows with a null id have a
    null component; repeated rows stay; other columns are not read.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = checkpointed(texts.mapInArrow(_signatures(width), "doc_id long, fp binary, size int, print long, keys array<long>"))
    fps = signed.select("doc_id", "fp")
    # equal sets have equal sizes and keys, but not equal fingerprints, which count repeats
    reps = checkpointed(
        signed.filter("doc_id IS NOT NULL").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.collect_set("print").alias("prints"))
    )
    prints = reps.select(F.explode("prints").alias("print"), "rep", "fp", "size")
    classes = print_classes(prints.select(F.col("rep").alias("doc_id"), F.col("print").alias("fp"))).select(F.col("fp").alias("print"), "component_id")
    near = prints.join(classes, "print").select(F.xxhash64(F.lit("simhash"), "component_id").alias("key"), "rep", "fp", "size").distinct()
    keyed = reps.select(F.explode("keys").alias("key"), "rep", "fp", "size").unionByName(checkpointed(near))
    groups = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp", "rep")).alias("h"), F.min("rep").alias("low"), F.sum("size").alias("shingles")
    )
    groups = checkpointed(
        groups.filter("n > 1").groupBy("n", "h", "low", "shingles").agg(F.min("key").alias("key"))
        .select("key", F.ceil((F.col("shingles") + F.col("n")) / TASK_SHINGLES).alias("blocks"))
    )
    members = keyed.join(groups, "key").select("key", "blocks", "rep", "fp")
    wanted = members.select("rep", "fp").distinct()
    sets = texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(width), "rep long, fp binary, s binary")
    members = members.join(sets.dropDuplicates(["rep", "fp"]), ["rep", "fp"]).select("key", "blocks", "rep", "s")
    small = members.filter("blocks = 1").select("key", "rep", "s").repartition("key").sortWithinPartitions("key")
    edges = checkpointed(small.mapInArrow(_verified(similarity), "u long, v long"))
    if not groups.filter("blocks > 1").isEmpty():
        edges = _large_groups(members.filter("blocks > 1"), edges, similarity)
    found = connected_components(edges)
    classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, classes: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id.
    ``classes`` has each doc_id with its component_id; by default those of
    ``similar_components``. Rows with a null doc_id stay; of rows that share the
    kept id, the first by text stays (of equal texts, one of them). Columns may
    be of any type and name."""
    found = similar_components(docs) if classes is None else classes
    kept = docs.join(found.filter("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.struct(*[c for c in (text_col,) if c in docs.columns], F.lit(0).alias("z"))
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("kept"))
    return one.select(*[F.col("kept")[c].alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))
