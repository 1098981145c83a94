"""Trie of conversations by their common beginnings.

A node is a distinct sequence of first turns, named by a hash of that sequence,
so a trie is a table and never a structure in memory. Each node belongs to its
smallest member; as whoever owns a node also owns what follows on its own path,
each conversation owns the end of its path, known by one number. Sums over
subtrees then need no walk down the tree: each occurrence of a node brings what
lies after it on its own conversation's path, owned or not, and one group-by of
the occurrences by node adds that up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Turns of a conversation that are worked on in one window, at most.
STRETCH = 1024
#: Ids of members that are joined into one string.
JOINED = 4096
#: What names a node: its depth and two hashes of the turns up to it.
NODE = ("depth", "a", "b")


def numbered(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, depth, digest, size`` for every turn of ``turns(conv_id, turn,
    role, text)``: its place in the conversation from 1, a SHA-256 of role and
    text, and the text's code points.

    Turns go by number, null first, and turns of one number by that digest; null
    roles and texts are empty; repeated rows are turns each; rows with a null id
    belong to no conversation and are left out. Turns are dealt by ranges of id,
    number and digest and counted range by range, so a conversation may hold any
    share of the table; texts don't leave the first task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    rows = checkpointed(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("_range", F.spark_partition_id()))
    return running(rows, F.col("_range"), ["turn", "digest"], depth=(F.sum, F.lit(1).cast("long"))).select("conv_id", "depth", "digest", "size")


def running(rows: DataFrame, stretch: Column, order: list, **folds: tuple) -> DataFrame:
    """``rows`` with running folds, ``name=(F.sum or F.bit_xor, column)``, along
    each conversation by ``order``. ``stretch`` must not fall along the order:
    each is folded by itself, and takes up what comes before it from the small
    table of the stretches' totals."""
    rows = rows.withColumn("_stretch", stretch)
    totals = rows.groupBy("conv_id", "_stretch").agg(*[fold(c).alias(f"_{n}") for n, (fold, c) in folds.items()])
    before = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "_stretch", *[F.coalesce(fold(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n, (fold, _) in folds.items()])
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = {F.sum: lambda x, y: x + y, F.bit_xor: lambda x, y: x.bitwiseXOR(y)}
    rows = rows.join(offsets, ["conv_id", "_stretch"])
    done = rows.withColumns({n: both[fold](F.col(f"_{n}"), fold(c).over(inside)) for n, (fold, c) in folds.items()})
    return done.drop("_stretch", *[f"_{n}" for n in folds])


def spliced(steps: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with common beginnings, made from ``numbered`` ones: of each
    id c the first h turns of conversation ``c - c % block`` (all it has, if
    fewer; none if it doesn't exist), then c's own turns after its first h, with
    h the unsigned CRC-32 of the decimal c modulo ``most``. Returns the turns and
    ``conv_id, length`` of all ids, those left without a turn included."""
    ids = steps.groupBy("conv_id").agg(F.max("depth").alias("own"))
    ids = ids.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    bases = ids.filter("conv_id = base").select(F.col("conv_id").alias("_b"), F.col("own").alias("_n"))
    ids = ids.join(bases, ids.base == bases._b, "left").withColumn("head", F.least("h", F.coalesce("_n", F.lit(0)))).select("conv_id", "own", "h", "base", "head")
    ids = checkpointed(ids.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    own = steps.join(ids.select("conv_id", "h", "head"), "conv_id").filter("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("head"))
    # At most ``most`` turns of a base go to at most ``block`` conversations each.
    beginnings = steps.filter((F.col("depth") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    heads = ids.filter("head > 0").select("conv_id", "base", "head").join(beginnings, "base").filter("depth <= head")
    columns = ("conv_id", "depth", "digest", "size")
    return own.select(*columns).unionByName(heads.select(*columns)), ids.select("conv_id", "length")


def trie(steps: DataFrame, conversations: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """The trie of ``steps(conv_id, depth, digest, size)``, as ``numbered`` gives
    them; ``conversations(conv_id, length)`` adds those without a turn.

    Returns a row per node: ``conv_id``, its smallest member; ``depth``;
    ``parent_conv_id``, null for the root, a node of depth 0 that all are members
    of; ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in its subtree,
    itself included); ``saved_tokens``, over its subtree the nodes' members less
    one times the size of their last turn; ``ends_sha256`` over the decimal ids,
    ascending and joined by commas, of the members that end there.

    Without conversations there is no node. Node names are 128 bits of hashes of
    depths and turns. Occurrences are added up before they are shuffled by node,
    so the root may have all conversations; a path is worked on in stretches, so
    a conversation may have any share of the turns; and of a node that very many
    conversations end in, ids are joined in parallel and only the strings go,
    streamed, through one digest, which has no parallel form.
    """
    if conversations is None:
        conversations = steps.groupBy("conv_id").agg(F.max("depth").alias("length"))
    term = lambda i: F.xxhash64(F.lit(i), "depth", "digest")
    at = F.expr(f"depth div {int(stretch)}")
    paths = running(steps, at, ["depth"], a=(F.bit_xor, term(1)), b=(F.bit_xor, term(2)))
    paths = paths.select("conv_id", *NODE, F.col("a").bitwiseXOR(term(1)).alias("pa"), F.col("b").bitwiseXOR(term(2)).alias("pb"), "size")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("a", "b")], *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")], zero.alias("size"))
    paths = checkpointed(paths.unionByName(roots).join(conversations, "conv_id"))
    nodes = checkpointed(paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    # The nodes that a conversation owns are the last ones of its path.
    owned = nodes.join(children, [*NODE], "left").groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("first"), F.max(F.when(F.col("n_children").isNull(), 1)).alias("leaf")
    )
    marked = paths.join(owned, "conv_id", "left").withColumn("mine", F.coalesce(F.col("depth") >= F.col("first"), F.lit(False)))
    after = running(marked, F.expr(f"-(depth div {int(stretch)})"), [F.col("depth").desc()], later=(F.sum, F.col("size")), own=(F.sum, F.when(F.col("mine"), F.col("size")).otherwise(0)))
    sums = after.groupBy(*NODE).agg(F.sum(F.col("later") - F.col("own")).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"))
    # Parents by name; only where a conversation's own nodes begin is the parent another's.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    begins = nodes.join(owned.withColumnRenamed("conv_id", "owner"), "owner")
    branches = begins.filter("depth = first").select(*NODE, "pa", "pb").join(parents, ["depth", "pa", "pb"]).select(*NODE, F.col("parent_conv_id").alias("other"))
    found = begins.select(*NODE, "owner", "n_convs", "first").join(children, [*NODE], "left").join(sums, [*NODE]).join(branches, [*NODE], "left").join(_endings(paths), [*NODE], "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("other")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _endings(paths: DataFrame) -> DataFrame:
    """``depth, a, b, ends`` of the nodes in which conversations end: SHA-256 of
    their ids. Ranges of (node, id) join up to JOINED ids to a string; the
    strings of a node go to one task, which streams them in order."""
    ends = paths.filter("depth = length").select(*NODE, "conv_id")
    ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, out = None, [], []
        for batch in batches:
            for *name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != node or len(held) >= JOINED:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held = name, []
                held.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["depth", "a", "b", "first", "ids"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, held[0], ",".join(map(str, held)))], ["depth", "a", "b", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name == node:
                    state.update(f",{ids}".encode())
                    continue
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["depth", "a", "b", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["depth", "a", "b", "ends"])

    strings = ends.mapInArrow(joined, "depth long, a long, b long, first long, ids string")
    ordered = strings.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return ordered.mapInArrow(digested, "depth long, a long, b long, ends string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``trie`` of the conversations of ``turns(conv_id, turn, role, text)`` as
    they stand, ordered as ``numbered`` says."""
    return trie(checkpointed(numbered(turns)))
