"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit
verification.

The CGK random walk reads a string symbol by symbol; at every step it writes the
current symbol and a random bit, drawn for the step and the symbol, says whether
to move on. Strings at a small edit distance are thereby mapped to strings at a
small Hamming distance, of which samples of positions are hashed.

An item-sized window is embedded by walks that begin anew at each of its words,
so that an insertion disturbs the walks around it and no others. Each repetition
is one word's walk under one of WALKS draws of moves and sampled positions: a
window of n words has n * WALKS repetitions, spread over the whole of it. Two
windows that agree in enough repetitions on one diagonal are a candidate; of the
candidates those stay that some block of the item allows, and of these the edit
distance is computed exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices

#: Similarity (1 - edit distance / item length) that makes a leak.
SIMILARITY = 0.8
#: Least item length and walk steps of each tier: the shorter an item, the fewer
#: repetitions it has, and the likelier each must be to agree. Items shorter than
#: the last are found by their whole text. The target is a recall of 0.9 at the
#: least similarity for items of 40 characters or more (the tests hold to it).
TIERS = ((96, 26), (40, 14), (16, 10))
#: Steps, at most the least of a tier's, after which walks of no item end.
EARLY = (6, 10)
#: Draws of moves and positions, and the share of the steps that is sampled.
WALKS, SHARE = 3, 0.7
#: Repetitions that must agree, by the number of words of the item: as many as
#: leave the recall over its target at the least similarity.
AGREE = ((32, 2), (0, 1))
#: Characters of benchmark text in one broadcast; larger tables go in slices.
SLICE_CHARS = 16_000_000
STARTS_AT_ONCE = 32_768
BLOCK = 64
#: Code points from here on are written without blanks: each begins a walk.
NO_BLANKS = 0x2E80


def normalise(text: str | None) -> str:
    """Lower case, white space to single spaces."""
    return " ".join((text or "").lower().split())


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points folded to a byte each, and where walks begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    data = (points ^ (points >> 8)).astype(np.uint8)
    begins = (points == 32) | (points == 0)
    begins = np.r_[True, begins[:-1]] | (points >= NO_BLANKS)
    return data, np.flatnonzero(begins & (points != 0) & (points != 32))


class Walk:
    """One draw of moves and sampled positions, the same everywhere."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        steps = TIERS[0][1]
        weights = rng.integers(1, 1 << 62, (steps, 256)).astype(np.uint64) | np.uint64(1)
        taken = rng.random(steps) < SHARE
        taken[0] = True
        self.moves = rng.integers(0, 2, (steps, 256)).astype(np.intp)
        self.weights = [w if t else None for w, t in zip(weights, taken, strict=True)]

    def hashes(self, data: np.ndarray, starts: np.ndarray, steps: set[int], sieves: dict[int, Sieve] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """After each number of ``steps`` the numbers of the starts and the hashes
        of their walks. What a sieve of that many steps does not hold goes no
        further: walks that agree have agreed at every earlier step."""
        at, out = starts.astype(np.intp), {}
        rows, total = np.arange(len(at)), np.zeros(len(at), np.uint64)
        for t in range(max(steps)):
            c = data.take(at, mode="clip").astype(np.intp)
            if self.weights[t] is not None:
                total += self.weights[t].take(c)
            at += self.moves[t].take(c)
            if sieves and t + 1 in sieves:
                held = sieves[t + 1].holds(total)
                at, rows, total = at[held], rows[held], total[held]
            if t + 1 in steps:
                out[t + 1] = rows, total.copy()
        return out


class Sieve:
    """A set of hashes as bits: what it does not hold is not among them."""

    def __init__(self, hashes: np.ndarray):
        bits = max(16, (8 * len(hashes)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[(hashes >> np.uint64(20)) & self.mask] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bits.take(((hashes >> np.uint64(20)) & self.mask).view(np.int64)))


def edit_within(item: str, text: str, limit: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to any part of ``text`` and the end of
    that part, the first such, or None if over ``limit`` (bit-parallel, exact).
    Of ``anchored`` parts only those at the beginning of ``text`` count."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | anchored) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= limit else None


class Index:
    """Hashes of the walks of the items, and masks of their blocks."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.walks = [Walk(seed) for seed in range(1, WALKS + 1)]
        self.items = [(i, x) for i, t in items if (x := normalise(t))]
        self.limits = np.array([int((1 - similarity) * len(x) + 1e-9) for _, x in self.items], np.int64)
        self.agree = np.ones(len(self.items), np.int64)
        self.tiny = ahocorasick.Automaton()
        for k, (_, x) in enumerate(self.items):
            if len(x) < TIERS[-1][0]:
                self.tiny.add_word(f" {x} ", [*self.tiny.get(f" {x} ", []), k])
        if len(self.tiny):
            self.tiny.make_automaton()
        self.tables, early = [], [{t: [] for t in EARLY} for _ in self.walks]
        longest = TIERS[0][1]
        for low, high in zip(TIERS, [(1 << 40, 0), *TIERS], strict=False):
            some = [k for k, (_, x) in enumerate(self.items) if low[0] <= len(x) < high[0]]
            if not some:
                continue
            data, starts = symbols(("\0" * longest).join([*(self.items[k][1] for k in some), ""]))
            sizes = np.array([len(self.items[k][1]) for k in some])
            begins = np.r_[0, np.cumsum(sizes + longest)[:-1]]
            own = np.searchsorted(begins, starts, "right") - 1
            words = np.bincount(own, minlength=len(some))
            self.agree[some] = [next(a for n, a in AGREE if w >= n) for w in words]
            rows = np.stack([np.array(some)[own], starts - begins[own]], 1)
            for r, walk in enumerate(self.walks):
                upto = walk.hashes(data, starts, {low[1], *EARLY})
                found = upto[low[1]][1]
                order = np.argsort(found, kind="stable")
                self.tables.append((r, low[1], found[order], rows[order], Sieve(found)))
                for t in EARLY:
                    early[r][t].append(upto[t][1])
        self.early = [{t: Sieve(np.concatenate(x)) for t, x in own.items()} for own in early] if self.tables else []
        self.steps = {t[1] for t in self.tables}
        # masks of the blocks of every item, over symbols folded to 5 bits
        counts = np.array([-(-len(x) // BLOCK) for _, x in self.items], np.int64)
        self.first = np.r_[0, np.cumsum(counts)]
        self.block_at, self.block_size = (np.zeros(self.first[-1], np.int64) for _ in range(2))
        self.masks = np.zeros((self.first[-1], 32), np.uint64)  # ends at the highest bit
        for k, (_, x) in enumerate(self.items):
            data, n = symbols(x)[0] & 31, counts[k]
            edges = np.arange(n + 1) * len(x) // n
            for j in range(n):
                b, part = self.first[k] + j, data[edges[j] : edges[j + 1]]
                self.block_at[b], self.block_size[b] = edges[j], len(part)
                spare = BLOCK - len(part)
                self.masks[b] = np.uint64((1 << spare) - 1)
                np.bitwise_or.at(self.masks[b], part, np.uint64(1) << np.arange(spare, BLOCK, dtype=np.uint64))

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Walks that agree: where in ``data``, which item's, and how far from
        the item's beginning."""
        hits, rows = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
        for i in range(0, len(starts) if self.tables else 0, STARTS_AT_ONCE):
            part = starts[i : i + STARTS_AT_ONCE]
            hashed = [walk.hashes(data, part, self.steps, sieves) for walk, sieves in zip(self.walks, self.early, strict=True)]
            for r, steps, hashes, own, sieve in self.tables:
                start, h = hashed[r][steps]
                hit = sieve.holds(h)
                low, high = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
                n = high - low
                which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                hits.append(np.repeat(part[start[hit]], n))
                rows.append(own[which])
        rows = np.concatenate(rows)
        return np.concatenate(hits), rows[:, 0], rows[:, 1]

    def candidates(self, hits: np.ndarray, item: np.ndarray, far: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (text, item, bucket) of diagonals on which enough walks agree.
        Buckets are as wide as an item's limit and overlap by half."""
        half = np.maximum(self.limits[item] // 2, 4)
        bucket = (hits - far) // half
        # a hit falls into the bucket that begins at its half and the one before;
        # where one hit is enough, into the former only
        rows = np.stack([owner, item, bucket, far], 1)
        rows = np.concatenate([rows, (rows - [0, 0, 1, 0])[self.agree[item] > 1]])
        if not len(rows):
            return rows[:, :3]
        # a text lies at one place of the data, so item and bucket tell the rest
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
        rows = rows[new]
        begins = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)])
        count = np.diff(np.r_[begins, len(rows)])
        found = rows[begins, :3]
        return found[count >= self.agree[found[:, 1]]]

    def windows(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What part of ``data`` the item may cover, if it lies on the bucket's
        diagonals, within its text (from ``low`` to ``high``)."""
        item = rows[:, 1]
        limit, size = self.limits[item], np.array([len(x) for _, x in self.items])[item]
        half = np.maximum(limit // 2, 4)
        begin = rows[:, 2] * half - limit
        return np.maximum(begin, low), np.minimum(begin + 2 * half + size + 2 * limit + 1, high)

    def possible(self, data: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which candidates some block allows: if the item is within its limit,
        one of its n blocks is within a share of it (no candidate is lost)."""
        item = rows[:, 1]
        n = self.first[item + 1] - self.first[item]
        row = np.repeat(np.arange(len(item)), n)
        block = np.repeat(self.first[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
        share = (self.limits[item] // n)[row]
        out = np.zeros(len(item), bool)
        folded = data & 31
        limit, half = self.limits[item], np.maximum(self.limits[item] // 2, 4)
        low = np.maximum(begin[row], (rows[:, 2] * half - limit)[row] + self.block_at[block])
        high = np.minimum(end[row], low + self.block_size[block] + (2 * half + 2 * limit)[row] + 1)
        order = np.argsort(high - low, kind="stable")
        for i in range(0, len(order), 8192):
            at = order[i : i + 8192]
            ok = self._block_distance(folded, low[at], high[at], block[at]) <= share[at]
            out[row[at[ok]]] = True
        return out

    def _block_distance(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Least edit distance of each block to any part of its stretch of data,
        shorter stretches first, all blocks in step, each in one word. A block ends
        at the highest bit; the bits before it match anything at no cost."""
        flat, base, size = self.masks.reshape(-1), block * 32, self.block_size[block]
        ends = np.cumsum(np.bincount(np.maximum(high - low, 0)))  # of how many the stretch ends by then
        pv = ~np.uint64(0) << (BLOCK - size).astype(np.uint64)
        mv = np.zeros(len(low), np.uint64)
        score, best, at = size.copy(), size.copy(), low.copy()
        left, one, sign, done = best, np.uint64(1), np.int64(63), 0
        for end in ends[:-1]:
            if end > done:
                base, pv, mv, score, left, at = (x[end - done :] for x in (base, pv, mv, score, left, at))
                done = end
            eq = flat.take(base + data.take(at, mode="clip"), mode="clip")
            at += 1
            xv = eq | mv
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh = pv & xh
            score -= ph.view(np.int64) >> sign
            score += mh.view(np.int64) >> sign
            ph <<= one
            mh <<= one
            mv = ph & xv
            np.bitwise_or(xv, ph, out=xv)
            np.invert(xv, out=xv)
            pv = mh | xv
            np.minimum(left, score, out=left)
        return best

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item id, distance, start, stop) of every item that
        a text holds; positions are those of the best part, in the normalised
        text."""
        gap = TIERS[0][1] + 1
        clean = [normalise(t) for t in texts]
        data, starts = symbols(("\0" * gap).join(["", *clean, ""]))
        sizes = np.array([len(x) for x in clean], np.int64)
        bounds = gap + np.r_[0, np.cumsum(sizes + gap)][:-1]
        hits, item, far = self.matches(data, starts)
        owner = np.searchsorted(bounds, hits, "right") - 1  # an item may lack its beginning
        rows = self.candidates(hits, item, far, owner)
        begin, end = self.windows(rows, bounds[rows[:, 0]], (bounds + sizes)[rows[:, 0]])
        good = self.possible(data, rows, begin, end)
        best: dict[tuple[int, int], tuple] = {}
        for (own, k, _), a, b in zip(rows[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True):
            ident, text = self.items[k]
            a, b = a - bounds[own], b - bounds[own]
            got = edit_within(text, clean[own][a:b], int(self.limits[k]))
            if got:
                stop = int(a + got[1])
                back = clean[own][max(0, stop - len(text) - int(self.limits[k])) : stop][::-1]
                start = stop - edit_within(text[::-1], back, len(text), anchored=True)[1]
                best[own, ident] = min(best.get((own, ident), (1 << 60,)), (got[0], start, stop))
        for own, text in enumerate(clean) if len(self.tiny) else ():
            for at, ks in self.tiny.iter(f" {text} "):
                for k in ks:
                    ident, x = self.items[k]
                    best[own, ident] = min(best.get((own, ident), (1 << 60,)), (0, at - len(x) - 1, at - 1))
        for (own, ident), found in sorted(best.items()):
            yield own, ident, *found


def _indexes(benchmark: DataFrame, similarity: float) -> Iterator[Index]:
    """Indexes of slices of the items, each of bounded size."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
        .distinct()
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // SLICE_CHARS)
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toArrow()
        yield Index(sorted(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between documents and the benchmark items that they hold.

    One row for each document row and item of which some part of the document
    is at an edit distance of at most ``(1 - similarity) * length``, over lower
    case with single spaces: ``doc_id, item_id, distance, start, stop`` (of the
    best part found, in that text, by characters). Items shorter than 16
    characters must occur as whole words. The items are gathered and broadcast in
    slices of bounded size, each slice being held against all documents. Null and
    empty texts, null item texts and rows with a null item id give no link;
    repeated document rows give their links again, repeated items one link, and
    of items with one id the best counts; either table may be empty; other
    columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, distance int, start int, stop int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [rows.mapInArrow(_finder(spark.sparkContext.broadcast(x)), schema) for x in _indexes(benchmark, similarity)]
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for done, part in text_slices(batch.column(1)):
                found = list(zip(*index.leaks(part), strict=True))
                if found:
                    owner = pa.array([done + i for i in found[0]])
                    rest = [pa.array(found[1], pa.int64()), *(pa.array(x, pa.int32()) for x in found[2:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *rest], ["doc_id", "item_id", "distance", "start", "stop"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, by the rule
    of ``find_leaks``, in one pass without a shuffle. Each row is judged by its
    own text, whatever its id; rows with a null text stay; all columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, similarity):
        docs = docs.mapInArrow(_keeper(spark.sparkContext.broadcast(index), at), docs.schema)
    return docs


def _keeper(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for done, part in text_slices(batch.column(at)):
                good[[done + x[0] for x in index.leaks(part)]] = False
            yield batch.filter(pa.array(good))

    return run
