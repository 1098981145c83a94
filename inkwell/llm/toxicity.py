"""Toxicity scores from a bidirectional gated recurrent network.

Words enter as a learned vector of the word plus the mean of learned vectors of
its character 3-grams and 5-grams; a GRU runs over each direction of a window, an
attention layer pools its states, and a text is scored by its worst window.
Everything is trained here, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, text_slices

WINDOW, STRIDE = 40, 32
HIDDEN, DIM = 8, 12
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 16
GRAMS = (3, 5)
#: Labelled rows that are fitted to at most, and gradient steps whatever their
#: number.
TRAIN_ROWS, STEPS, BATCH = 6000, 320, 256
#: Against learning texts by heart: share of words hidden from a gradient step,
#: and shrinkage of the weights relative to the rate.
DROP, DECAY = 0.15, 0.1
#: One in so many labelled texts of each class is not fitted, but calibrates.
ASIDE = 10
#: Characters of labelled text gathered to the driver at most.
TRAIN_CHARS = 12_000_000
CACHE_WORDS = 200_000
WINDOWS_AT_ONCE = 2048

words_of = re.compile(r"\w+").findall


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word in the word table; rows of its n-grams in the gram
    table, all words in one array; start of each word's part in that array."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(words)), sizes)
    parts, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        at = np.arange(len(points) - n + 1)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ points[at + j]
        code = (code * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)
        same = owner[at] == owner[at + n - 1]
        parts.append(code[same].astype(np.int64) % GRAM_ROWS)
        owners.append(owner[at][same])
    mixed = np.full(len(words), 7, np.uint64)
    for j in range(int(sizes.max(initial=0))):
        has = sizes > j
        mixed[has] = (mixed[has] * np.uint64(0x9E3779B97F4A7C15)) ^ points[starts[:-1][has] + j]
    row = ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % WORD_ROWS
    gram, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return row, gram[order], np.searchsorted(owner[order], np.arange(len(words)))


def windows(n: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows over n words; one empty window over none."""
    for a in range(0, max(n - WINDOW + STRIDE, 1), STRIDE):
        yield a, min(a + WINDOW, n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gate(x: np.ndarray) -> np.ndarray:
    """sigmoid in place; exp may overflow to infinity, which gives 0."""
    np.negative(x, x)
    with np.errstate(over="ignore"):
        np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


@dataclass
class Model:
    """Weights; ``w*`` feed the gates (update, reset, candidate) of the forward
    and the backward GRU from the inputs, ``u*`` from the states."""

    p: dict[str, np.ndarray]
    scale: np.ndarray  # of the worst window's logit, of log(1 + windows), offset

    @staticmethod
    def fresh(seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        make = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        p = {"word": make(WORD_ROWS, DIM, s=0.05), "gram": make(GRAM_ROWS, DIM, s=0.15), "att": make(2 * HIDDEN), "out": make(2 * HIDDEN), "bias": np.full(1, -1.5, np.float32)}
        for d in "fb":
            p |= {f"w{d}": make(2 * DIM, 3 * HIDDEN), f"u{d}": make(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Model(p, np.array([1.0, 0.0, 0.0]))

    def inputs(self, words: list[str]) -> np.ndarray:
        row, gram, starts = word_features(words)
        sums = np.add.reduceat(self.p["gram"][gram], starts, axis=0)
        counts = np.diff(np.r_[starts, len(gram)])[:, None]
        return np.concatenate([self.p["word"][row], sums / np.sqrt(counts).astype(np.float32)], 1)

    def gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], 1)

    def logits(self, table: list[np.ndarray], index: np.ndarray) -> np.ndarray:
        """Of windows, rows of ``index`` into each gate's ``table``; row 0 is padding,
        which leaves the state as it is and gets no attention."""
        n, steps = index.shape
        heat, value = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        columns = np.ascontiguousarray(index.T)
        x, y = np.empty((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            uz, ur, uc = (np.ascontiguousarray(u) for u in np.split(self.p[f"u{d}"], 3, axis=1))
            tz, tr, tc = table[3 * k : 3 * k + 3]
            both = np.stack([self.p[w][HIDDEN * k : HIDDEN * (k + 1)] for w in ("att", "out")], 1)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                at = columns[t]
                np.matmul(h, ur, out=x)
                x += tr.take(at, 0)
                _gate(x)
                x *= h
                np.matmul(x, uc, out=y)
                y += tc.take(at, 0)
                np.tanh(y, y)
                y -= h
                np.matmul(h, uz, out=x)
                x += tz.take(at, 0)
                y *= _gate(x)
                h += y
                found = h @ both
                heat[t] += found[:, 0]
                value[t] += found[:, 1]
        heat[(index == 0).T] = -30
        heat = np.exp(heat - heat.max(0))
        return (heat * value).sum(0) / heat.sum(0) + self.p["bias"][0]

    def score(self, worst: np.ndarray, count: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * worst + self.scale[1] * np.log1p(count) + self.scale[2])


def _padding() -> list[np.ndarray]:
    """Gates of padding, by gate: the update gates stay shut."""
    rows = [np.zeros((1, HIDDEN), np.float32) for _ in range(6)]
    rows[0][:] = rows[3][:] = -30
    return rows


class Scorer:
    """Scores texts, remembering the gates of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, _padding()

    def _index(self, words: list[list[str]]) -> list[np.ndarray]:
        rows = self.rows
        if len(rows) > CACHE_WORDS:
            rows.clear()
            self.table = _padding()
        new = sorted({w for x in words for w in x if w not in rows})
        if new:
            parts = [self.model.gates(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            rows.update(zip(new, range(len(self.table[0]), len(self.table[0]) + len(new)), strict=True))
            found = np.split(np.concatenate(parts), 6, axis=1)
            self.table = [np.concatenate(x) for x in zip(self.table, found, strict=True)]
        return [np.fromiter(map(rows.__getitem__, x), np.int32, len(x)) for x in words]

    def worst(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of the worst window of each text, and its number of windows."""
        found = self._index([words_of(t.lower()) for t in texts])
        counts = np.array([max(1, -(-(len(x) - WINDOW + STRIDE) // STRIDE)) for x in found])
        index = np.zeros((counts.sum(), WINDOW), np.int32)
        at = 0
        for x, k in zip(found, counts, strict=True):
            padded = np.zeros((k - 1) * STRIDE + WINDOW, np.int32)
            padded[: len(x)] = x
            index[at : at + k] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
            at += k
        logits = np.concatenate([self.model.logits(self.table, index[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(index), WINDOWS_AT_ONCE)])
        return np.maximum.reduceat(logits, np.r_[0, np.cumsum(counts)[:-1]]), counts

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.model.score(*self.worst(texts)) if texts else np.empty(0)


def _step(model: Model, words: list[str], index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of a batch of windows. ``index`` has
    0 for padding and i + 1 for words[i]."""
    p, (n, steps) = model.p, index.shape
    row, gram, starts = word_features(words)
    counts = np.diff(np.r_[starts, len(gram)])
    norm = (1 / np.sqrt(counts))[:, None].astype(np.float32)
    x = np.concatenate([p["word"][row], np.add.reduceat(p["gram"][gram], starts, axis=0) * norm], 1)
    real = (index > 0).astype(np.float32)
    saved, states = {}, {}
    for d in "fb":
        gates = np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ p[f"w{d}"] + p[f"c{d}"]])
        h, u, trace = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"], []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, m = gates[index[:, t]], real[:, t : t + 1]
            g = sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN] * m, g[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            trace.append((t, h, z, r, c, m))
            h = h + z * (c - h)
            states[d, t] = h
        saved[d] = trace
    full = np.stack([np.concatenate([states["f", t], states["b", t]], 1) for t in range(steps)])
    heat = np.where(real.T > 0, full @ p["att"], -30)
    heat = np.exp(heat - heat.max(0))
    alpha = heat / heat.sum(0)
    value = full @ p["out"]
    pooled = (alpha * value).sum(0)
    delta = (sigmoid(pooled + p["bias"][0]) - y) * weight
    da = alpha * (value - pooled) * delta
    g = {"bias": delta.sum(keepdims=True), "out": np.einsum("tn,tnh->h", alpha * delta, full), "att": np.einsum("tn,tnh->h", da, full)}
    dfull = (alpha * delta)[..., None] * p["out"] + da[..., None] * p["att"]
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u = p[f"u{d}"]
        du, dh = np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
        dgates = np.zeros((len(words) + 1, 3 * HIDDEN), np.float32)
        for t, h, z, r, c, m in reversed(saved[d]):
            dh = dh + dfull[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            dc = dh * z * (1 - c * c)
            drh = dc @ u[:, 2 * HIDDEN :].T
            dz = dh * (c - h) * z * (1 - z) * m
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            du[:, : 2 * HIDDEN] += h.T @ dzr
            du[:, 2 * HIDDEN :] += (r * h).T @ dc
            np.add.at(dgates, index[:, t], np.concatenate([dzr, dc], 1))
            dh = dh * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
        dgates = dgates[1:]
        g |= {f"u{d}": du, f"w{d}": x.T @ dgates, f"c{d}": dgates.sum(0)}
        dx += dgates @ p[f"w{d}"].T
    g["word"], g["gram"] = (row, dx[:, :DIM]), (gram, np.repeat(dx[:, DIM:] * norm, counts, axis=0))
    return g


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 0) -> Model:
    """Fits a model to labelled texts: windows first take their text's label,
    later steps take the worst window of a toxic text and any window of the
    others; then the score is calibrated on whole texts that were set aside (on
    the fitted ones where a class has too few to set one aside)."""
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(texts) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        model.scale = np.array([0.0, 0.0, np.log(rate / (1 - rate))])
        return model
    same: dict[str, str] = {}
    words = [[same.setdefault(w, w) for w in words_of(t.lower())] for t in texts]
    spans = [list(windows(len(w))) for w in words]
    shuffled = [rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)]
    aside = [g[: len(g) // ASIDE] for g in shuffled]
    groups = [g[len(g) // ASIDE :] for g in shuffled]
    focus = [None] * len(texts)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}

    for step in range(steps):
        if step and step % (steps // 5) == 0:  # where in toxic texts to look
            scorer = Scorer(model)
            chosen = rng.permutation(groups[1])[:600]
            for i in chosen:
                index = scorer._index([words[i]])[0]
                block = np.zeros((len(spans[i]), WINDOW), np.int32)
                for j, (a, b) in enumerate(spans[i]):
                    block[j, : b - a] = index[a:b]
                top = np.argsort(-model.logits(scorer.table, block))[: max(1, len(block) // 8)]
                focus[i] = top
        picks = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        parts = []
        for i in picks:
            j = rng.choice(focus[i]) if focus[i] is not None and rng.random() < 0.9 else rng.integers(len(spans[i]))
            a, b = spans[i][j]
            parts.append(words[i][a:b])
        own = sorted({w for x in parts for w in x}) or ["\x00"]
        rows = {w: i + 1 for i, w in enumerate(own)}
        index = np.zeros((len(parts), WINDOW), np.int64)
        for i, x in enumerate(parts):
            index[i, : len(x)] = [rows[w] for w in x]
        index[rng.random(index.shape) < DROP] = 0
        g = _step(model, own, index, y[picks], np.full(len(picks), 1 / len(picks), np.float32))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, v in g.items():
            if isinstance(v, tuple):
                dense = np.zeros_like(model.p[k])
                np.add.at(dense, v[0], v[1])
                v = dense
                touched = np.flatnonzero(np.abs(v).sum(1))
                first[k][touched] = 0.9 * first[k][touched] + 0.1 * v[touched]
                second[k][touched] = 0.99 * second[k][touched] + 0.01 * v[touched] ** 2
                model.p[k][touched] -= rate * first[k][touched] / (np.sqrt(second[k][touched]) + 1e-6) + rate * DECAY * model.p[k][touched]
            else:
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                shrink = rate * DECAY if k[0] in "wu" else 0
                model.p[k] = ((1 - shrink) * model.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    seen = np.concatenate(aside if all(map(len, aside)) else groups)
    _calibrate(model, [texts[i] for i in seen], y[seen])
    return model


def _calibrate(model: Model, texts: list[str], target: np.ndarray) -> None:
    """Logistic fit of the label to the worst window and the number of windows."""
    worst, counts = Scorer(model).worst(texts)
    x = np.stack([worst, np.log1p(counts), np.ones(len(texts))], 1).astype(float)
    prior = np.array([1.0, 0.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 0.025 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        move = np.linalg.solve(h, x.T @ (p - target) + 0.05 * (w - prior))
        while loss(w - move) > loss(w) and np.abs(move).max() > 1e-9:  # a whole Newton step can overshoot
            move = move / 2
        w = w - move
    model.scale = w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold: int = 2) -> Model:
    """A model of ``labels.toxic`` from documents outside the held-out fold.

    Learns from the rows whose crc32(doc_id as text) mod 4 is not ``fold``: at
    most ``rows`` of them, the first by a hash of their id, and of those as many
    whole texts as fit ``TRAIN_CHARS`` on the driver; of an id with several texts
    the first. Rows with a null id, text
    or label and labels other than 0 and 1 are not used; no usable label, or
    one class only, gives a constant score.
    """
    marked = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != fold)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # one text of each id, so that what is ordered has ``rows`` rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    texts = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    by_hash = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        texts.withColumn("_size", F.sum(F.length("text")).over(by_hash))
        .filter(F.col("_size") <= TRAIN_CHARS)
        .select("doc_id", "text", "toxic")
        .toArrow()
        .sort_by([("doc_id", "ascending")])
    )
    return train(found.column("text").to_pylist(), found.column("toxic").to_pylist())


_scorers: dict[bytes, Scorer] = {}


def _digest(model: Model) -> bytes:
    """Of all that a score depends on."""
    parts = [model.p[k].tobytes() for k in sorted(model.p)]
    return xxhash.xxh3_128_digest(b"".join([*parts, model.scale.tobytes()]))


def _scorer(key: bytes, model: Model) -> Scorer:
    """One scorer per worker process, kept between tasks."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def _scores(key: bytes, model: Model, column: pa.Array) -> np.ndarray:
    scorer = _scorer(key, model)
    return np.concatenate([np.empty(0), *(scorer.scores(part) for _, part in text_slices(column))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from the whole text alone.

    The score is the calibrated one of the worst of all overlapping windows.
    Null and empty texts are scored as one empty window; null ids and repeated
    rows stay; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared, key = spark.sparkContext.broadcast(model), _digest(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(key, shared.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all columns and
    without a shuffle; rows count as in ``score``."""
    spark = docs.sparkSession
    prepare(spark)
    shared, key, at = spark.sparkContext.broadcast(model), _digest(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(key, shared.value, batch.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
