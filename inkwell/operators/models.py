"""The boundary to models: a pluggable reader, applied in Arrow batches, loaded
once per worker and kept from task to task in a pool of bounded size. Only the
contract is here, and a fake."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import closing, contextmanager
from functools import cache
from typing import Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_prediction, repair_json, unfence


class Reader(Protocol):
    """What a model that reads pictures must offer (2.13): transcripts, the mean
    loss of a text, how far a picture's features lie from another's, and the log
    probabilities of a text's tokens with, on request, the greatest of each
    position."""

    def transcribe(self, images: list[str]) -> list[str]: ...
    def ce_loss(self, images: list[str], texts: list[str]) -> list[float]: ...
    def align_loss(self, images: list[str], references: list[str]) -> list[float]: ...
    def token_logprobs(self, images: list[str], texts: list[str], top_k: int = 0) -> list[tuple[list[float], list[list[float]]]]: ...
    def close(self) -> None: ...


class EchoReader:
    """Deterministic stand-in: reads the text it is given, some letters wrong."""

    def transcribe(self, images: list[str]) -> list[str]:
        return ["assistant " + (x or "").replace("l", "1") for x in images]

    def ce_loss(self, images: list[str], texts: list[str]) -> list[float]:
        return [-sum(lp) / max(len(lp), 1) for lp, _ in self.token_logprobs(images, texts)]

    def align_loss(self, images: list[str], references: list[str]) -> list[float]:
        return [-float((a or "") == (b or "")) for a, b in zip(images, references, strict=True)]

    def token_logprobs(self, images: list[str], texts: list[str], top_k: int = 0) -> list[tuple[list[float], list[list[float]]]]:
        found = [[-float(len(w)) / 10 for w in (t or "").split()] for t in texts]
        return [(lp, [[x - 0.5 * k for k in range(top_k)] for x in lp]) for lp in found]

    def close(self) -> None:
        pass


class Pool:
    """Models that a Python worker holds, at most ``size`` of them (2.13).

    A model is loaded when it is first asked for and stays for later tasks of the
    same worker. Before another is loaded, the one not used for longest is
    closed. While it waits, a model that offers ``rest`` and ``wake`` is put to
    rest, such as by moving its weights off the device. A model whose task
    failed is closed, as it may be broken."""

    def __init__(self, size: int = 1):
        self.size, self.idle = size, OrderedDict()

    @contextmanager
    def lent(self, name: str, make: Callable[[], Reader]) -> Iterator[Reader]:
        model = self.idle.pop(name, None)
        if model is None:
            while len(self.idle) >= self.size:
                self.idle.popitem(last=False)[1].close()
            model = make()
        elif hasattr(model, "wake"):
            model.wake()
        try:
            yield model
        except GeneratorExit:  # no more of the result is wanted
            self._back(name, model)
            raise
        except BaseException:
            model.close()
            raise
        else:
            self._back(name, model)

    def _back(self, name: str, model: Reader) -> None:
        if hasattr(model, "rest"):
            model.rest()
        self.idle[name] = model


@cache
def pool() -> Pool:
    """The pool of this worker: tasks are sent this function's name, not a pool."""
    return Pool()


class Generator(Protocol):
    """SRC10: what a model that writes content items must offer: so many items of
    a category, each a JSON object, as one text (STR14 and STR15 read it)."""

    def generate(self, category: str, n: int) -> str: ...
    def close(self) -> None: ...


class EchoGenerator:
    """Deterministic stand-in, with the fences that such answers have."""

    def generate(self, category: str, n: int) -> str:
        return "```json\n" + json.dumps([{"title": f"{category} {k}"} for k in range(n)]) + "\n```" if category != "none" else "I can't."

    def close(self) -> None:
        pass


GENERATORS: dict[str, Callable[[], Generator]] = {"echo": EchoGenerator}


REGISTRY: dict[str, Callable[[], Reader]] = {"echo": EchoReader}


def reader(name: str) -> Callable[[], Reader]:
    """An unknown name raises."""
    if name not in REGISTRY:
        raise KeyError(f"no model {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def transcribe(rows: DataFrame, model: str, image: str = "image", key: str = "image_id", profile: ResourceProfile | None = None) -> DataFrame:
    """``key, model_name, transcript`` of every row. ``profile`` says what a task
    of the model needs, such as a GPU, apart from the rest of the query."""
    make = reader(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with pool().lent(model, make) as r:
            for part in parts:
                yield pd.DataFrame({key: part[key], "transcript": r.transcribe(part[image].tolist())})

    kind = dict(rows.dtypes)[key]
    out = rows.select(key, image).mapInPandas(run, f"{key} {kind}, transcript string", profile=profile)
    return out.select(key, F.lit(model).alias("model_name"), clean_prediction(F.col("transcript")).alias("transcript"))


def token_logprobs(rows: DataFrame, model: str, image: str = "image", text: str = "text", key: str = "image_id", top_k: int = 0, profile: ResourceProfile | None = None) -> DataFrame:
    """``key, lp, top``: log probabilities of the text's tokens, and the ``top_k``
    greatest of each position (empty arrays without)."""
    make = reader(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with pool().lent(model, make) as r:
            for part in parts:
                found = r.token_logprobs(part[image].tolist(), part[text].tolist(), top_k)
                yield pd.DataFrame({key: part[key], "lp": [x[0] for x in found], "top": [x[1] for x in found]})

    return rows.select(key, image, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, lp array<double>, top array<array<double>>", profile=profile)


def losses(rows: DataFrame, model: str, image: str = "image", text: str = "text", reference: str = "reference", key: str = "image_id", profile: ResourceProfile | None = None) -> DataFrame:
    """``key, ce, align``: loss of the text, and of the picture's features against
    those of the reference."""
    make = reader(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with pool().lent(model, make) as r:
            for part in parts:
                images = part[image].tolist()
                yield pd.DataFrame({key: part[key], "ce": r.ce_loss(images, part[text].tolist()), "align": r.align_loss(images, part[reference].tolist())})

    return rows.select(key, image, text, reference).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, ce double, align double", profile=profile)


def generated(requests: DataFrame, generator: str, item: str) -> DataFrame:
    """SRC10, STR15: items (a struct of schema ``item``) for ``requests(category,
    n)``; an answer that is no list of items gives none."""
    if generator not in GENERATORS:
        raise KeyError(f"no generator {generator!r}; there are {sorted(GENERATORS)}")
    make = GENERATORS[generator]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(make()) as g:
            for part in parts:
                yield pd.DataFrame({"category": part["category"], "answer": [g.generate(c, int(n)) for c, n in zip(part["category"], part["n"], strict=True)]})

    answers = requests.select("category", "n").mapInPandas(run, "category string, answer string")
    items = F.from_json(unfence(repair_json(F.col("answer"))), f"array<struct<{item}>>")
    return answers.select("category", F.explode(F.coalesce(items, F.array().cast(f"array<struct<{item}>>"))).alias("item"))
