"""Models behind Columns: an encoder of texts, a scorer of question and text, a generator, each called on batches in the workers.

A model is made once a worker by ``load``, a function that travels to it; what it returns is called with lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a model is given at once.
BATCH = 64

_LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model of that name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _in_batches(model: Callable, *columns: pd.Series) -> list:
    """The model's results, null where an input is; rows with a null are not given to it."""
    out: list = [None] * len(columns[0])
    whole = [i for i, row in enumerate(zip(*columns, strict=True)) if all(isinstance(x, str) for x in row)]
    for k in range(0, len(whole), BATCH):
        part = whole[k : k + BATCH]
        made = model(*([c.iloc[i] for i in part] for c in columns))
        for i, x in zip(part, made, strict=True):
            out[i] = x
    return out


def encoder(name: str, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]) -> Callable[[Column], Column]:
    """An ``embed`` for pipelines and workspaces: texts to vectors of floats; a null text has none."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [float(v) for v in x] for x in _in_batches(loaded(name, load), texts)], dtype=object)

    return F.pandas_udf(run, "array<float>")


def pair_scorer(name: str, load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]) -> Callable[[Column, Column], Column]:
    """A ``score`` for pipelines: questions and texts to scores; a null on either side scores null."""

    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else float(x) for x in _in_batches(loaded(name, load), questions, texts)], dtype="float64")

    return F.pandas_udf(run, "double")


def generator(name: str, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]]) -> Callable[[Column], Column]:
    """A ``generate`` or ``condense`` for pipelines: prompts to answers; no prompt, no answer."""

    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(_in_batches(loaded(name, load), prompts), dtype=object)

    return F.pandas_udf(run, "string")
