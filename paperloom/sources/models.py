"""Model calls as injectable functions over batches, and what their answers mean."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix

#: From prompts to JSON texts, and from texts to vectors; None stands for a refused call, an exception for a broken one.
Ask = Callable[[list[str]], list[str | None]]
Embed = Callable[[list[str]], list[list[float] | None]]

PROMPT = (
    "Read the research paper below and answer with one JSON object and nothing else. Its keys: tldr (two sentences), "
    "institutions (list of names), problem_solved (three to seven words), tech_tools (list of names), datasets (list of names).\n\n"
)


def prompted(text: Column, chars: int = 60000) -> Column:
    return F.concat(F.lit(PROMPT), prefix(text, chars))


def _each(call: Callable[[list[str]], list], inputs: list[str]) -> tuple[list, list[str | None]]:
    """Results and errors. A call that raises is made again for each input alone, so that one input fails alone."""
    if not inputs:
        return [], []
    try:
        return call(inputs), [None] * len(inputs)
    except Exception as e:
        if len(inputs) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    found = [_each(call, [x]) for x in inputs]
    return [r[0] for r, _ in found], [e[0] for _, e in found]


def _called(rows: DataFrame, call: Callable[[list[str]], list], name: str, kind: str, concurrency: int | None) -> DataFrame:
    """rows (id, input) with what the call gives for each, and its error."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results, errors = _each(call, f["input"].tolist())
            yield pd.DataFrame({"id": f["id"], name: pd.Series(results, index=f.index, dtype=object), "error": pd.Series(errors, index=f.index, dtype=object)})

    return (rows.repartition(concurrency) if concurrency else rows).mapInPandas(run, f"id string, {name} {kind}, error string")


def asked(texts: DataFrame, ask: Ask, chars: int = 60000, concurrency: int | None = None) -> DataFrame:
    """texts (id, text) with ``answer`` and ``error``; ``concurrency`` bounds the calls in flight."""
    return _called(texts.select("id", prompted(F.col("text"), chars).alias("input")), ask, "answer", "string", concurrency)


def embedded(texts: DataFrame, embed: Embed, chars: int = 2000, concurrency: int | None = None) -> DataFrame:
    """texts (id, text) with ``embedding`` and ``error``."""
    return _called(texts.select("id", prefix(F.col("text"), chars).alias("input")), embed, "embedding", "array<float>", concurrency)


def catalogue(answers: DataFrame) -> DataFrame:
    """Names from catalogue answers (value: JSON with a list ``models``)."""
    models = F.from_json("value", "models array<struct<name string>>")["models"]
    return answers.select(F.explode(models).alias("m")).select(F.col("m.name").alias("name"))
