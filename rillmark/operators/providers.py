"""Extension points: embeddings, pair scores, language models, jurisdictions, requests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark import packaging
from rillmark.functions import hashing


class Embedder(Protocol):
    """Makes vectors of texts; one is built lazily in each Python worker."""

    dimension: int
    revision: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    """Scores texts for one query each."""

    def score(self, queries: Sequence[str], texts: Sequence[str]) -> list[float]: ...


_built: dict[Callable, object] = {}


def _once(make: Callable):
    if make not in _built:
        _built[make] = make()
    return _built[make]


def embedded(corpus: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """``corpus`` with embedding, by any embedder: Arrow batches through a worker's own."""
    packaging.send(corpus.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_once(make).embed(texts.fillna("").tolist()))

    return corpus.withColumn("embedding", F.pandas_udf(run, "array<double>")("text"))


#: Fixed value: seconds a model has for the texts of one query.
PATIENCE = 1.2


def scored(pairs: DataFrame, make: Callable[[], Scorer], most: int = 768, seconds: float | None = PATIENCE) -> DataFrame:
    """``pairs`` (query, text) with model_score of the texts' first characters.  A batch
    that fails, or takes more than ``seconds`` for each query in it, has null scores, which
    leave an order as it was (fail-open).  The model's start does not count."""
    packaging.send(pairs.sparkSession)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            found = [None] * len(texts)
            pool = ThreadPoolExecutor(1)
            try:
                asked = pool.submit(_once(make).score, queries.tolist(), texts.fillna("").str.slice(0, most).tolist())
                found = asked.result(None if seconds is None else seconds * queries.nunique(dropna=False))
            except Exception:  # the model failed or is late
                pass
            pool.shutdown(wait=False)
            yield pd.Series(found, dtype="float64")

    return pairs.withColumn("model_score", F.pandas_udf(run, "double")("query", "text"))


def fingerprint(provider: Column, model: Column, dimension: Column, revision: Column) -> Column:
    """The identity of an embedding profile: what it is compared by before reuse."""
    return hashing.fingerprint12(F.concat_ws(":", provider, model, dimension.cast("string"), revision))


class Model(Protocol):
    """A language model, asked from the driver for one answer at a time."""

    name: str

    def invoke_structured(self, system: str, user: dict, fields: Sequence[str]) -> dict: ...

    def invoke_text(self, system: str, user: dict) -> str: ...


class EchoModel:
    """A stand-in language model: returns the payload it was given."""

    name = "echo"

    def invoke(self, system: str, user: dict) -> dict:
        return {**user, "model": self.name, "instructed": bool(system)}

    def invoke_structured(self, system: str, user: dict, fields: Sequence[str]) -> dict:
        said = self.invoke(system, user)
        return {f: said.get(f) for f in fields}

    def invoke_text(self, system: str, user: dict) -> str:
        return json.dumps(self.invoke(system, user), ensure_ascii=False, sort_keys=True)


@dataclass(frozen=True)
class Jurisdiction:
    """What a country's plans need to know."""

    country: str
    label: str
    domains: tuple[str, ...] = ("courts", "law")
    law_focus: str = ""
    court_focus: str = ""
    hints: tuple[str, ...] = field(default=())


JURISDICTIONS = (Jurisdiction("czechia", "Czech Republic"), Jurisdiction("russia", "Russian Federation"))


def checked(requests: DataFrame, least: float = 1, most: float = 25, name: str = "top_k", missing: float = 5) -> DataFrame:
    """Requests with ``name`` in its range (``missing`` where there is none); the run fails
    on others.  Strategies take a top_k of 2 to 20, a confidence is 0 to 1."""
    value = F.coalesce(name, F.lit(missing)) if name in requests.columns else F.lit(missing)
    wrong = ~value.between(least, most)
    return requests.withColumn(name, F.when(wrong, F.raise_error(F.lit(f"{name} must be from {least} to {most}")).cast("double" if isinstance(missing, float) else "int")).otherwise(value))


def log_events(rows: DataFrame, bucket: str, event: Column) -> DataFrame:
    """Log rows in the schema that the counters read."""
    return rows.select(F.lit(bucket).alias("bucket"), event.alias("event"), F.current_timestamp().alias("at"), F.to_json(F.struct("*")).alias("fields"))
