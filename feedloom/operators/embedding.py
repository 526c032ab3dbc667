"""Text to vector.

The default embedder hashes token counts with built-in expressions. It is a
lexical stand-in: it needs no model and shows the data flow, but does not rank
like a trained sentence model. A trained model plugs in as ``ModelEmbedder``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import vectors as vx


class Embedder(Protocol):
    def embed(self, df: DataFrame, col: str, out: str) -> DataFrame:
        """Add the vector of text column ``col`` as column ``out``."""


class TokenCountEmbedder:
    """Hashed token counts as a sparse vector; stays in the JVM."""

    def __init__(self, dim: int = vx.DIM):
        self.dim = dim

    def embed(self, df: DataFrame, col: str, out: str) -> DataFrame:
        return df.withColumn(out, vx.token_counts(col, self.dim))


class ModelEmbedder:
    """A model run on Arrow batches, loaded once per task.

    ``load`` takes nothing and returns a function from a list of texts to a
    list of equally long vectors. Only the text column goes to Python.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list]]):
        self.load = load

    def embed(self, df: DataFrame, col: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<float>")
        def run_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                present = texts[texts.notna()]
                vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
                if len(present):
                    vectors[present.index] = pd.Series(
                        [list(map(float, v)) for v in model(present.tolist())], index=present.index, dtype=object
                    )
                yield vectors

        return df.withColumn(out, run_model(F.col(col)))


def embed(df: DataFrame, col: str = "text", out: str = "vec", embedder: Embedder | None = None) -> DataFrame:
    """Add the vector of a text column."""
    return (embedder or TokenCountEmbedder()).embed(df, col, out)
