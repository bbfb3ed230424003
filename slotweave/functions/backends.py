"""Models as exchangeable parts: text generators and embedders that run batch-wise in the workers."""

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators.skew import lookup
from slotweave.session import opened, share


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class RuleGenerator:
    """The offline generator: applies a function to each prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


class HashEmbedder:
    """The offline embedder: hashed words and letter trigrams, unit length."""

    def embed(self, texts: list[str]) -> np.ndarray:
        from slotweave.operators.vectors import hashed_vector

        return np.stack(hashed_vector(pd.Series(texts))) if texts else np.empty((0, 256))


class WordEmbedder:
    """An offline embedder by words alone."""

    def embed(self, texts: list[str]) -> np.ndarray:
        from slotweave.operators.vectors import word_vectors

        return np.stack(word_vectors(texts)) if texts else np.empty((0, 256))


def generated(df: DataFrame, prompt: str, make: Callable[[], Generator], batch: int = 64) -> DataFrame:
    """df (with a column `key`) as (key, reply): the backend is made once a task; a prompt that fails gets a null reply."""
    shared = share(df.sparkSession, make)

    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = opened(shared)()
        for b in batches:
            replies: list = []
            texts = list(b[prompt].fillna(""))
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    replies += backend.generate(part)
                except Exception:  # noqa: BLE001 - one bad batch must not end the run
                    replies += [None] * len(part)
            yield pd.DataFrame({"key": b["key"], "reply": replies})

    return df.select("key", prompt).mapInPandas(run, f"key {kind}, reply string")


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder]) -> DataFrame:
    """df with `embedding`: each distinct text is embedded once and joined back."""
    shared = share(df.sparkSession, make)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = opened(shared)()
        for b in batches:
            if not len(b):
                continue
            yield pd.DataFrame({text: b[text], "embedding": list(backend.embed(list(b[text])))})

    one = df.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")
    return lookup(df, one, [text], F.monotonically_increasing_id(), "left")


def messages(system: str, examples: list[tuple[str, str]], prompt: str):
    """The column of chat messages for a prompt column: system, worked examples, the prompt."""
    said = [("system", system), *(m for u, a in examples for m in (("user", u), ("assistant", a)))]
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in said], F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))
