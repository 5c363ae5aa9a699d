"""Where a model that turns texts or images into token vectors plugs in, and a stand-in that hashes words."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    """Turns a batch of inputs into one (tokens, dim) matrix each."""

    dim: int

    def encode(self, batch: list) -> list[np.ndarray]: ...


class HashingEncoder:
    """Unit vectors seeded by each word: equal words meet, others nearly never do."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, batch: list) -> list[np.ndarray]:
        import zlib

        def vector(word: str) -> np.ndarray:
            v = np.random.default_rng(zlib.crc32(word.encode())).standard_normal(self.dim)
            return v / np.linalg.norm(v)

        return [np.array([vector(w) for w in (text or "").split()]).reshape(-1, self.dim) for text in batch]


class RowEncoder:
    """A stand-in for images: each pixel row, centred and at unit length, is a token."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, batch: list) -> list[np.ndarray]:
        out = []
        for image in batch:
            rows = np.asarray(image, float).mean(axis=2)[:, : self.dim]
            rows = rows - rows.mean()
            out.append(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12))
        return out


def encoded(rows: DataFrame, key: str, column: str, encoder: Encoder) -> DataFrame:
    """(key, toks) by an encoder that each task takes from the broadcast, batch by batch."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "toks": [m.tolist() for m in shared.value.encode(pdf[column].tolist())]})

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, toks array<array<double>>")
