"""Nearest neighbours by randomly rotated one-bit codes.

Vectors and queries are dealt into blocks of bounded size, and every query block meets every vector block of
its dimension. Within a meeting the vectors are taken relative to the block's mean, rotated at random and
kept as one sign bit per dimension, packed into 64-bit words, with two correction scalars: the vector's
norm and the inner product of its unit vector with its code. A query is rotated likewise and quantised to
bit planes, so an inner product is a few popcounts; with the scalars it becomes an estimate of the distance
with an error bound. Exact distances, in double precision, are computed for the best estimates, then for
every vector whose lower bound is not beyond the k-th of these. Every vector is coded and no list is capped.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or
candidate; vectors of different dimension are never compared; rows that share a vec_id are queries and candidates each
by itself, only a query's own row is none of its candidates; null vec_ids take no part; ties in distance go to the smaller
vec_id, then to the row laid down first; with fewer than k candidates all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from manyvec.llm.common import narrow
from manyvec.session import stored

PLANES = 6


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of a block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.dim = vectors.shape[1]
        self.centre = vectors.mean(axis=0)
        self.turn = rotation(self.dim)
        rest = vectors - self.centre
        self.norm = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.where(self.norm > 0, self.norm, 1)[:, None]) @ self.turn
        self.bits = packed(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(float)
        #: inner product of each unit vector with its code, about 0.8
        self.fit = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.dim), 1e-6)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(1, self.dim - 1))

    def estimates(self, query: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances from one query to all vectors, and lower bounds of them at ``width``
        standard errors."""
        rest = query - self.centre
        size = float(np.sqrt(rest @ rest))
        turned = (rest / size if size > 0 else rest) @ self.turn
        low, step = turned.min(), max((turned.max() - turned.min()) / (2**PLANES - 1), 1e-12)
        levels = np.rint((turned - low) / step).astype(np.int64)
        both = np.zeros(len(self.bits))
        for plane in range(PLANES):
            word = packed((levels[None, :] >> plane & 1).astype(bool))
            both += np.bitwise_count(self.bits & word).sum(axis=1) * float(1 << plane)
        # code components are +-1/sqrt(dim)
        dot = (2 * (step * both + low * self.ones) - (step * levels.sum() + low * self.dim)) / np.sqrt(self.dim)
        cosine = dot / self.fit
        error = width * (self.spread + step / np.sqrt(12) / self.fit)
        square, scale = self.norm**2 + size**2, 2 * self.norm * size
        return square - scale * cosine, square - scale * np.minimum(cosine + error, 1)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed over the components in order."""
    total = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        gap = vectors[:, i] - query[i]
        total += gap * gap
    return np.sqrt(total)


def nearest(ids: np.ndarray, rows: np.ndarray, codes: Codes, vectors: np.ndarray, own: int, query: np.ndarray, k: int, width: float) -> list[tuple[float, int, int]]:
    """(distance, id, row) of the nearest, without the row ``own``."""
    guess, low = codes.estimates(query, width)
    guess[rows == own] = low[rows == own] = np.inf
    first = min(4 * k, len(ids))
    near = np.argpartition(guess, first - 1)[:first]
    near = near[np.isfinite(guess[near])]
    exact = distances(vectors[near], query)
    if len(near) >= k:  # whatever may still be nearer than the k-th of these
        kth = np.partition(exact, k - 1)[k - 1] ** 2 * (1 + 1e-12)
        rest = low <= kth
        rest[near] = False
        more = np.flatnonzero(rest)
        near, exact = np.concatenate([near, more]), np.concatenate([exact, distances(vectors[more], query)])
    best = np.lexsort((rows[near], ids[near], exact))[:k]
    return [(float(exact[i]), int(ids[near[i]]), int(rows[near[i]])) for i in best]


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v array<double>, dim, row): each usable vector, with a number of its own."""
    rows = narrow(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    return rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})


def search(vectors: DataFrame, every: int = 100, k: int = 10, width: float = 2.0, vector_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``."""
    rows = stored(usable(vectors), "vectors")
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    vb, qb = max(1, -(-n["n"] // vector_block)), max(1, -(-n["q"] // query_block))
    number = lambda salt, most: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(most)).cast("int")
    candidates = rows.withColumn("vb", number(1, vb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    asked = rows.where(F.col("id") % every == 0).withColumn("qb", number(2, qb))
    queries = asked.select(*[F.col(a).alias(b) for a, b in (("id", "query_id"), ("row", "own"), ("v", "query"), ("dim", "dim"), ("qb", "qb"))])
    queries = queries.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))

    def meet(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ids, rows, matrix = v["id"].to_numpy(), v["row"].to_numpy(), np.array(v["v"].tolist(), float)
            codes = Codes(matrix)
            for query_id, own, query in zip(q["query_id"], q["own"], q["query"]):
                out += [(query_id, own, i, r, s) for s, i, r in nearest(ids, rows, codes, matrix, own, np.asarray(query, float), k, width)]
        return pd.DataFrame(out, columns=["query_id", "own", "vec_id", "row", "score"]).astype({"query_id": "int64", "own": "int64", "vec_id": "int64", "row": "int64", "score": "float64"})

    keys = ["dim", "qb", "vb"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(meet, "query_id long, own long, vec_id long, row long, score double")
    by = W.partitionBy("own").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
