"""Residual-compressed late-interaction index.

A document token is kept as the number of its nearest centroid and, for each component of the rest, a bucket number of
``bits`` bits; buckets and the values they stand for come from the same bounded sample as the centroids. So a token takes
2 + dim * bits / 8 bytes instead of 8 * dim. Documents lie in chunks of ``chunk`` documents, a row each, which one narrow pass
makes; nothing is shuffled, and every document is in the index.

A search brings blocks of queries to every chunk. There all documents are scored from their centroid numbers alone (a
token stands for its centroid); a few of the best are decompressed, and then every document whose rough score comes within
``width`` standard errors of the k-th of these; the error follows from how far a centroid's tokens lie from it. So how many are decompressed follows from the data and has no cap; the chunk
sends its best a query. A limit before the shuffle merges what a task has of all its chunks, so only a fixed number of rows a
query and task is moved, never a vector. ``reranked`` puts the original vectors of what was found in their place.

Documents and queries without tokens take no part; ties go to the smaller pid, on scores rounded to nine digits."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.operators import ann, scoring
from manyvec.session import stored

CHUNK = "pids array<long>, sizes array<int>, centroids binary, rests binary"
QUERIES = "qids array<long>, lengths array<int>, vectors binary"


@dataclass
class Codec:
    """Centroids (k, dim), the 2**bits - 1 limits between buckets, what each bucket stands for, and by centroid the root
    mean square of a component of the rest."""

    centroids: np.ndarray
    limits: np.ndarray
    values: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        if self.bits not in (1, 2, 4, 8) or len(self.limits) != len(self.values) - 1 or len(self.spread) != len(self.centroids) or len(self.centroids) > 65_536:
            raise ValueError("a codec has 2, 4, 16 or 256 values, a limit between any two, and at most 65,536 centroids")
        if self.dim * self.bits % 8:
            raise ValueError("a token's bits must fill whole bytes")

    @property
    def bits(self) -> int:
        return int(np.log2(len(self.values)))

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, packed bucket numbers: the first component in the highest bits)."""
        near = ann.nearest_rows(tokens, self.centroids).astype(np.uint16)
        buckets = np.searchsorted(self.limits, tokens - self.centroids[near], side="right").astype(np.uint8)
        planes = np.unpackbits(buckets[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return near, np.packbits(planes.reshape(len(tokens), -1), axis=1)

    def decode(self, near: np.ndarray, packed: np.ndarray) -> np.ndarray:
        shifts = np.arange(8 - self.bits, -1, -self.bits)
        by_byte = self.values[np.arange(256)[:, None] >> shifts & (len(self.values) - 1)]  # what the components in a byte stand for
        return self.centroids[near] + by_byte[packed].reshape(len(near), self.dim)

    def to_json(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "limits": self.limits.tolist(), "values": self.values.tolist(), "spread": self.spread.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Codec:
        held = json.loads(text)
        return cls(*[np.array(held[k]) for k in ("centroids", "limits", "values", "spread")])


def fit(docs: DataFrame, k: int | None = None, bits: int = 4, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> Codec:
    """Centroids by k-means and bucket limits by quantiles, both over the ``sample`` tokens with the smallest hash. Where ``k``
    is not given it is the power of two below 16 times the root of the number of tokens, within half the sample."""
    x = ann.sampled_tokens(docs, sample, seed)
    if not len(x):
        raise ValueError("no tokens to learn from")
    if k is None:
        n = docs.agg(F.sum(F.size("toks")).alias("n")).first()["n"]
        k = min(2 ** int(math.log2(16 * math.sqrt(n))), max(1, len(x) // 2), 65_536)
    centroids = ann.k_means(x, k, rounds, seed)
    return learned(x, centroids, bits)


def learned(x: np.ndarray, centroids: np.ndarray, bits: int) -> Codec:
    """Buckets and spreads from tokens ``x``: buckets of equal share; a centroid with fewer than two tokens has the common spread."""
    near = ann.nearest_rows(x, centroids)
    rest = x - centroids[near]
    squares, n = np.bincount(near, (rest * rest).mean(axis=1), len(centroids)), np.bincount(near, minlength=len(centroids))
    spread = np.sqrt(np.where(n > 1, squares / np.maximum(n, 1), (rest * rest).mean()))
    ordered = np.sort(rest.ravel())
    values = np.array([p.mean() if len(p) else 0.0 for p in np.array_split(ordered, 2**bits)])
    return Codec(centroids, np.quantile(ordered, np.arange(1, 2**bits) / 2**bits), values, spread)


@dataclass
class Index:
    """Compressed chunks with the codec that reads them."""

    chunks: DataFrame
    codec: Codec

    def save(self, path: str) -> None:
        """Chunks first, then the codec: an index without its codec is no index."""
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.chunks.sparkSession.createDataFrame([(self.codec.to_json(),)], "codec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        codec = Codec.from_json(spark.read.parquet(f"{path}/codec").first()["codec"])
        return cls(spark.read.parquet(f"{path}/chunks"), codec)

    def size(self) -> DataFrame:
        """(n_docs, n_tokens, n_bytes, plain_bytes): what is stored, and what the vectors take as doubles."""
        tokens = F.length("centroids") / 2
        return self.chunks.agg(
            F.sum(F.size("pids")).alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"), F.sum(F.length("centroids") + F.length("rests")).alias("n_bytes"),
            (F.sum(tokens) * 8 * self.codec.dim).cast("long").alias("plain_bytes"),
        )


def _chunked(rows: DataFrame, key: str, most: int, schema: str, make) -> DataFrame:
    """Rows (key, toks) gathered ``most`` at a time within a task, each lot one row by ``make(keys, sizes, tokens)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, bags, names = [], [], [c.split()[0] for c in schema.split(", ")]

        def sent() -> pd.DataFrame:
            return pd.DataFrame([make(keys, [len(b) for b in bags], np.concatenate(bags))], columns=names)

        for pdf in parts:
            for k, toks in zip(pdf[key], pdf["toks"]):
                keys.append(int(k))
                bags.append(np.array(toks.tolist(), float))
                if len(keys) == most:
                    yield sent()
                    keys, bags = [], []
        if keys:
            yield sent()

    return rows.where(F.size("toks") > 0).select(key, "toks").mapInPandas(run, schema)


def build(docs: DataFrame, codec: Codec, chunk: int = 1024) -> Index:
    """The index of all ``docs`` (pid, toks): one pass, no shuffle."""

    def packed(pids, sizes, tokens):
        near, rest = codec.encode(tokens)
        return pids, sizes, near.tobytes(), rest.tobytes()

    return Index(_chunked(docs, "pid", chunk, CHUNK, packed), codec)


class Chunk:
    """A chunk's documents, token after token; tokens are decompressed when they are asked for."""

    def __init__(self, codec: Codec, pids, sizes, centroids: bytes, rests: bytes):
        self.codec, self.pids, self.sizes = codec, np.asarray(pids, np.int64), np.asarray(sizes)
        self.near = np.frombuffer(centroids, np.uint16)
        self.rests = np.frombuffer(rests, np.uint8).reshape(len(self.near), -1)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spread = np.maximum.reduceat(codec.spread[self.near], self.starts)
        self.decompressed, self.tokens = 0, None

    def by_centroids(self, table: np.ndarray) -> np.ndarray:
        """Scores of all documents from ``table``: a query's tokens by centroids."""
        return np.maximum.reduceat(table[:, self.near], self.starts, axis=1).sum(axis=0)

    def exact(self, query: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of the documents at ``docs`` from their decompressed tokens, which are kept for further queries."""
        if self.tokens is None:
            self.tokens, self.open = np.zeros((len(self.near), self.codec.dim)), np.zeros(len(self.pids), bool)
        new = np.zeros(len(self.pids), bool)
        new[docs] = True
        if (new := new & ~self.open).any():
            at = np.flatnonzero(np.repeat(new, self.sizes))
            self.tokens[at] = self.codec.decode(self.near[at], self.rests[at])
            self.open |= new
            self.decompressed += len(at)
        if 4 * len(docs) > len(self.pids):  # scoring all at once beats gathering most of them
            return np.maximum.reduceat(query @ self.tokens.T, self.starts, axis=1).sum(axis=0)[docs]
        sizes = self.sizes[docs]
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[docs] - begins, sizes) + np.arange(sizes.sum())
        return np.maximum.reduceat(query @ self.tokens[at].T, begins, axis=1).sum(axis=0)

    def best(self, query: np.ndarray, k: int, width: float) -> list[tuple[int, float]]:
        """(pid, score) of the k best by decompressed tokens."""
        rough = self.by_centroids(query @ self.codec.centroids.T)
        first = self.order(rough, np.arange(len(rough)))[: 4 * k]
        scores = self.exact(query, first)
        if len(first) < len(rough):
            kth = np.partition(scores, len(first) - k)[len(first) - k]
            near = rough + width * float(np.sqrt((query * query).sum())) * self.spread >= kth
            near[first] = False
            rest = np.flatnonzero(near)
            if len(rest):
                first, scores = np.concatenate([first, rest]), np.concatenate([scores, self.exact(query, rest)])
        return [(int(self.pids[first[i]]), float(scores[i])) for i in self.order(scores, first)[:k]]

    def order(self, scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Best first, ties to the smaller pid."""
        return np.lexsort((self.pids[docs], -np.round(scores, 9)))

    def best_by_centroids(self, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        rough = self.by_centroids(query @ self.codec.centroids.T)
        return [(int(self.pids[i]), float(rough[i])) for i in self.order(rough, np.arange(len(rough)))[:k]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "pid", "score")


def search(queries: DataFrame, index: Index, k: int = 10, width: float | None = 2.0, block: int = 512) -> DataFrame:
    """(qid, rank, pid, score): the k best of each query (qid, toks) by decompressed tokens; by centroids alone where
    ``width`` is None. Larger widths decompress more; an infinite one decompresses everything."""
    blocks = stored(_chunked(queries, "qid", block, QUERIES, lambda qids, lengths, v: (qids, lengths, v.tobytes())), "queries")
    codec, names = index.codec, ["qid", "pid", "score"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                held, vectors = Chunk(codec, row.pids, row.sizes, row.centroids, row.rests), np.frombuffer(row.vectors).reshape(-1, codec.dim)
                own = np.split(vectors, np.cumsum(row.lengths)[:-1])
                best = held.best_by_centroids if width is None else lambda query, k, held=held: held.best(query, k, width)
                out = [(int(q), *found) for q, query in zip(row.qids, own) for found in best(query, k)]
                yield pd.DataFrame(out, columns=names).astype({"qid": "int64", "pid": "int64", "score": "float64"})

    return _ranked(scoring.pairs(blocks, index.chunks).mapInPandas(run, "qid long, pid long, score double"), k)


def reranked(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The k best of what was found, by the original vectors: equi-joins of the found pairs, no others."""
    return _ranked(scoring.negative_scores(queries, found, docs), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of a query's exact results that were found."""
    hits = exact.select("qid", "pid").join(found.select("qid", "pid").withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def codes(index: Index) -> DataFrame:
    """(pid, tok, centroid, rest): the stored codes as rows, the rest in hexadecimal."""
    width = index.codec.dim * index.codec.bits // 8

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                near = np.frombuffer(row.centroids, np.uint16)
                toks = np.concatenate([np.arange(n) for n in row.sizes])
                yield pd.DataFrame({"pid": np.repeat(row.pids, row.sizes), "tok": toks, "centroid": near.astype("int64"), "rest": [row.rests[i * width : (i + 1) * width].hex() for i in range(len(near))]})

    return index.chunks.mapInPandas(run, "pid long, tok long, centroid long, rest string")
