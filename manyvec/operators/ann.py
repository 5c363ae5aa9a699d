"""Approximate late-interaction search: coarse centroids over document tokens, candidates by shared centroid, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.functions import vectors as V
from manyvec.operators import blocks as B
from manyvec.operators import scoring


def sampled_tokens(docs: DataFrame, sample: int, seed: int) -> np.ndarray:
    """Unit vectors: the ``sample`` tokens with the smallest hash."""
    toks = docs.select("pid", F.posexplode("toks").alias("tok", "v"))
    rows = toks.orderBy(F.xxhash64("pid", "tok", F.lit(seed)), "pid", "tok").limit(sample).select("v").toPandas()
    x = np.array(rows["v"].tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x


def nearest_rows(x: np.ndarray, c: np.ndarray, most: int = 2048) -> np.ndarray:
    """The number of each row's nearest centroid, ``most`` rows at a time."""
    return np.concatenate([(x[i : i + most] @ c.T).argmax(axis=1) for i in range(0, len(x), most)]) if len(x) else np.zeros(0, int)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of spherical k-means; one that gets nothing stays."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_rows(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        sums[np.bincount(near, minlength=len(c)) == 0] = c[np.bincount(near, minlength=len(c)) == 0]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit_centroids(docs: DataFrame, k: int = 64, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids fitted on the ``sample`` tokens with the smallest hash."""
    return k_means(sampled_tokens(docs, sample, seed), k, rounds, seed)


def nearest(v: Column, centroids: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` nearest centroids."""
    literal = F.array(*[F.array(*map(F.lit, c.tolist())) for c in centroids])
    scored = F.transform(literal, lambda c, i: F.struct((-V.dot(v, c)).alias("d"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(scored), 1, n), lambda s: s["i"])


def build(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Inverted lists (centroid, pid): each page once a centroid, so a page's many tokens don't multiply its candidates."""
    toks = docs.select("pid", F.explode("toks").alias("v"))
    return toks.select("pid", nearest(F.col("v"), centroids, 1)[0].alias("centroid")).distinct()


def search(queries: DataFrame, docs: DataFrame, index: DataFrame, centroids: np.ndarray, k: int = 10, nprobe: int = 4) -> DataFrame:
    """(qid, rank, pid, score): exact ranking of the documents that share a probed centroid. Blocks of queries with their
    probes meet chunks of documents with their lists, which score what meets and give k rows a query; no candidate pair is
    made before it is scored, however many share a centroid."""
    sets = lambda rows, key, name: rows.groupBy(key).agg(F.collect_set("centroid").alias(name))  # noqa: E731  at most a number a centroid
    probes = sets(queries.select("qid", F.explode("toks").alias("v")).select("qid", F.explode(nearest(F.col("v"), centroids, nprobe)).alias("centroid")), "qid", "probes")
    asked = queries.select("qid", "toks").join(scoring.small(probes), "qid")
    held = docs.select("pid", "toks").join(scoring.small(sets(index, "pid", "lists")), "pid")
    n_lists = len(centroids)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, pid {docs.schema['pid'].dataType.simpleString()}, score double"

    def marks(lists: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(lists), n_lists), np.float32)
        sizes = np.diff(lists.offsets.to_numpy())
        out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy()] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.met(batches):
            m = B.Met(row)
            if not m.fit:
                continue
            bags = m.bags()
            pids, lists, wanted = row["dkeys"].take(pa.array(bags.order)), marks(row["dlists"])[bags.order], marks(row["qprobes"])
            ids = pids.to_numpy(zero_copy_only=False)
            for a, b, tokens in m.queries(len(bags.vectors)):
                (found,) = B.scores(tokens, m.lengths[a:b], bags, [{"reduction": "max"}])
                meets = wanted[a:b] @ lists.T > 0
                i, j = np.nonzero(B.best_of(np.where(meets, np.round(found, 9), -np.inf), ids, k) & meets)
                yield pa.RecordBatch.from_arrays([row["qkeys"].take(pa.array(i + a)), pids.take(pa.array(j)), pa.array(found[i, j])], ["qid", "pid", "score"])

    scored = scoring.pairs(B.laid(asked, "qid", "q"), B.laid(held, "pid", "d", spread=True)).mapInArrow(run, schema)
    by = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "pid", "score")
