"""Particle-swarm search over bounded parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvec.operators import evaluation, images, metrics, scoring
from manyvec.operators.encoder import Encoder
from manyvec.session import held, release, stored


class Swarm:
    """Maximises an objective; c1, c2 and w weigh a particle's own best, the swarm's best and its motion."""

    def __init__(self, bounds: list[tuple[float, float]], particles: int = 10, iters: int = 20, c1: float = 0.5, c2: float = 0.3, w: float = 0.9, seed: int = 0):
        self.low, self.high = np.array(bounds, float).T
        if (self.low > self.high).any() or particles < 1 or iters < 1:
            raise ValueError("bounds must be ordered, particles and iters positive")
        self.particles, self.iters, self.c1, self.c2, self.w, self.seed = particles, iters, c1, c2, w, seed

    def optimize_all(self, objective: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, float]:
        """``objective`` scores all particles (rows) at once; each generation is one call."""
        rng = np.random.default_rng(self.seed)
        x = rng.uniform(self.low, self.high, (self.particles, len(self.low)))
        v = np.zeros_like(x)
        own, own_score = x.copy(), np.full(len(x), -np.inf)
        for _ in range(self.iters):
            score = np.asarray(objective(x), float)
            better = score > own_score
            own[better], own_score[better] = x[better], score[better]
            lead = own[int(np.argmax(own_score))]
            v = self.w * v + self.c1 * rng.random(x.shape) * (own - x) + self.c2 * rng.random(x.shape) * (lead - x)
            x = np.clip(x + v, self.low, self.high)
        best = int(np.argmax(own_score))
        return own[best], float(own_score[best])

    def optimize(self, objective: Callable[[np.ndarray], float]) -> tuple[np.ndarray, float]:
        return self.optimize_all(lambda x: np.array([objective(p) for p in x]))

    def optimize_frame(self, spark: SparkSession, objective: Callable[[DataFrame], DataFrame]) -> tuple[np.ndarray, float]:
        """``objective`` turns (particle, params) into (particle, score): one Spark job a generation."""

        def score(x: np.ndarray) -> np.ndarray:
            frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "particle long, params array<double>")
            found = {r["particle"]: r["score"] for r in objective(frame).select("particle", "score").collect()}  # a row a particle
            return np.array([found[i] for i in range(len(x))])

        return self.optimize_all(score)


def temperature_search(queries: DataFrame, docs: DataFrame, qrels: DataFrame, swarm: Swarm, reduction: str = "smoothmax", k: int = 5) -> tuple[float, float]:
    """(temperature, mean nDCG) of the best softened scoring: each generation is one pass over the pairs, which computes
    their similarities once for all particles."""
    queries, docs, qrels = (stored(df, name) for df, name in ((queries, "queries"), (docs, "docs"), (qrels, "qrels")))

    def objective(particles: np.ndarray) -> np.ndarray:
        before = set(held())
        settings = [{"reduction": reduction, "temperature": float(p[0])} for p in particles]
        found = evaluation.per_query_settings(queries, docs, qrels, settings, k).groupBy("setting").agg(F.avg("ndcg").alias("score"))
        scores = {r["setting"]: r["score"] for r in found.collect()}  # a row a particle
        release(queries.sparkSession, [p for p in held() if p not in before])
        return np.array([scores.get(i, 0.0) for i in range(len(particles))])

    best, score = swarm.optimize_all(objective)
    return float(best[0]), score


@dataclass(frozen=True)
class Restoration:
    """Steps of a restoration, each with the option that a search may set and the least value it takes."""

    steps: tuple[tuple[str, str, float], ...] = (("nlmeans", "h", 1.0), ("gaussian", "sigma", 0.1))
    fixed: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()

    def __post_init__(self):
        if unknown := [n for n, *_ in self.steps if n not in images.STACKS]:
            raise ValueError(f"unknown steps {unknown}; there are {sorted(images.STACKS)}")

    def __call__(self, stack: np.ndarray, params: list[float]) -> np.ndarray:
        more = {name: dict(options) for name, options in self.fixed}
        for (name, option, least), value in zip(self.steps, params, strict=True):
            stack = images.STACKS[name](stack, **{option: max(least, float(value))}, **more.get(name, {}))
        return stack


#: Numbers of pixels that are restored at once.
PIXELS = 4_000_000


def restored_bags(degraded: DataFrame, particles: np.ndarray, restoration: Restoration, encoder: Encoder) -> DataFrame:
    """(particle, doc, pid, toks): every image (id, doc, h, w, c, data) restored by every particle and encoded. The particle
    travels with the image as a key, so all particles of a generation are one narrow pass."""
    shared = degraded.sparkSession.sparkContext.broadcast((particles, restoration, encoder))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        particles, restoration, encoder = shared.value
        for pdf in parts:
            for (h, w, c), same in pdf.groupby(["h", "w", "c"]):
                most = max(1, PIXELS // max(1, h * w * c))
                for at in range(0, len(same), most):
                    lot = same.iloc[at : at + most]
                    stack = np.frombuffer(b"".join(lot["data"]), np.uint8).reshape(len(lot), h, w, c)
                    for n, params in enumerate(particles):
                        toks = encoder.encode(list(restoration(stack, params)))
                        yield pd.DataFrame({"particle": n, "doc": lot["doc"].to_numpy(), "pid": lot["id"].to_numpy(), "toks": [m.tolist() for m in toks]})

    return degraded.select("id", "doc", "h", "w", "c", "data").mapInPandas(run, "particle long, doc long, pid long, toks array<array<double>>")


def generation_scores(bags: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(particle, score): mean nDCG of queries (qid, doc, toks), query i asking for page i among the pages of its document.

    A query has one relevant page, so its gain follows from how many pages are better: own scores by an equi-join, then a
    count that each task makes for itself before anything is shuffled. Nothing is sorted. Queries whose page is missing score 0."""
    q = queries.select("qid", "doc", F.col("toks").alias("q"))
    score = F.round(scoring.late_interaction(F.col("q"), F.col("toks")), 9)
    own = bags.join(q.select("qid", "q"), bags["pid"] == F.col("qid")).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("particle", score.alias("s")))).alias("own"))
    asked = q.join(own, "qid")  # an entry a particle
    scored = bags.join(asked, "doc").select("particle", "qid", "pid", score.alias("score"), F.col("own")[F.col("particle")].alias("mine"))
    better = (F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("pid") < F.col("qid")))
    ranks = scored.groupBy("particle", "qid").agg(F.count_if(better).alias("before"))
    gains = ranks.groupBy("particle").agg(F.sum(F.when(F.col("before") < k, metrics.gain(F.col("before") + 1)).otherwise(0.0)).alias("gain"))
    return gains.crossJoin(F.broadcast(q.agg(F.count("*").alias("n")))).select("particle", (F.col("gain") / F.col("n")).alias("score"))  # one row


def restoration_search(degraded: DataFrame, queries: DataFrame, encoder: Encoder, restoration: Restoration, swarm: Swarm, k: int = 5) -> tuple[np.ndarray, float]:
    """(best parameters, best score): all particles of a generation in one plan, from stored degraded images to a score each."""
    degraded, queries = stored(degraded, "degraded"), stored(queries, "queries")

    def objective(particles: np.ndarray) -> np.ndarray:
        before = set(held())
        bags = stored(restored_bags(degraded, particles, restoration, encoder), "bags")
        found = {r["particle"]: r["score"] for r in generation_scores(bags, queries, k).collect()}  # a row a particle
        release(degraded.sparkSession, [p for p in held() if p not in before])
        return np.array([found.get(i, 0.0) for i in range(len(particles))])

    return swarm.optimize_all(objective)


def restoration_objective(pages: DataFrame, queries: DataFrame, encoder: Encoder, std: float = 30.0, k: int = 5) -> Callable[[np.ndarray], float]:
    """Scores (h, sigma): mean nDCG of pages (image rows) that were given noise and restored by both filters, encoded and
    scored against bags of queries, query i belonging to page i. Parameters are held at h >= 1, sigma >= 0.1."""
    one = F.lit(0).cast("long")
    degraded = images.Pipeline([("gaussian_noise", {"std": std})], images.EVERY)(pages).withColumn("doc", one)
    asked = queries.withColumn("doc", one)

    def objective(params: np.ndarray) -> float:
        bags = restored_bags(degraded, np.array([params], float), Restoration(), encoder)
        return float(generation_scores(bags, asked, k).first()["score"])

    return objective


def encoded_images(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """(pid, toks) of image rows; the encoder gets (h, w, c) arrays."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(parts):
        for pdf in parts:
            arrays = [np.frombuffer(d, np.uint8).reshape(h, w, c) for h, w, c, d in zip(pdf["h"], pdf["w"], pdf["c"], pdf["data"])]
            yield pd.DataFrame({"pid": pdf["id"], "toks": [m.tolist() for m in shared.value.encode(arrays)]})

    return rows.mapInPandas(run, "pid long, toks array<array<double>>")
