"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.session import stored

#: Edges that one pass of ``forest`` holds at a time.
MOST_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by an edge from each node to the smallest one it reaches over these edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x < y:  # nodes are numbered in their order
            top[y] = x
        else:
            top[x] = y
    roots = np.array(top, np.int64)
    while len(roots) and (roots[roots] != roots).any():
        roots = roots[roots]
    some = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[some], nodes[roots[some]]


def _forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task as forests, ``MOST_EDGES`` at a time: as many edges or fewer, and nearly all chains gone."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= MOST_EDGES:
            a, b = forest(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b")))
            made = pd.DataFrame({"a": a, "b": b})
            held = [made]
            if len(made) > MOST_EDGES // 2:  # what doesn't shrink is handed on
                yield made
                held = []
    if held:
        a, b = forest(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b")))
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Each task first joins what its own edges join. Then large-star and small-star steps alternate: each node hands its
    larger neighbours, then itself and its smaller ones, to its smallest neighbour. Minima are pre-aggregated, and
    a hub's rows are joined rather than gathered, so no task holds a node's neighbours."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links.mapInPandas(_forests, "a long, b long").distinct(), "links")
    for _ in range(rounds):
        # stars only: every larger end has one smaller end, and no smaller end is itself a larger one
        ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)).distinct())
        if not ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        links = stored(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
