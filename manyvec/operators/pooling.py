"""Token pooling: fewer vectors a page. Pages are rows (pid, toks), so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvec.functions import vectors as V


def ward_merges(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (left, right, height) of Ward's method by nearest-neighbour chains, lowest first; cluster n + i is
    made by merge i."""
    n = len(points)
    square = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) if n <= 256 else None
    if square is None:
        norms = (points**2).sum(axis=1)
        square = np.maximum(norms[:, None] + norms[None, :] - 2 * points @ points.T, 0)
    np.fill_diagonal(square, np.inf)
    size, alive, chain, raw = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            tip = chain[-1]
            nearest = int(np.argmin(square[tip]))
            if len(chain) > 1 and square[tip, chain[-2]] <= square[tip, nearest]:
                nearest = chain[-2]
                break
            chain.append(nearest)
        a, b = sorted((chain.pop(), chain.pop()))
        raw.append((a, b, float(np.sqrt(square[a, b]))))
        total = size[a] + size[b] + size
        merged = ((size[a] + size) * square[a] + (size[b] + size) * square[b] - size * square[a, b]) / total
        merged[[a, b]] = np.inf
        merged[~alive] = np.inf
        square[b], square[:, b] = merged, merged
        square[a], square[:, a] = np.inf, np.inf
        square[b, b] = np.inf
        size[b] += size[a]
        alive[a] = False
    made, top = [], list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    name = list(range(n))
    for k, (a, b, height) in enumerate(sorted(raw, key=lambda m: m[2])):
        ra, rb = find(a), find(b)
        made.append((*sorted((name[ra], name[rb])), height))
        top[ra] = rb
        name[rb] = n + k
    return made


def flat_clusters(merges: list[tuple[int, int, float]], n: int, most: int) -> np.ndarray:
    """Labels from 0 of at most ``most`` clusters, numbered as the tree is walked, left before right."""
    if n <= most:
        limit = -1.0
    else:
        heights = [m[2] for m in merges]
        limit = heights[n - most - 1]
    labels, stack, next_ = np.zeros(n, int), [2 * n - 2], 0

    def leaves(node: int):
        held = [node]
        while held:
            x = held.pop()
            if x < n:
                yield x
            else:
                held += merges[x - n][:2]

    while stack:
        node = stack.pop()
        if node < n or merges[node - n][2] <= limit:
            for leaf in leaves(node):
                labels[leaf] = next_
            next_ += 1
        else:
            left, right, _ = merges[node - n]
            stack += [right, left]
    return labels


def pool_page(toks: np.ndarray, factor: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Unit means of Ward clusters on the rows of the cosine distances; at most length // factor clusters."""
    n = len(toks)
    if n == 1:
        raise ValueError("a page must have more than one token")
    if factor == 1:
        return toks, {0: list(range(n))}
    most = max(n // factor, 1)
    labels = flat_clusters(ward_merges(1 - toks @ toks.T), n, most)
    clusters = {c: np.flatnonzero(labels == c).tolist() for c in range(most)}
    means = [toks[i].mean(axis=0) for i in clusters.values() if i]
    return np.array([m / max(np.linalg.norm(m), 1e-12) for m in means]), clusters


def hierarchical(pages: DataFrame, factor: int) -> DataFrame:
    """(pid, toks, clusters map<int, array<int>>)."""
    if factor < 1:
        raise ValueError("factor must be positive")

    def run(parts):
        for pdf in parts:
            made = [pool_page(np.array(t.tolist(), float), factor) for t in pdf["toks"]]
            yield pd.DataFrame({"pid": pdf["pid"], "toks": [m[0].tolist() for m in made], "clusters": [m[1] for m in made]})

    return pages.select("pid", "toks").mapInPandas(run, "pid long, toks array<array<double>>, clusters map<int, array<int>>")


def pooled_by(pages: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(pid, toks) with a user's function from one page's matrix to another."""

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"pid": pdf["pid"], "toks": [np.asarray(function(np.array(t.tolist(), float))).tolist() for t in pdf["toks"]]})

    return pages.select("pid", "toks").mapInPandas(run, "pid long, toks array<array<double>>")


def halved(toks: Column, unit: bool = False) -> Column:
    """Means of consecutive pairs; an odd last token stays."""
    starts = F.sequence(F.lit(1), F.size(toks), F.lit(2))
    means = F.transform(starts, lambda i: V.mean_tokens(F.slice(toks, i, F.least(F.lit(2), F.size(toks) - i + 1))))
    return F.transform(means, lambda v: V.l2_normalize(v)) if unit else means


def pool_embeddings(pages: DataFrame, factor: int = 1, padding: bool = False, side: str = "left", function=None, repad: bool = False) -> DataFrame:
    """Un-pads where asked, pools, and pads back to the longest page where asked. An empty table stays empty."""
    rows = pages.withColumn("toks", V.unpad(F.col("toks"), side)) if padding else pages
    out = pooled_by(rows, function) if function else hierarchical(rows, factor)
    if repad:
        longest = out.agg(F.max(F.size("toks")).alias("__to"))
        out = out.crossJoin(F.broadcast(longest))  # one row
        out = out.withColumn("toks", V.repad(F.col("toks"), F.col("__to"), F.size(F.col("toks")[0]), side)).drop("__to")
    return out
