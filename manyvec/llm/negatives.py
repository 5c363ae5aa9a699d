"""Hard negatives by a pivot table.

Vectors are taken as integers, floor(256 x). A component more turns inner products into distances: a vector becomes
(x, sqrt(M^2 - |x|^2)) with M the largest length, an anchor (q, 0), so that |q - x|^2 = |q|^2 + M^2 - 2 q.x and the highest score is the
smallest distance. Each row's distances to a few pivots are stored with it. By the triangle inequality
max |d(q,p) - d(x,p)| <= d(q,x) <= min d(q,p) + d(x,p), which brackets the score of every row from the stored distances alone;
scores are computed exactly, as integers, only for rows whose bracket can still matter.

Plan: rows are laid down once as blocks of bounded size, filled by nearest pivot and then by a hash, so a label or a
cluster with a third of all rows is many blocks. Blocks of anchors are sent to every block of rows (the query set against
all rows, in blocks). First each meeting returns an anchor's best rows of its own label; the best of all meetings are the
positives. Then anchors go round with their positives' scores, and each meeting returns the best rows of other labels in each
positive's range. Windows with a limit merge the meetings.

Edge cases: rows with a null label, a null vector, or null or non-finite components (also after the scaling) take no part; an
empty vector scores 0 with another; vectors of different dimension are never compared; null vec_ids take no part; rows that
share a vec_id are anchors and candidates each by itself; ties go to the smaller vec_id, then to the row laid down first;
anchors without positives, and positives without rows in range, give no rows, as do empty tables; scores are exact whole
numbers, and one beyond a long counts as the largest or smallest long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from manyvec.llm.common import narrow
from manyvec.session import stored

SCALE = 256
#: Products and sums of whole numbers are exact in double precision below this.
EXACT = 2.0**53


LONGEST = 2**63 - 1
#: Vectors too long for doubles have no distances; what comes of it bounds nothing.
BOUNDLESS = np.errstate(over="ignore", invalid="ignore")


def usable(vectors: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, v, dim) of the rows that take part: components are whole numbers, held as doubles."""
    rows = narrow(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").withColumn("v", F.transform("v", lambda x: x * SCALE))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    moved = F.when(F.col("id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("id", moved.alias("label"), whole.alias("v"), F.size("v").alias("dim"))


def laid_down(v: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else as doubles."""
    return (v.astype("<i2") if len(v) and np.abs(v).max() < 2**15 else v.astype("<f8")).tobytes()


def taken_up(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * dim else "<f8").astype(float)


@dataclass
class Pivots:
    """Points (a row each, without the added component), that component, and the square of the largest length."""

    points: np.ndarray
    added: np.ndarray
    square: float

    @classmethod
    @BOUNDLESS
    def farthest(cls, sample: list[np.ndarray], square: float, n: int) -> Pivots:
        """The sample's first vector, then always the one farthest from those taken; shorter ones are padded with zeros."""
        wide = np.zeros((len(sample), max(map(len, sample))))
        for row, v in zip(wide, sample):
            row[: len(v)] = v
        everyone = cls(wide, np.sqrt(np.maximum(square - (wide * wide).sum(axis=1), 0)), square)
        taken, gap = [0], everyone.of_row(wide[0])
        while len(taken) < min(n, len(sample)) and gap.max() > 0:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, everyone.of_row(wide[taken[-1]]))
        return cls(wide[taken], everyone.added[taken], square)

    def inner(self, v: np.ndarray) -> np.ndarray:
        common = min(len(v), self.points.shape[1])
        return self.points[:, :common] @ v[:common]

    @BOUNDLESS
    def of_row(self, v: np.ndarray) -> np.ndarray:
        """Distances of a row: both ends have the length sqrt(square)."""
        added = math.sqrt(max(self.square - float(v @ v), 0))
        return np.sqrt(np.maximum(2 * self.square - 2 * (self.inner(v) + added * self.added), 0))

    @BOUNDLESS
    def of_anchor(self, q: np.ndarray) -> np.ndarray:
        """Distances of an anchor, whose added component is 0."""
        return np.sqrt(np.maximum(float(q @ q) + self.square - 2 * self.inner(q), 0))


def pivot_table(vectors: DataFrame, n_pivots: int, sample: int) -> tuple[DataFrame, Pivots] | None:
    """(row, id, label, dim, cell, v, near): each row with its distances to the pivots, laid down once; ``v`` is
    packed by ``laid_down``, ``near`` are doubles, ``cell`` is the nearest pivot. Pivots come from the ``sample`` rows with the smallest hash."""
    rows = usable(vectors)
    square = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"]
    if square is None:
        return None
    some = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(sample).select("v").collect()
    pivots = Pivots.farthest([np.array(r["v"], float) for r in some], square, n_pivots)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vs = [np.asarray(v, float) for v in pdf["v"]]
            near = [pivots.of_row(v) for v in vs]
            cells = [int(np.argmin(x)) if np.isfinite(x).all() else 0 for x in near]
            yield pdf.assign(cell=cells, v=[laid_down(v) for v in vs], near=[x.tobytes() for x in near])[["row", "id", "label", "dim", "cell", "v", "near"]]

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return stored(numbered.mapInPandas(run, "row long, id long, label long, dim int, cell int, v binary, near binary"), "pivots"), pivots


class Block:
    """Rows of one dimension with their pivot distances."""

    def __init__(self, pivots: Pivots, dim: int, rows: list[tuple]):
        self.pivots = pivots
        self.row, self.id, self.label = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.v = np.array([taken_up(r[3], dim) for r in rows]).reshape(len(rows), dim)
        self.near = np.ascontiguousarray(np.frombuffer(b"".join(r[4] for r in rows)).reshape(len(rows), -1).T)
        self.largest = float(np.abs(self.v).max(initial=0))
        self.of_label = {x: np.flatnonzero(self.label == x) for x in np.unique(self.label)}

    def bracket(self, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of the rows ``at``."""
        total = float(q @ q) + self.pivots.square
        far, close = np.full(len(at), np.inf), np.zeros(len(at))
        for own, stored_ones in zip(self.pivots.of_anchor(q), self.near):
            other = stored_ones[at]
            close, far = np.maximum(close, np.abs(own - other)), np.minimum(far, own + other)
        with np.errstate(invalid="ignore", over="ignore"):
            slack = 1e-9 * (total + 1)  # for rounding, here and in the stored distances
            low, high = (total - far * far) / 2 - slack, (total - close * close) / 2 + slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products, held at the limits of a long."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT:
            return (self.v[at] @ q).astype(np.int64)
        whole = [int(x) for x in q]
        sums = (sum(int(x) * y for x, y in zip(v, whole)) for v in self.v[at])
        return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in sums], np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places within ``at`` of the ``k`` first rows: by score, then id, then row."""
        some = np.arange(len(at))
        if len(at) > 4 * k:
            some = np.flatnonzero(scores >= np.partition(scores, len(at) - k)[len(at) - k])
        return some[np.lexsort((self.row[at[some]], self.id[at[some]], ~scores[some]))[:k]]  # ~ turns the order, within a long

    def positives(self, own: int, label: int, q: np.ndarray, k: int) -> Iterator[tuple]:
        """The ``k`` first rows of the label, but for the anchor's own."""
        at = self.of_label.get(label, np.zeros(0, np.int64))
        at = at[self.row[at] != own]
        low, high = self.bracket(q, at)
        if len(at) > k:
            likely = np.argpartition(-high, k - 1)[:k]
            surely = max(np.partition(low, len(low) - k)[len(low) - k], float(self.scores(q, at[likely]).min()))
            at = at[high >= surely]
        scores = self.scores(q, at)
        for i in self.first(at, scores, k):
            yield int(self.row[at[i]]), int(self.id[at[i]]), int(scores[i])

    def negatives(self, label: int, q: np.ndarray, found: list[tuple[int, int, int]], k: int, percent: tuple[int, int]) -> Iterator[tuple]:
        """For each positive (row, id, score) the ``k`` first rows of other labels in the range of its score."""
        ranges = [(-(-percent[0] * s // 100), percent[1] * s // 100) for _, _, s in found]
        at = np.flatnonzero(self.label != label)
        low, high = self.bracket(q, at)
        at = at[(high >= min(a for a, _ in ranges)) & (low <= max(b for _, b in ranges))]
        scores = self.scores(q, at)
        for (row, positive, score), (a, b) in zip(found, ranges):
            inside = np.flatnonzero((scores >= max(a, -LONGEST - 1)) & (scores <= min(b, LONGEST))) if a <= b else np.zeros(0, np.int64)
            for i in self.first(at[inside], scores[inside], k):
                j = inside[i]
                yield row, positive, score, int(self.row[at[j]]), int(self.id[at[j]]), int(scores[j])


def meetings(table: DataFrame, anchors: DataFrame, pivots: Pivots, block_rows: int, meet, schema: str) -> DataFrame:
    """Every anchor (row, id, label, dim, v, more) with every block of rows of its dimension: ``meet(block, anchor)`` gives
    result rows. A task reads a block and then streams the anchors past it."""
    number = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    counts = table.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    places = counts.groupBy("dim").agg(F.collect_list(F.struct("cell", "blocks")).alias("cells"))  # a row a dimension, an entry a pivot
    laid = table.join(counts, ["dim", "cell"]).select("dim", "cell", number(F.col("blocks")).alias("block"), F.lit(False).alias("asks"), "row", "id", "label", "v", "near", F.lit(None).cast("array<struct<row: bigint, id: bigint, score: bigint>>").alias("more"))
    asked = anchors.join(places, "dim").select("*", F.explode("cells").alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("block"))
    asked = asked.select("dim", F.col("c.cell").alias("cell"), "block", F.lit(True).alias("asks"), "row", "id", "label", "v", F.lit(None).cast("binary").alias("near"), "more")
    keys = ["dim", "cell", "block"]
    arranged = laid.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, block = None, [], None
        for pdf in parts:
            out = []
            for dim, cell, number, asks, row, id_, label, v, near, more in pdf.itertuples(index=False, name=None):
                if (dim, cell, number) != now:
                    now, rows, block = (dim, cell, number), [], None
                if not asks:
                    rows.append((row, id_, label, v, near))
                    continue
                if block is None:
                    block, rows = Block(pivots, dim, rows), []
                out += meet(block, (row, id_, label, taken_up(v, dim), more))
            yield pd.DataFrame(out, columns=names).astype("int64")

    return arranged.mapInPandas(run, schema)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, percent: tuple[int, int] = (80, 100), n_pivots: int = 8, sample: int = 2000, block_rows: int = 32_768) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    ``every`` and each of its first ``positives`` rows of the same label, the first ``k`` rows of other labels whose score is
    within ``percent`` of the positive's. Memory of a task: a block of ``block_rows`` rows."""
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = pivot_table(vectors, n_pivots, sample)
    if made is None:
        return vectors.sparkSession.createDataFrame([], result)
    table, pivots = made
    anchors = table.where(F.col("id") % every == 0).select("row", "id", "label", "dim", "v")

    def own_label(block: Block, anchor) -> list[tuple]:
        row, id_, label, q, _ = anchor
        return [(row, *found) for found in block.positives(row, label, q, positives)]

    def other_labels(block: Block, anchor) -> list[tuple]:
        row, id_, label, q, more = anchor
        return [(row, id_, *found) for found in block.negatives(label, q, [(m["row"], m["id"], m["score"]) for m in more], k, percent)]

    found = meetings(table, anchors.withColumn("more", F.lit(None).cast("array<struct<row: bigint, id: bigint, score: bigint>>")), pivots, block_rows, own_label, "row long, other long, other_id long, score long")
    best = W.partitionBy("row").orderBy(F.desc("score"), "other_id", "other")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    found = found.groupBy("row").agg(F.collect_list(F.struct(F.col("other").alias("row"), F.col("other_id").alias("id"), "score")).alias("more"))
    found = stored(anchors.join(found, "row"), "positives")
    mined = meetings(table, found, pivots, block_rows, other_labels, "row long, anchor_id long, other long, positive_id long, positive_score long, negative long, negative_id long, negative_score long")
    best = W.partitionBy("row", "other").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = mined.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
