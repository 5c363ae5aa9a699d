"""Quality by compression: which of two dictionaries compresses a text better.

One zstandard dictionary is trained on good labelled text, one on bad. A text is compressed block by block
with each; the difference of the two sizes over the text's own bytes is the raw score. Over the bytes and not over the
compressed sizes, since text that repeats itself shrinks to nothing with either, and a small difference of two small
sizes says little. A logistic curve fitted on labelled rows that the dictionaries have not seen makes a probability of
the raw score. Only the text enters.

The sample that fits the model is bounded: the ``most_docs`` labels of each class with the smallest hash, and for the
dictionaries at most ``most_blocks`` blocks of each text, spread evenly over the whole of it. The curve's rows are
measured whole, by the executors. Everything else covers all rows and whole texts.

Edge cases: null and empty text score as difference 0; very long texts are compressed whole, block after block; held-out
rows never teach; where a class has no labelled row, every score is the share of good labels (0.5 without labels);
rows that share a doc_id teach by one text, the least of them, once for each distinct label; ties of the sample's hash go
by doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.llm.common import held_out, is_held_out, map_rows, narrow

BLOCK = 1024
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: of the difference, and the constant
    weights: tuple[float, float]
    level: int = 3

    def measure(self):
        """Row function text -> difference of the compressed sizes over the text's bytes, positive for good text."""
        import zstandard

        def maker(data: bytes):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False).compress

        if not self.good or not self.bad:
            return lambda text: 0.0
        good, bad = maker(self.good), maker(self.bad)

        def measured(text: str | None) -> float:
            g = b = n = 0
            for at in range(0, len(text or ""), BLOCK):
                block = text[at : at + BLOCK].encode("utf-8", "surrogatepass")
                g += len(good(block))
                b += len(bad(block))
                n += len(block)
            return (b - g) / n if n else 0.0

        return measured

    def probability(self, difference: float) -> float:
        x = self.weights[0] * difference + self.weights[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(xs: list[float], ys: list[int], penalty: float = 1e-4) -> tuple[float, float]:
    """Slope and constant, by Newton steps."""
    import numpy as np

    raw, y = np.array(xs, float), np.array(ys, float)
    centre, scale = raw.mean(), max(raw.std(), 1e-9)
    x = np.column_stack([(raw - centre) / scale, np.ones(len(raw))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def blocks_of(text: str, most: int) -> list[bytes]:
    """At most ``most`` blocks, from the first to the last at even distances."""
    starts = range(0, len(text), BLOCK)
    if len(starts) > most:
        starts = [starts[i * (len(starts) - 1) // max(1, most - 1)] for i in range(most)]
    return [text[at : at + BLOCK].encode("utf-8", "surrogatepass") for at in starts]


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 2000, most_blocks: int = 32, dict_bytes: int = 64 * 1024) -> Model:
    """Dictionaries from three quarters of the sample, the curve from the rest."""
    import zstandard

    labels = narrow(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    labels = labels.withColumn("h", F.xxhash64("doc_id", F.lit("quality sample"))).distinct()
    first = [labels.where(F.col("quality") == q).orderBy("h", "doc_id").limit(most_docs) for q in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most 2 * most_docs ids, so no text but theirs is shuffled
    rows = narrow(docs, "doc_id", "text").where("text <> ''").join(chosen, "doc_id").groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text"))
    curve = F.pmod("h", F.lit(4)) == 0

    cut = F.udf(lambda text: blocks_of(text, most_blocks), "array<binary>")
    parts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for r in rows.where(~curve).select("quality", "h", "doc_id", cut("text").alias("blocks")).orderBy("h", "doc_id", "quality").collect():
        parts[r["quality"]].append([bytes(b) for b in r["blocks"]])
    held = {r["quality"]: r["n"] for r in rows.where(curve).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n = {q: len(parts[q]) + held.get(q, 0) for q in (0, 1)}
    if not all(parts.values()) or len(held) < 2 or min(n.values()) < 8:
        share = (n[1] + 1) / (n[0] + n[1] + 2) if n[0] + n[1] else 0.5
        return Model(b"", b"", (0.0, math.log(share / (1 - share))))

    def dictionary(samples: list[list[bytes]]) -> bytes:
        small = [b for s in samples for b in s]
        size = min(dict_bytes, max(1024, sum(map(len, small)) // 8))
        try:
            return zstandard.train_dictionary(size, small).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the samples themselves serve as raw content
            return b"".join(small)[-size:]

    model = Model(dictionary(parts[1]), dictionary(parts[0]), (0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        measured = shared.value.measure()
        return lambda quality, text: (quality, measured(text))

    measured = map_rows(rows.where(curve).select(F.col("quality").cast("int").alias("quality"), "text"), make, "quality int, difference double").collect()
    measured = sorted((r["difference"], r["quality"]) for r in measured)
    model.weights = logistic([x for x, _ in measured], [q for _, q in measured])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one scan with the broadcast dictionaries, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        measured = m.measure()

        def row(d, text):
            p = m.probability(measured(text))
            return d, is_held_out(d), p, int(p >= THRESHOLD)

        return row

    return map_rows(narrow(docs, "doc_id", "text"), make, "doc_id long, held_out boolean, score double, predicted int")
