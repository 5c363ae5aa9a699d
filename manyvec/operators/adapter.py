"""Residual embedding adapter: forward pass on executors, training on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.operators import blocks as B

SQRT2 = math.sqrt(2)
#: Tokens that an adapter takes at once on an executor, but for one page's.
TOKENS = 4096


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 1e-7 (a rational form of its complement)."""
    # fixed values: the published coefficients of the rational form
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + 0.5 * np.abs(x))
    p = np.zeros_like(t)
    for k in reversed(c):
        p = p * t + k
    return np.sign(x) * (1 - t * np.exp(-x * x + p))


@dataclass
class Adapter:
    """normalize(e + clamp(scale, 0, 0.5) * MLP(LayerNorm(e))), with a second layer that starts at zero."""

    dim: int
    hidden: int = 256
    scale: float = 0.1
    seed: int = 13
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            bound = math.sqrt(6 / (self.dim + self.hidden))
            self.weights = {
                "gain": np.ones(self.dim), "shift": np.zeros(self.dim),
                "w1": np.random.default_rng(self.seed).uniform(-bound, bound, (self.hidden, self.dim)), "b1": np.zeros(self.hidden),
                "w2": np.zeros((self.dim, self.hidden)), "b2": np.zeros(self.dim), "scale": np.array([float(self.scale)]),
            }

    def forward(self, e: np.ndarray, tape: dict | None = None) -> np.ndarray:
        if e.shape[-1] != self.dim:
            raise ValueError(f"expected dimension {self.dim}, got {e.shape[-1]}")
        w = self.weights
        centred = e - e.mean(axis=1, keepdims=True)
        spread = np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
        unit = centred / spread
        pre = (unit * w["gain"] + w["shift"]) @ w["w1"].T + w["b1"]
        cdf = 0.5 * (1 + _erf(pre / SQRT2))
        act = pre * cdf
        out = act @ w["w2"].T + w["b2"]
        s = float(np.clip(w["scale"][0], 0, 0.5))
        raw = e + s * out
        size = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        if tape is not None:
            tape.update(unit=unit, pre=pre, cdf=cdf, act=act, out=out, s=s, size=size, adapted=raw / size)
        return raw / size

    def backward(self, tape: dict, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights from that of the output."""
        w, a = self.weights, tape["adapted"]
        raw = (grad - a * (grad * a).sum(axis=1, keepdims=True)) / tape["size"]
        out = tape["s"] * raw
        act = out @ w["w2"]
        pre = act * (tape["cdf"] + tape["pre"] * np.exp(-tape["pre"] ** 2 / 2) / math.sqrt(2 * math.pi))
        normed = tape["unit"] * w["gain"] + w["shift"]
        back = pre @ w["w1"]
        inside = 0 <= w["scale"][0] <= 0.5
        return {
            "w2": out.T @ tape["act"], "b2": out.sum(axis=0), "w1": pre.T @ normed, "b1": pre.sum(axis=0), "gain": (back * tape["unit"]).sum(axis=0), "shift": back.sum(axis=0),
            "scale": np.array([(raw * tape["out"]).sum() if inside else 0.0]),
        }

    def apply(self, pages: DataFrame) -> DataFrame:
        """(pid, toks) adapted; the weights are broadcast, and their size is fixed by the two dimensions."""
        shared = pages.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("toks").value_lengths().fill_null(0).to_numpy()
                for a, b in B.runs(lengths, TOKENS):  # what is held grows with these, not with the batch
                    part = batch.slice(a, b - a)
                    sizes, vectors = B.stacked(part.column("toks"))
                    out = shared.value.forward(vectors) if len(vectors) else np.zeros((0, 0))
                    each = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                    bags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each, mask=part.column("toks").is_null())
                    yield pa.RecordBatch.from_arrays([part.column("pid"), bags], ["pid", "toks"])

        rows = pages.select(F.col("pid").cast("long").alias("pid"), F.col("toks").cast("array<array<double>>").alias("toks"))
        return rows.mapInArrow(run, "pid long, toks array<array<double>>")

    def to_json(self, **metrics) -> str:
        return json.dumps({"dim": self.dim, "hidden": self.hidden, "metrics": metrics, "weights": {k: v.tolist() for k, v in self.weights.items()}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Adapter:
        held = json.loads(text)
        return cls(held["dim"], held["hidden"], weights={k: np.array(v) for k, v in held["weights"].items()})


@dataclass
class Example:
    """A batch of queries with one variant of all pages: bags of vectors, teacher scores, relevant pages by query."""

    queries: list[np.ndarray]
    pages: list[np.ndarray]
    teacher: np.ndarray
    relevant: list[set[int]]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(adapter: Adapter, ex: Example, temperature: float = 0.07, weights: tuple[float, float, float] = (1.0, 0.5, 0.05)) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Weighted distillation, ranking and identity losses, and the gradient of their sum."""
    whole = np.concatenate(ex.pages)
    tape: dict = {}
    adapted = adapter.forward(whole, tape)
    cuts = np.cumsum([0] + [len(p) for p in ex.pages])
    scores, best = np.zeros((len(ex.queries), len(ex.pages))), {}
    for q, query in enumerate(ex.queries):
        sims = query @ adapted.T
        for p in range(len(ex.pages)):
            at = sims[:, cuts[p] : cuts[p + 1]].argmax(axis=1) + cuts[p]
            best[q, p] = at
            scores[q, p] = sims[np.arange(len(query)), at].sum()
    student, teacher = _softmax(scores / temperature), _softmax(ex.teacher / temperature)
    distill = float((teacher * (np.log(teacher + 1e-300) - np.log(student + 1e-300))).sum() / len(scores) * temperature**2)
    d_scores = weights[0] * (student - teacher) * temperature / len(scores)
    plain, rank, counted = _softmax(scores), 0.0, [q for q, r in enumerate(ex.relevant) if any(0 <= p < len(ex.pages) for p in r)]
    for q in counted:
        mine = sorted(p for p in ex.relevant[q] if 0 <= p < len(ex.pages))
        own = plain[q, mine].sum()
        rank -= math.log(max(own, 1e-300)) / len(counted)
        g = plain[q].copy()
        g[mine] -= plain[q, mine] / own
        d_scores[q] += weights[1] * g / len(counted)
    norms = np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
    cosines = (whole / norms * adapted).sum(axis=1)
    sizes = np.repeat(np.diff(cuts), np.diff(cuts))
    identity = float(1 - (cosines / sizes).sum() / len(ex.pages))
    grad = -weights[2] * whole / norms / sizes[:, None] / len(ex.pages)
    for (q, p), at in best.items():
        np.add.at(grad, at, d_scores[q, p] * ex.queries[q])
    parts = {"score_distill": distill, "qrels_rank": rank, "identity": identity}
    parts["total"] = sum(w * parts[n] for w, n in zip(weights, ("score_distill", "qrels_rank", "identity")))
    return parts, adapter.backward(tape, grad)


def train(adapter: Adapter, examples: list[Example], validate, epochs: int = 20, rate: float = 1e-3, decay: float = 0.01, patience: int = 5, seed: int = 13) -> tuple[Adapter, list[dict]]:
    """Adam with decoupled decay over shuffled examples; keeps the weights with the best ``validate(adapter)`` and stops
    after ``patience`` epochs without a better one. The examples are one driver's batches."""
    rng, step = np.random.default_rng(seed), 0
    first = {k: np.zeros_like(v) for k, v in adapter.weights.items()}
    second = {k: np.zeros_like(v) for k, v in adapter.weights.items()}
    best, best_epoch, best_weights, history = -math.inf, 0, None, []
    for epoch in range(1, epochs + 1):
        total = 0.0
        for i in rng.permutation(len(examples)):
            parts, grads = loss_and_gradient(adapter, examples[i])
            total += parts["total"]
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                adapter.weights[k] = adapter.weights[k] * (1 - rate * decay) - rate * move
        score = float(validate(adapter))
        history.append({"epoch": epoch, "loss": total / max(1, len(examples)), "score": score})
        if score > best:
            best, best_epoch, best_weights = score, epoch, {k: v.copy() for k, v in adapter.weights.items()}
        if epoch - best_epoch >= patience:
            break
    return Adapter(adapter.dim, adapter.hidden, weights=best_weights or adapter.weights), history


def evaluate_variants(adapter: Adapter, queries: DataFrame, qrels: DataFrame, variants: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(variant, adapted, ndcg, recall, mrr, n_queries, n_docs): raw and adapted pages of each variant."""
    from functools import reduce

    from pyspark.sql import functions as F

    from manyvec.operators import evaluation

    parts = []
    for name, pages in variants.items():
        for adapted in (False, True):
            means = evaluation.evaluate(queries, adapter.apply(pages) if adapted else pages, qrels, k)
            parts.append(means.withColumns({"variant": F.lit(name), "adapted": F.lit(adapted)}))
    return reduce(DataFrame.unionByName, parts)
