"""Training the adapter where the pages are.

A step takes a batch of query groups and one variant of all pages. Its loss compares each query's scores over all pages, so a
step is two passes over the pages. The first gives, for each query of the batch, the sums its softmaxes need, merged from
partial sums of every task like log-sum-exps. The second, with these sums broadcast (a row a query of the batch), gives each
task's part of the gradient of the weights; parts are added up in two levels of FAN_IN each, so no task holds more arrays
than that and the driver gets one for every FAN_IN squared tasks. The driver holds weights and optimiser state, whose size
is fixed by the adapter, and the batch's queries, whose bytes are measured before they are broadcast. The batch's relevant
pairs reach the pages by a broadcast join while they measure little; only beyond that do pages move.

Groups and variants are taken in an order seeded by epoch: groups by numbered hashes, so their list stays in a table. After
each epoch the adapter is scored on held-out groups and variants, and weights, optimiser state and history are written as one
row to the checkpoint table; training goes on from the last row found there, so a lost driver costs one epoch.

Tables: pages (pid, clean, toks, variant), queries (qid, group, toks), relevant (qid, pid). Pages and queries without tokens
take no part; relevant pairs of unknown pages or queries are left out; a query without relevant pages has no ranking loss; an
empty batch has no step."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.operators import blocks as B
from manyvec.operators import evaluation, prefix, scoring
from manyvec.operators.adapter import TOKENS, Adapter
from manyvec.session import held, release, stored

#: The sums of a query: maxima and sums relative to them, of teacher and student at the temperature, of the plain student
#: scores, and of those of relevant pages; ``cross`` is the sum of teacher weight times (teacher - student) / temperature.
SUMS = "qid long, n_rel long, m_t double, s_t double, cross double, m_s double, s_s double, m_p double, s_p double, m_r double, s_r double"
NAMES = [c.split()[0] for c in SUMS.split(", ")]
FAN_IN = 64
GRADIENT = "part int, n_pages long, identity double, gradient binary"


@dataclass
class Settings:
    """Temperature of the softmaxes, weights of distillation, ranking and identity loss, and the optimiser's numbers."""

    temperature: float = 0.07
    weights: tuple[float, float, float] = (1.0, 0.5, 0.05)
    rate: float = 1e-3
    decay: float = 0.01
    groups_a_batch: int = 4
    epochs: int = 20
    patience: int = 5
    seed: int = 13
    k: int = 5


@dataclass
class Batch:
    """The queries of one step: numbers, token counts, tokens."""

    qids: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, queries: DataFrame) -> Batch:
        """Collected after its bytes are measured."""
        queries = queries.where(F.size("toks") > 0)
        if (held := scoring.measured_bytes(queries.select("qid", "toks"))) > scoring.BROADCAST_BYTES:
            raise ValueError(f"a batch of {held} bytes of queries is too large to broadcast; take fewer groups")
        rows = queries.select("qid", "toks").orderBy("qid").collect()
        toks = [np.array(r["toks"], float) for r in rows]
        return cls(np.array([r["qid"] for r in rows], np.int64), np.array([len(t) for t in toks], np.int64), np.concatenate(toks) if toks else np.zeros((0, 0)))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def scores(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the queries (rows) over pages (columns) whose tokens begin at ``starts``."""
        return np.add.reduceat(np.maximum.reduceat(self.tokens @ tokens.T, starts, axis=1), self.starts, axis=0)

    def liked(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, the token of each page that each query token likes best)."""
        sims, ends = self.tokens @ tokens.T, [*starts[1:], len(tokens)]
        best = np.stack([sims[:, a:b].argmax(axis=1) + a for a, b in zip(starts, ends)], axis=1)
        return np.add.reduceat(np.take_along_axis(sims, best, axis=1), self.starts, axis=0), best


#: Similarities that a task holds at once.
HELD = 2_000_000


@dataclass
class Lot:
    """Some pages: clean tokens and tokens, each with where its pages begin, and by query which pages answer it."""

    clean: np.ndarray
    clean_starts: np.ndarray
    toks: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    own: np.ndarray


def _lots(rows: pa.RecordBatch, batch: Batch) -> Iterator[Lot]:
    """Pages some at a time, so what is held does not grow with their number."""
    most = min(TOKENS, max(1, HELD // max(1, len(batch.tokens))))
    longest = np.maximum(*(rows.column(c).value_lengths().fill_null(0).to_numpy() for c in ("clean", "toks")))
    for a, b in B.runs(longest, most):
        part = rows.slice(a, b - a)
        (clean_sizes, clean), (sizes, toks) = B.stacked(part.column("clean")), B.stacked(part.column("toks"))
        own = np.zeros((len(batch.qids), b - a), bool)
        for i, answers in enumerate(part.column("rel").to_pylist()):
            if answers:
                own[:, i] = np.isin(batch.qids, answers)
        yield Lot(clean, np.cumsum(clean_sizes) - clean_sizes, toks, np.cumsum(sizes) - sizes, sizes, own)


#: Maxima and the sums that are relative to each.
TOPS = (("m_t", ("s_t", "cross")), ("m_s", ("s_s",)), ("m_p", ("s_p",)), ("m_r", ("s_r",)))


def added(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Partial sums of the same queries as one, as ``merged`` has them."""
    out = {"n_rel": one["n_rel"] + two["n_rel"]}
    for m, sums in TOPS:
        out[m] = np.maximum(one[m], two[m])
        with np.errstate(invalid="ignore"):
            weights = [np.where(np.isneginf(x[m]), 0.0, np.exp(x[m] - out[m])) for x in (one, two)]
        out |= {s: one[s] * weights[0] + two[s] * weights[1] for s in sums}
    return out


def merged(parts: pd.DataFrame) -> dict[str, float]:
    """Partial sums of one query as one: sums are taken relative to the common maximum."""
    out = {"n_rel": int(parts["n_rel"].sum())}
    for m, sums in TOPS:
        top = parts[m].max()
        with np.errstate(invalid="ignore"):
            weight = np.where(np.isneginf(parts[m]), 0.0, np.exp(parts[m] - top))
        out |= {m: float(top)} | {s: float((parts[s] * weight).sum()) for s in sums}
    return out


def with_relevant(pages: DataFrame, relevant: DataFrame, batch: Batch) -> DataFrame:
    """Pages with the queries of the batch they answer, at most the whole batch a page."""
    of_batch = relevant.where(F.col("qid").isin(batch.qids.tolist())).groupBy("pid").agg(F.collect_set("qid").alias("rel"))
    if scoring.measured_bytes(of_batch) <= scoring.BROADCAST_BYTES:
        of_batch = F.broadcast(of_batch)
    return pages.join(of_batch, "pid", "left").select("clean", "toks", "rel")


def softmax_sums(rows: DataFrame, adapter: Adapter, batch: Batch, settings: Settings) -> list[dict]:
    """The sums of each query of the batch over all pages."""
    shared = rows.sparkSession.sparkContext.broadcast((adapter, batch))
    t = settings.temperature

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter, batch = shared.value
        total = None
        for rows in parts:
            for lot in _lots(rows, batch):
                scored = batch.scores(adapter.forward(lot.toks), lot.starts)
                sums = {n: x.to_numpy() for n, x in sums_of(batch.scores(lot.clean, lot.clean_starts).T, scored.T, lot.own.T, t).items()}
                total = sums if total is None else added(total, sums)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(batch.qids), *[pa.array(total[n]) for n in NAMES[1:]]], NAMES)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"qid": pdf["qid"].iloc[0]} | merged(pdf)], columns=NAMES)

    # a row a task meets here for each query; the driver gets one
    found = [r.asDict() for r in rows.mapInArrow(partial, SUMS).groupBy("qid").applyInPandas(merge, SUMS).collect()]
    shared.unpersist()
    return found


def sums_of(taught: np.ndarray, scored: np.ndarray, own: np.ndarray, t: float) -> pd.DataFrame:
    """Sums over the rows (pages) of scores by pages and queries."""
    held = {"n_rel": own.sum(axis=0)}
    weight = np.exp(taught / t - (top := taught.max(axis=0) / t))
    held |= {"m_t": top, "s_t": weight.sum(axis=0), "cross": (weight * (taught - scored) / t).sum(axis=0)}
    for m, s, x in (("m_s", "s_s", scored / t), ("m_p", "s_p", scored), ("m_r", "s_r", np.where(own, scored, -np.inf))):
        top = x.max(axis=0)
        with np.errstate(invalid="ignore"):
            held |= {m: top, s: np.where(np.isneginf(top), 0.0, np.exp(x - top).sum(axis=0))}
    return pd.DataFrame(held)


def losses(sums: list[dict], settings: Settings) -> dict[str, float]:
    """Distillation and ranking loss of the batch."""
    t = settings.temperature
    distill = sum(s["cross"] / s["s_t"] - (s["m_t"] + math.log(s["s_t"])) + s["m_s"] + math.log(s["s_s"]) for s in sums) / len(sums) * t**2
    ranked = [s for s in sums if s["n_rel"]]
    rank = sum(s["m_p"] + math.log(s["s_p"]) - s["m_r"] - math.log(max(s["s_r"], 1e-300)) for s in ranked) / max(1, len(ranked))
    return {"score_distill": distill, "qrels_rank": rank}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradient(rows: DataFrame, adapter: Adapter, batch: Batch, sums: list[dict], n_pages: int, settings: Settings) -> tuple[np.ndarray, float]:
    """(gradient of the weights, identity loss) of the batch's total loss over all pages."""
    by_qid = {s["qid"]: s for s in sums}
    sums = {n: np.array([by_qid[q][n] for q in batch.qids]) for n in NAMES[1:]}
    shared = rows.sparkSession.sparkContext.broadcast((adapter, batch, sums))
    t, (w_distill, w_rank, w_identity) = settings.temperature, settings.weights
    counted = max(1, int((sums["n_rel"] > 0).sum()))

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        adapter, batch, s = shared.value
        total, identity, n = None, 0.0, 0
        of_query = lambda name: s[name][:, None]
        for rows in parts:
            for lot in _lots(rows, batch):
                tape: dict = {}
                adapted = adapter.forward(lot.toks, tape)
                taught, (scored, best) = batch.scores(lot.clean, lot.clean_starts), batch.liked(adapted, lot.starts)
                student, teacher = np.exp(scored / t - of_query("m_s")) / of_query("s_s"), np.exp(taught / t - of_query("m_t")) / of_query("s_t")
                plain = np.exp(scored - of_query("m_p")) / of_query("s_p")
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    mine = np.where(lot.own, np.exp(scored - of_query("m_r")) / of_query("s_r"), 0.0)
                d = w_distill * (student - teacher) * t / len(batch.qids) + w_rank * np.where(of_query("n_rel") > 0, plain - mine, 0.0) / counted
                norms = np.maximum(np.linalg.norm(lot.toks, axis=1, keepdims=True), 1e-12)
                share = 1 / np.repeat(lot.sizes, lot.sizes)
                pull = np.zeros((len(batch.tokens), len(adapted)))  # a query token pulls one token of each page
                np.put_along_axis(pull, best, np.repeat(d, batch.sizes, axis=0), axis=1)
                part = flat(adapter.backward(tape, pull.T @ batch.tokens - w_identity * lot.toks / norms * share[:, None] / n_pages))
                total = part if total is None else total + part
                identity += float(((lot.toks / norms * adapted).sum(axis=1) * share).sum())
                n += len(lot.sizes)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([identity]), pa.array([total.tobytes()], pa.binary())], ["part", "n_pages", "identity", "gradient"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g) for g in pdf.sort_values("part")["gradient"])
        return pd.DataFrame([(int(pdf["part"].min()) // FAN_IN, int(pdf["n_pages"].sum()), float(pdf["identity"].sum()), total.tobytes())], columns=["part", "n_pages", "identity", "gradient"])

    parts = rows.mapInArrow(partial, GRADIENT)
    for _ in range(2):
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(add, GRADIENT)
    found = parts.collect()
    shared.unpersist()
    return sum(np.frombuffer(r["gradient"]) for r in sorted(found, key=lambda r: r["part"])), 1 - sum(r["identity"] for r in found) / n_pages


def step(pages: DataFrame, relevant: DataFrame, batch: Batch, adapter: Adapter, n_pages: int, settings: Settings) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Losses of the batch over all pages, and the gradient of their weighted sum."""
    rows = with_relevant(pages, relevant, batch)
    sums = softmax_sums(rows, adapter, batch, settings)
    parts = losses(sums, settings)
    grad, parts["identity"] = gradient(rows, adapter, batch, sums, n_pages, settings)
    parts["total"] = sum(w * parts[n] for w, n in zip(settings.weights, ("score_distill", "qrels_rank", "identity")))
    return parts, unflat(grad, adapter.weights)


@dataclass
class State:
    """What training needs to go on: current and best weights, moments of the optimiser, and the history."""

    adapter: Adapter
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    best: float = -math.inf
    best_epoch: int = 0
    best_weights: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    @classmethod
    def new(cls, adapter: Adapter) -> State:
        n = flat(adapter.weights).size
        return cls(adapter, np.zeros(n), np.zeros(n))

    def move(self, grad: dict[str, np.ndarray], settings: Settings) -> None:
        """One step of Adam with decoupled decay."""
        g, w = flat(grad), flat(self.adapter.weights)
        self.steps += 1
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        move = self.first / (1 - 0.9**self.steps) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
        self.adapter.weights = unflat(w * (1 - settings.rate * settings.decay) - settings.rate * move, self.adapter.weights)

    def ended(self, losses: dict[str, float], score: float) -> None:
        """Notes an epoch."""
        self.epoch += 1
        self.history.append({"epoch": self.epoch, "score": score} | losses)
        if score > self.best:
            self.best, self.best_epoch, self.best_weights = score, self.epoch, flat(self.adapter.weights)

    def trained(self) -> Adapter:
        held = flat(self.adapter.weights) if self.best_weights is None else self.best_weights
        return Adapter(self.adapter.dim, self.adapter.hidden, weights=unflat(held, self.adapter.weights))

    def row(self) -> tuple:
        numbers = {"steps": self.steps, "best": self.best, "best_epoch": self.best_epoch, "history": self.history, "dim": self.adapter.dim, "hidden": self.adapter.hidden}
        arrays = [flat(self.adapter.weights), self.first, self.second, flat(self.adapter.weights) if self.best_weights is None else self.best_weights]
        return (self.epoch, json.dumps(numbers), *[bytearray(a.tobytes()) for a in arrays])

    @classmethod
    def of_row(cls, row) -> State:
        numbers = json.loads(row["numbers"])
        adapter = Adapter(numbers["dim"], numbers["hidden"])
        adapter.weights = unflat(np.frombuffer(row["weights"]).copy(), adapter.weights)
        return cls(adapter, np.frombuffer(row["first"]), np.frombuffer(row["second"]), numbers["steps"], row["epoch"], numbers["best"], numbers["best_epoch"], np.frombuffer(row["best_weights"]), numbers["history"])


CHECKPOINT = "epoch long, numbers string, weights binary, first binary, second binary, best_weights binary"


def save(state: State, pages: DataFrame, path: str) -> None:
    """One more row of the checkpoint table."""
    pages.sparkSession.createDataFrame([state.row()], CHECKPOINT).coalesce(1).write.mode("append").parquet(path)


def resumed(pages: DataFrame, path: str | None) -> State | None:
    """The last epoch of the checkpoint table, if there is one."""
    spark = pages.sparkSession
    if path is None:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.schema(CHECKPOINT).parquet(path).orderBy(F.desc("epoch")).first()
    return None if row is None else State.of_row(row)


def batches(queries: DataFrame, settings: Settings, epoch: int) -> tuple[DataFrame, int]:
    """(qid, toks, batch) with the groups in the epoch's order, and the number of batches."""
    groups = queries.select("group").distinct().withColumn("__h", F.xxhash64("group", F.lit(settings.seed), F.lit(epoch)).cast("double"))
    dealt = prefix.numbered(groups, "__h", "__n", "group").select("group", ((F.col("__n") - 1) / settings.groups_a_batch).cast("long").alias("batch"))
    rows = stored(queries.join(dealt, "group").select("qid", "toks", "batch"), "batches")
    n = rows.agg(F.max("batch").alias("n")).first()["n"]
    return rows, 0 if n is None else n + 1


def ordered(names: list[str], settings: Settings, epoch: int) -> list[str]:
    return [names[i] for i in np.random.default_rng([settings.seed, epoch]).permutation(len(names))]


def validated(adapter: Adapter, queries: DataFrame, relevant: DataFrame, pages: DataFrame, variants: list[str], settings: Settings) -> float:
    """Mean over variants of the mean nDCG of adapted pages."""
    found = [evaluation.evaluate(queries, adapter.apply(pages.where(F.col("variant") == v)), relevant, settings.k).first()["ndcg"] for v in variants]
    return float(np.mean([x or 0.0 for x in found])) if found else 0.0


def train(pages: DataFrame, queries: DataFrame, relevant: DataFrame, held_out: DataFrame, held_pages: DataFrame, adapter: Adapter, settings: Settings = Settings(), checkpoint: str | None = None) -> State:
    """Epochs over all variants and batches until ``patience`` epochs bring no better score on ``held_out`` queries over
    ``held_pages``. Variants are few and named; groups and queries stay in tables."""
    state = resumed(pages, checkpoint) or State.new(adapter)
    pages = pages.where((F.size("toks") > 0) & (F.size("clean") > 0))
    counts = {r["variant"]: r["n"] for r in pages.groupBy("variant").agg(F.count("*").alias("n")).collect()}  # a row a variant
    held_variants = sorted(r["variant"] for r in held_pages.select("variant").distinct().collect())
    while state.epoch < settings.epochs and state.epoch - state.best_epoch < settings.patience:
        totals, steps = dict.fromkeys(("total", "score_distill", "qrels_rank", "identity"), 0.0), 0
        before = set(held())
        dealt, n = batches(queries, settings, state.epoch + 1)
        for variant in ordered(sorted(counts), settings, state.epoch + 1):
            of_variant = pages.where(F.col("variant") == variant)
            for b in range(n):
                batch = Batch.of(dealt.where(F.col("batch") == b))
                if len(batch.qids):
                    parts, grads = step(of_variant, relevant, batch, state.adapter, counts[variant], settings)
                    state.move(grads, settings)
                    totals, steps = {k: v + parts[k] for k, v in totals.items()}, steps + 1
        release(pages.sparkSession, [p for p in held() if p not in before])
        score = validated(state.adapter, held_out, relevant, held_pages, held_variants, settings)
        state.ended({k: v / max(1, steps) for k, v in totals.items()}, score)
        if checkpoint is not None:
            save(state, pages, checkpoint)
    return state
