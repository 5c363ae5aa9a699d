"""Retrieval metrics straight from queries, documents and relevance, every pair scored once and no ranking sorted.

For a query the metrics need its k best documents and the place of its first relevant one. Blocks of queries meet chunks of
documents twice. First a chunk scores the relevant pairs alone, of which its documents carry the query numbers, and sends each
query's best one. Then it scores all, and sends, for each query, its k best and how many of its documents come before the best
relevant one. So a query and chunk move k + 1 rows however many pairs there are, a place is a sum, and no vector is moved for
a pair.

Relevance is a table of pairs (qid, pid), or ``Shared``: queries and documents that have a mark in common. Then a document
carries its marks only, and pairs that are relevant are never rows, however many they are.

Scores are rounded to nine digits, ties go to the smaller pid. Queries and documents without tokens are scored with nothing: such
queries have no metrics, such documents no place. Relevant pairs of documents that are not there count for ``n_rel`` alone, as in
``metrics.per_query``; a query without relevant documents scores 0."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.operators import blocks as B
from manyvec.operators import metrics, scoring
from manyvec.session import stored

FOUND = "setting long, qid long, pid long, score double, before long, rel boolean"
CHUNK, BLOCK = 2048, 256


@dataclass(frozen=True)
class Shared:
    """A query (qid, mark: one each) is answered by all documents (pid, mark: any number) of its mark; null is no mark."""

    queries: DataFrame
    docs: DataFrame

    def marked_queries(self, queries: DataFrame) -> DataFrame:
        own = self.queries.select("qid", F.col("mark").cast("long").alias("mark"))
        return queries.join(scoring.small(own), "qid", "left")

    def marked_docs(self, docs: DataFrame) -> DataFrame:
        own = self.docs.where("mark IS NOT NULL").groupBy("pid").agg(F.collect_set(F.col("mark").cast("long")).alias("marks"))
        return docs.join(scoring.small(own), "pid", "left")

    def sizes(self) -> DataFrame:
        """(qid, n_rel): counted by mark, not by pair."""
        n = self.docs.where("mark IS NOT NULL").select("pid", "mark").distinct().groupBy("mark").agg(F.count("*").alias("n_rel"))
        return self.queries.join(scoring.small(n), "mark").select("qid", "n_rel")


@dataclass(frozen=True)
class Pairs:
    """Relevance by pairs (qid, pid): a query's mark is its own number."""

    rows: DataFrame

    def marked_queries(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("mark", F.col("qid").cast("long"))

    def marked_docs(self, docs: DataFrame) -> DataFrame:
        """Numbers alone are moved, or broadcast while they measure little."""
        by = self.rows.select("qid", "pid").distinct().groupBy("pid").agg(F.collect_list(F.col("qid").cast("long")).alias("marks"))
        return docs.join(scoring.small(by), "pid", "left")

    def sizes(self) -> DataFrame:
        return self.rows.select("qid", "pid").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))


def relevance(qrels: DataFrame | Shared | Pairs) -> Shared | Pairs:
    return qrels if isinstance(qrels, (Shared, Pairs)) else Pairs(qrels)


def by_mark(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(queries, documents) of each mark that a block and a chunk share, as places in them."""
    lists = row["dmarks"]
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    marks, docs = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)
    known = row["qmark"].is_valid().to_numpy(zero_copy_only=False)
    asked, places = row["qmark"].fill_null(0).to_numpy(zero_copy_only=False)[known], np.flatnonzero(known)
    both = np.isin(marks, asked)
    marks, docs = marks[both], docs[both]
    order = np.argsort(marks, kind="stable")
    each, begins = np.unique(marks[order], return_index=True)
    ends = [*begins[1:], len(order)]
    asked_order = np.argsort(asked, kind="stable")
    first, last = np.searchsorted(asked[asked_order], each, "left"), np.searchsorted(asked[asked_order], each, "right")
    return [(places[asked_order[p:q]], docs[order[a:b]]) for p, q, a, b in zip(first, last, begins, ends)]


class Best:
    """The ``k`` best rows of each setting and query among those added, and sums of their numbers of documents before. What is
    held are these and at most LOOSE rows more, so neither a task's chunks nor their queries are sorted by Spark."""

    LOOSE = 1 << 18

    def __init__(self, k: int):
        self.k, self.rows, self.counts, self.loose = k, [], [], 0

    def add(self, setting, qids: np.ndarray, pids: np.ndarray, scores: np.ndarray, rel: np.ndarray) -> None:
        self._put(self.rows, np.broadcast_to(setting, len(qids)), qids, pids, scores, rel)

    def count(self, setting, qids: np.ndarray, before: np.ndarray, known: np.ndarray) -> None:
        self._put(self.counts, np.broadcast_to(setting, len(qids)), qids, before, known)

    def _put(self, to: list, *columns: np.ndarray) -> None:
        to.append(columns)
        self.loose += len(columns[0])
        if self.loose > self.LOOSE:
            self._shrink()

    @staticmethod
    def _sorted(lots: list, *by: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns in order of setting, query and the columns ``by`` (descending where below 0), and where each query begins."""
        columns = [np.concatenate(c) for c in zip(*lots)]
        keys = [columns[c] if c > 0 else -columns[-c] for c in by]
        order = np.lexsort((*reversed(keys), columns[1], columns[0]))
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)
        return columns, np.flatnonzero(new)

    def _shrink(self) -> None:
        if self.rows:
            columns, begins = self._sorted(self.rows, -3, 2)
            keep = np.arange(len(columns[0])) - np.repeat(begins, np.diff([*begins, len(columns[0])])) < self.k
            self.rows = [tuple(c[keep] for c in columns)]
        if self.counts:
            columns, begins = self._sorted(self.counts)
            if len(begins):
                self.counts = [(columns[0][begins], columns[1][begins], np.add.reduceat(columns[2], begins), np.logical_or.reduceat(columns[3], begins))]
        self.loose = 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        self._shrink()
        for setting, qids, pids, scores, rel in self.rows:
            none = pa.nulls(len(qids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(setting, pa.int64()), pa.array(qids), pa.array(pids), pa.array(scores), none, pa.array(rel)], names)
        for setting, qids, before, known in self.counts:
            none = [pa.nulls(len(qids), kind) for kind in (pa.int64(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(setting, pa.int64()), pa.array(qids), *none[:2], pa.array(before, mask=~known), none[2]], names)


def whole(parts: DataFrame, k: int) -> DataFrame:
    """What tasks found as one: the k best of each setting and query, and one row with how many are before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            found = batch.column("pid").is_valid()
            rows, counts = batch.filter(found), batch.filter(pa.compute.invert(found))
            of = lambda b, c, none: b.column(c).fill_null(none).to_numpy(zero_copy_only=False)
            best.add(of(rows, "setting", 0), of(rows, "qid", 0), of(rows, "pid", 0), of(rows, "score", 0.0), of(rows, "rel", False))
            best.count(of(counts, "setting", 0), of(counts, "qid", 0), of(counts, "before", 0), counts.column("before").is_valid().to_numpy(zero_copy_only=False))
        yield from best.batches()

    return parts.repartition("qid").mapInArrow(run, FOUND)


def _scores(tokens: np.ndarray, lengths: np.ndarray, bags: B.Bags, settings: list[dict]) -> list[np.ndarray]:
    return [np.round(s, 9) for s in B.scores(tokens, lengths, bags, settings)]


def best_relevant(blocks: DataFrame, chunks: DataFrame, settings: list[dict]) -> DataFrame:
    """(qid, best, best_pids): by setting, the score and pid of each query's relevant document that comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(1)
        for row in B.met(batches):
            m = B.Met(row)
            if not m.fit:
                continue
            qids = row["qkeys"].to_numpy(zero_copy_only=False)
            pids, starts, ends = row["dkeys"].to_numpy(zero_copy_only=False), np.cumsum(m.sizes) - m.sizes, np.cumsum(m.lengths)
            docs_of, asked = np.frombuffer(row["dvectors"]).reshape(-1, m.dim), np.frombuffer(row["qvectors"]).reshape(-1, m.qdim)
            for queries, docs in by_mark(row):
                n = m.sizes[docs]
                bags = B.Bags(n, docs_of[np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                own = pids[docs][bags.order]
                for a, b in B.parts_of(m.lengths[queries], len(bags.vectors)):
                    of = queries[a:b]
                    tokens = np.concatenate([asked[ends[i] - m.lengths[i] : ends[i]] for i in of])
                    for setting, s in enumerate(_scores(tokens, m.lengths[of], bags, settings)):
                        top = s.max(axis=1)
                        first = np.where(s == top[:, None], own[None, :], np.iinfo(np.int64).max).min(axis=1)
                        best.add(setting, qids[of], first, top, np.ones(len(of), bool))
        yield from best.batches()

    best = whole(scoring.pairs(blocks, chunks).mapInArrow(run, FOUND), 1)
    of = lambda c: F.array(*[F.max(F.when(F.col("setting") == i, F.col(c))) for i in range(len(settings))])
    return best.groupBy("qid").agg(of("score").alias("best"), of("pid").alias("best_pids"))


#: Share of pairs above which all are reduced at once, and what a score may exceed its bound by in computing and rounding.
MANY, SLACK = 0.25, 1e-8
#: Reductions that are at most the maximum.
BOUNDED = ("topk_mean", "smoothmax")


def paired(sims: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray, options: dict) -> np.ndarray:
    """Scores of the pairs of query ``i`` and bag ``j`` alone, from similarities by size of the bags."""
    out, begin = np.zeros(len(i)), 0
    for group in sims:
        n = group.shape[2]
        mine = np.flatnonzero((j >= begin) & (j < begin + n))
        at, bag = i[mine], j[mine] - begin
        for t in range(int(lengths.max(initial=0))):
            has = lengths[at] > t
            out[mine[has]] += B.reduced(group[starts[at[has]] + t, :, bag[has]][:, :, None], **options)[:, 0]
        begin += n
    return out


def places(queries: DataFrame, docs: DataFrame, qrels: DataFrame | Shared, k: int = 5, settings: list[dict] | None = None) -> DataFrame:
    """(setting, qid, pid, score, before, rel): by setting (scoring options, plain late interaction if none), a row for each of a
    query's ``k`` best that says whether it is relevant, and one without pid that says how many documents come before its best
    relevant one (null where none is scored). Similarities are computed once for all settings."""
    settings = settings or [{}]
    for s in settings:
        scoring.check(**{"reduction": "max"} | s)
    full = [{"reduction": "max", "top_k": 3, "temperature": 0.1} | s for s in settings]
    relevant = relevance(qrels)
    some = F.size("toks") > 0
    d = relevant.marked_docs(docs.where(some).select("pid", "toks"))
    chunks = stored(B.laid(d, "pid", "d", CHUNK, spread=True, carried="marks"), "chunks")
    q = relevant.marked_queries(queries.where(some).select("qid", "toks"))
    best = best_relevant(stored(B.laid(q, "qid", "q", BLOCK), "blocks"), chunks, full)
    blocks = stored(B.laid(q.join(best, "qid", "left"), "qid", "q", BLOCK), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(k)
        for row in B.met(batches):
            m = B.Met(row)
            if not m.fit:
                continue
            bags = m.bags()
            qids, pids = row["qkeys"].to_numpy(zero_copy_only=False), row["dkeys"].to_numpy(zero_copy_only=False)[bags.order]
            back = np.argsort(bags.order)
            own = {int(q): docs for queries, docs in by_mark(row) for q in queries}
            none = [None] * len(full)
            best = np.array([x or none for x in row["qbest"].to_pylist()], float)  # null as nan
            best_pids = np.array([[p or 0 for p in x or none] for x in row["qbest_pids"].to_pylist()], np.int64)
            for a, b, tokens in m.queries(len(bags.vectors)):
                rel = np.zeros((b - a, len(pids)), bool)
                for i in range(a, b):
                    if i in own:
                        rel[i - a, back[own[i]]] = True
                asked, lengths = qids[a:b], m.lengths[a:b]
                starts, sims = np.cumsum(lengths) - lengths, bags.similarities(tokens)

                def every(options: dict) -> np.ndarray:
                    return np.add.reduceat(np.concatenate([B.reduced(s, **options) for s in sims], axis=1), starts, axis=0)

                if any(o["reduction"] in ("max", *BOUNDED) for o in full):
                    bound = every({"reduction": "max"})
                    likely = np.argpartition(-bound, k - 1, axis=1)[:, :k] if len(pids) > k else None
                for setting, options in enumerate(full):
                    top, top_pid = best[a:b, setting], best_pids[a:b, setting]
                    i = None
                    if options["reduction"] in BOUNDED and likely is not None:
                        # what the k likeliest have at least, any of the k best has
                        least = paired(sims, starts, lengths, np.repeat(np.arange(b - a), k), likely.ravel(), options).reshape(-1, k).min(axis=1)
                        i, j = np.nonzero(bound >= np.fmin(least, top)[:, None] - SLACK)
                        if len(i) <= MANY * bound.size:
                            s = np.round(paired(sims, starts, lengths, i, j, options), 9)
                        else:
                            i = None
                    if i is None:
                        s = np.round(bound if options["reduction"] == "max" else every(options), 9)
                        before = ((s > top[:, None]) | ((s == top[:, None]) & (pids[None, :] < top_pid[:, None]))).sum(axis=1)
                        i, j = np.nonzero(B.best_of(s, pids, k))
                        s = s[i, j]
                    else:
                        before = np.bincount(i[(s > top[i]) | ((s == top[i]) & (pids[j] < top_pid[i]))], minlength=b - a)
                        high = s >= least[i] - SLACK
                        i, j, s = i[high], j[high], s[high]
                    found.add(setting, asked[i], pids[j], s, rel[i, j])
                    found.count(setting, asked, before, ~np.isnan(top))
        yield from found.batches()

    return whole(scoring.pairs(blocks, chunks).mapInArrow(run, FOUND), k)


def per_query_settings(queries: DataFrame, docs: DataFrame, qrels: DataFrame | Shared, settings: list[dict], k: int = 5) -> DataFrame:
    """(setting, qid, ndcg, recall, mrr, n_rel, first): ``first`` is the place of the first relevant document, null where
    none is scored. What the chunks sent, a few rows a query, is laid down once for both that is made of it."""
    met = stored(places(queries, docs, qrels, k, settings), "places")
    counts = met.where("pid is null").groupBy("setting", "qid").agg((F.sum("before") + 1).alias("first"))
    by = W.partitionBy("setting", "qid").orderBy(F.col("score").desc(), "pid")
    top = met.where("pid is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    hits = top.where("rel").groupBy("setting", "qid").agg(F.sum(metrics.gain(F.col("rank"))).alias("dcg"), F.count("*").alias("hits"))
    rows = counts.join(hits, ["setting", "qid"], "left").join(relevance(qrels).sizes(), "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    return rows.select(
        "setting", "qid",
        F.coalesce(F.col("dcg") / metrics.ideal(F.col("n_rel"), k), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("hits") / F.col("n_rel"), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        "n_rel", "first",
    )


def per_query(queries: DataFrame, docs: DataFrame, qrels: DataFrame | Shared, k: int = 5, **options) -> DataFrame:
    """(qid, ndcg, recall, mrr, n_rel, first) of one setting."""
    return per_query_settings(queries, docs, qrels, [options], k).drop("setting")


def evaluate(queries: DataFrame, docs: DataFrame, qrels: DataFrame | Shared, k: int = 5, **options) -> DataFrame:
    """One row of means with n_queries and n_docs; documents are counted where they are, not among the pairs."""
    means = metrics.macro(per_query(queries, docs, qrels, k, **options))
    n_docs = docs.where(F.size("toks") > 0).agg(F.count("*").alias("n_docs"))
    return means.crossJoin(F.broadcast(n_docs))  # one row each


def evaluate_conditions(queries: DataFrame, conditions: dict[str, tuple[DataFrame, dict]], qrels: DataFrame | Shared, k: int = 5) -> DataFrame:
    """(condition, means, n_queries, n_docs) of named conditions (documents, scoring options). Conditions of the same
    documents share their similarities; the few rows are laid down, so deltas and summaries that use them more than once score
    nothing again."""
    groups: dict[int, list[str]] = {}
    for name, (docs, _) in conditions.items():
        groups.setdefault(id(docs), []).append(name)
    rows = []
    for names in groups.values():
        docs = conditions[names[0]][0]
        found = per_query_settings(queries, docs, qrels, [conditions[n][1] for n in names], k)
        means = metrics.macro(found, "setting").withColumn("condition", F.get(F.array(*map(F.lit, names)), F.col("setting").cast("int"))).drop("setting")
        rows.append(means.crossJoin(F.broadcast(docs.where(F.size("toks") > 0).agg(F.count("*").alias("n_docs")))))  # one row
    return stored(reduce(DataFrame.unionByName, rows), "conditions")
