"""Distributed training against the driver's gradient, and its recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyvec.operators import adapter as A
from manyvec.operators import scoring
from manyvec.operators import training as T
from manyvec.plans.fixtures import bags, degraded_tokens, qrels, queries_and_docs

PAGES = "pid long, clean array<array<double>>, toks array<array<double>>, variant string"
QUERIES = "qid long, group long, toks array<array<double>>"


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def made(spark, seed=1, n_pages=17, n_queries=6, dim=8, variants=("a", "b")):
    rng = np.random.default_rng(seed)
    clean = [unit(rng, rng.integers(1, 6), dim) for _ in range(n_pages)]
    bad = {v: [unit(np.random.default_rng([seed, ord(v), i]), len(c), dim) * 0.5 + c for i, c in enumerate(clean)] for v in variants}
    queries = [unit(rng, rng.integers(1, 4), dim) for _ in range(n_queries)]
    pairs = sorted({(int(q), int(rng.integers(0, n_pages))) for q in range(n_queries - 1) for _ in range(2)})
    pages = spark.createDataFrame([(i, clean[i].tolist(), bad[v][i].tolist(), v) for v in variants for i in range(n_pages)], PAGES).repartition(3)
    q = spark.createDataFrame([(i, i % 4, t.tolist()) for i, t in enumerate(queries)], QUERIES)
    rel = spark.createDataFrame(pairs + [(99, 1), (1, 999), pairs[0]], "qid long, pid long")
    teacher = np.array([[(t @ c.T).max(axis=1).sum() for c in clean] for t in queries])
    example = {v: A.Example(queries, bad[v], teacher, [{p for x, p in pairs if x == i} for i in range(n_queries)]) for v in variants}
    return pages, q, rel, example


def awake(dim=8, hidden=5, seed=3):
    """An adapter whose every weight matters."""
    a, rng = A.Adapter(dim, hidden, scale=0.3), np.random.default_rng(seed)
    a.weights = {k: w + rng.normal(size=w.shape) * 0.2 if k != "scale" else w for k, w in a.weights.items()}
    return a


@pytest.mark.parametrize("temperature", [0.07, 1.0])
def test_gradient_equals_the_drivers(spark, temperature):
    pages, q, rel, example = made(spark)
    a, s = awake(), T.Settings(temperature=temperature)
    parts, grads = T.step(pages.where("variant = 'a'"), rel, T.Batch.of(q), a, 17, s)
    want, want_grads = A.loss_and_gradient(a, example["a"], temperature, s.weights)
    for name in want:
        assert abs(parts[name] - want[name]) < 1e-9, name
    for name in want_grads:
        assert np.allclose(grads[name], want_grads[name], rtol=0, atol=1e-9), name


def test_gradient_on_the_given_table(spark, sf_dir):
    q, d = queries_and_docs(spark, sf_dir)
    bad = bags(degraded_tokens(spark, sf_dir), "pid")
    pages = bad.join(d.withColumnRenamed("toks", "clean"), "pid").withColumn("variant", F.lit("x"))
    n, rel = pages.count(), qrels(spark, sf_dir)
    a, s = awake(64, 6), T.Settings()
    parts, grads = T.step(pages, rel, T.Batch.of(q), a, n, s)
    bag = lambda f, key: [np.array(r["toks"], float) for r in f.orderBy(key).collect()]
    pids = {r["pid"]: i for i, r in enumerate(bad.select("pid").orderBy("pid").collect())}
    qids = [r["qid"] for r in q.select("qid").orderBy("qid").collect()]
    relevant = {i: set() for i in qids}
    for r in rel.collect():
        relevant[r["qid"]].add(pids[r["pid"]])
    teacher = np.zeros((len(qids), n))
    for r in scoring.score_multi_vector(q, d).collect():
        teacher[qids.index(r["qid"]), pids[r["pid"]]] = r["score"]
    want, want_grads = A.loss_and_gradient(a, A.Example(bag(q, "qid"), bag(bad, "pid"), teacher, [relevant[i] for i in qids]), s.temperature, s.weights)
    assert all(abs(parts[k] - want[k]) < 1e-9 for k in want)
    assert all(np.allclose(grads[k], want_grads[k], rtol=0, atol=1e-9) for k in want_grads)


def test_sums_merge_like_one_table():
    rng = np.random.default_rng(4)
    taught, scored, own = rng.normal(size=(30, 3)) * 50, rng.normal(size=(30, 3)) * 50, rng.random((30, 3)) < 0.2
    own[:, 2] = False
    whole = T.sums_of(taught, scored, own, 0.1)
    for cuts in ((10, 20), (1, 29)):
        parts = [T.sums_of(taught[i:j], scored[i:j], own[i:j], 0.1) for i, j in zip((0, *cuts), (*cuts, 30))]
        for q in range(3):
            import pandas as pd

            got = T.merged(pd.DataFrame([p.iloc[q] for p in parts]))
            for name, x in got.items():
                assert x == pytest.approx(whole[name].iloc[q], rel=1e-12) or np.isneginf(x) and np.isneginf(whole[name].iloc[q])


def test_epochs_take_every_group_once_in_an_order_of_their_own(spark):
    q = made(spark, n_queries=23)[1]
    orders = []
    for epoch in (1, 2):
        dealt, n = T.batches(q.withColumn("group", F.col("qid") % 11), T.Settings(groups_a_batch=4), epoch)
        rows = dealt.select("qid", "batch").collect()
        assert n == 3 and sorted(r["qid"] for r in rows) == list(range(23))
        by_group = {}
        for r in rows:
            by_group.setdefault(r["qid"] % 11, set()).add(r["batch"])
        assert all(len(b) == 1 for b in by_group.values())
        orders.append(tuple(next(iter(by_group[g])) for g in range(11)))
    assert orders[0] != orders[1]
    again = {r["qid"]: r["batch"] for r in T.batches(q.withColumn("group", F.col("qid") % 11), T.Settings(groups_a_batch=4), 1)[0].collect()}
    assert all(again[g] == orders[0][g] for g in range(11))
    assert {tuple(T.ordered(["a", "b", "c"], T.Settings(), e)) for e in range(1, 9)} > {("a", "b", "c")}


def test_training_resumes_from_its_checkpoint(spark, tmp_path):
    pages, q, rel, _ = made(spark, n_pages=9)
    held = q.where("group = 3").select("qid", "toks")
    s = T.Settings(groups_a_batch=3, epochs=3, rate=0.01)
    straight = T.train(pages, q.where("group < 3"), rel, held, pages.where("variant = 'b'"), awake(), s)
    path = f"file://{tmp_path}/run"
    T.train(pages, q.where("group < 3"), rel, held, pages.where("variant = 'b'"), awake(), T.Settings(groups_a_batch=3, epochs=2, rate=0.01), path)
    going_on = T.train(pages, q.where("group < 3"), rel, held, pages.where("variant = 'b'"), awake(seed=99), s, path)
    assert [h["epoch"] for h in going_on.history] == [1, 2, 3]
    for a, b in zip(straight.history, going_on.history):
        assert a["total"] == pytest.approx(b["total"], abs=1e-9) and a["score"] == pytest.approx(b["score"], abs=1e-12)
    assert np.allclose(T.flat(straight.trained().weights), T.flat(going_on.trained().weights), atol=1e-9)
    assert spark.read.parquet(path).count() == 3
    assert straight.history[-1]["total"] < straight.history[0]["total"]


def test_training_stops_early_and_keeps_the_best(spark):
    pages, q, rel, _ = made(spark, n_pages=5, n_queries=4)
    state = T.train(pages.where("variant = 'a'"), q.where("group < 2"), rel, q.where("group = 3").select("qid", "toks"), pages.where("variant = 'a'"), awake(), T.Settings(epochs=9, patience=1, rate=0.0))
    assert len(state.history) == 2 and state.best_epoch == 1


def test_nothing_to_train_on(spark):
    pages, q, rel, _ = made(spark, n_pages=4, n_queries=4)
    state = T.train(pages, q.where("false"), rel, q.select("qid", "toks"), pages, awake(), T.Settings(epochs=1))
    assert state.history[0]["total"] == 0.0 and state.steps == 0
    bare = pages.union(spark.createDataFrame([(77, [], [], "a"), (78, None, None, "a")], PAGES))
    state = T.train(bare.where("variant = 'a'"), q, rel, q.select("qid", "toks"), pages, awake(), T.Settings(epochs=1))
    assert state.steps == 1 and np.isfinite(state.history[0]["total"])


def test_large_batches_are_refused(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError):
        T.Batch.of(made(spark)[1])


def test_steps_move_no_vectors(spark):
    pages, q, rel, _ = made(spark)
    rows = T.with_relevant(pages, rel, T.Batch.of(q))
    p = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


class Narrow(A.Adapter):
    """Refuses more tokens at once than executors may hold."""

    def forward(self, e, tape=None):
        assert len(e) <= 4096, len(e)
        return super().forward(e, tape)


def test_an_executor_holds_few_tokens_at_once(spark):
    n, rng = 3000, np.random.default_rng(8)
    toks = rng.normal(size=(n, 2, 4))
    pages = spark.createDataFrame([(i, t.tolist(), t.tolist(), "a") for i, t in enumerate(toks)], PAGES).coalesce(1)
    a = awake(4, 3)
    narrow = Narrow(4, 3, weights=a.weights)
    got = {r["pid"]: r["toks"] for r in narrow.apply(pages).collect()}
    assert len(got) == n and np.allclose([got[i] for i in range(n)], a.forward(toks.reshape(-1, 4)).reshape(n, 2, 4), rtol=0, atol=1e-15)
    queries = [toks[0] * 0.1, toks[1] * 0.1]
    batch = T.Batch(np.array([0, 1]), np.array([2, 2]), np.concatenate(queries))
    rel = spark.createDataFrame([(0, 0), (1, 1), (1, 2999)], "qid long, pid long")
    parts, grads = T.step(pages, rel, batch, narrow, n, T.Settings())
    teacher = np.array([[(q @ c.T).max(axis=1).sum() for c in toks] for q in queries])
    want, want_grads = A.loss_and_gradient(a, A.Example(queries, list(toks), teacher, [{0}, {1, 2999}]), 0.07, T.Settings().weights)
    assert all(abs(parts[k] - want[k]) < 1e-9 for k in want)
    assert all(np.allclose(grads[k], want_grads[k], rtol=0, atol=1e-9) for k in want_grads)


def test_apply_keeps_pages_without_tokens(spark):
    a = awake(2, 3)
    rows = [(1, [[1.0, 2.0]]), (2, []), (3, None), (4, [[0.5, 0.1], [3.0, 1.0]])]
    got = {r["pid"]: r["toks"] for r in a.apply(spark.createDataFrame(rows, "pid long, toks array<array<double>>").coalesce(1)).collect()}
    assert got[2] == [] and got[3] is None and np.allclose(got[4], a.forward(np.array(rows[3][1])), atol=1e-15) and np.allclose(got[1], a.forward(np.array(rows[0][1])), atol=1e-15)
